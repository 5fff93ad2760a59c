"""Allow and block rules for URLs by a sort-merge range join.

A host's canonical key is its labels reversed, each with a dot: com.example.www. A rule's host is then a
prefix of the keys of the host and all its subdomains, that is the interval from its key on. URLs and
rule hosts are sorted together by key; a sweep keeps a stack of the rule hosts whose intervals are open,
which nest, and takes from them the longest rule whose path begins the URL's.

Scale: keys are dealt to ranges, whose bounds Spark's own range partitioning gives (one row for each
partition reaches the driver, MOST_RANGES at most). A rule host goes to each range that its interval meets, so a task never
needs another's stack; that repeats at most the hosts nested at each bound. A common host is split over
ranges by a hash of the row that follows the key. A task holds the open hosts' rules only.

Defined cases: a null url, or one without ://, has an empty host and path and gets the default verdict;
repeated rows are judged each; very long urls are judged whole; an empty table gives no rows; rules with a null host, path or verdict are left out; of rules with one
host and path, block wins; of fitting rules of one length that with the longer host wins. Only the id
and url columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL_ROWS, MOST_RANGES = 50_000, 4096  # rows in a range, about, while there are fewer ranges; a range is streamed, so it may hold any number

#: The rules of the registered query; fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_host(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host, up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _range_of(column: Column, bounds: list[str]) -> Column:
    edges = np.array(bounds, dtype=object)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(dtype=object), side="right").astype(np.int32))

    return place(column)


def _sweep(batches):
    """Rows in order of (range, key, kind): kind 0 is a rule host with its rules, kind 1 a URL."""
    at, stack = None, []
    for batch in batches:
        d = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
        rules, verdicts, keep = [], [], []
        for k in range(batch.num_rows):
            if d["range"][k] != at:
                at, stack = d["range"][k], []
            key = d["key"][k]
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if d["kind"][k] == 0:
                own = {r["path"]: r["verdict"] for r in d["rules"][k]}
                stack.append((key, d["host"][k], (own, max(map(len, own)))))
                continue
            best = None
            for _, host, own in reversed(stack):
                for cut in range(min(len(d["path"][k]), own[1]), -1, -1):
                    if verdict := own[0].get(d["path"][k][:cut]):
                        if best is None or len(host) + cut > best[0]:
                            best = (len(host) + cut, host + d["path"][k][:cut], verdict)
                        break
            keep.append(k)
            rules.append(best and best[1])
            verdicts.append(best and best[2])
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).take(keep) for n in ("page_id", "host", "path")), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule, else null) and verdict for each row of pages.

    rules has host, path and verdict (allow or block). ranges is by default a range for URL_ROWS rows.
    """
    url = F.col(url_col).cast("string")
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    urls = urls.withColumn("key", F.concat(host_key(F.col("host")), F.lit("\0"), F.lpad(F.hex(F.xxhash64("page_id", "host", "path")), 16, "0")))
    hosts = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = hosts.groupBy("host").agg(F.collect_list(F.struct("path", "verdict")).alias("rules"))
    hosts = hosts.withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("key", host_key(F.col("host")))
    ranges = ranges or max(1, min(MOST_RANGES, -(-pages.count() // URL_ROWS)))
    ranged = urls.select("key").repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("least"))
    bounds = sorted(r.least for r in ranged.collect())[1:]
    urls = urls.withColumn("range", _range_of(F.col("key"), bounds))
    last = F.concat(F.col("key"), F.lit("\U0010ffff"))
    hosts = hosts.withColumn("range", F.explode(F.sequence(_range_of(F.col("key"), bounds), _range_of(last, bounds))))
    no_rules = F.lit(None).cast(hosts.schema["rules"].dataType)
    both = urls.select("range", "key", F.lit(1).alias("kind"), "page_id", "host", "path", no_rules.alias("rules")).union(
        hosts.select("range", "key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), "host", F.lit("").alias("path"), "rules")
    )
    dealt = both.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "key", "kind")
    page_type = urls.schema["page_id"].dataType.simpleString()
    judged = dealt.mapInArrow(_sweep, f"page_id {page_type}, host string, path string, rule string, verdict string")
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op5_url_range_join(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = r"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(h, s, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select page_id, host, path, h || s as rule, verdict, row_number() over (partition by page_id order by length(h || s) desc) as k
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s))
select p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') as verdict from p left join m on p.page_id = m.page_id and m.k = 1
"""
