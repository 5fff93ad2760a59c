"""WARC archives of pages, written and read by Spark, with a merged capture index.

Writing: of the pages with one payload of at least a size the smallest id is archived as a response, the
others as revisits that refer to it. Records are text (a header and a UTF-8 block), and each ends with two
line ends, so Spark's text writer with that line separator writes valid WARC files to any store.

Reading: each file is parsed by its records' content lengths. Its captures, sorted by URL key and time,
are one run of the external index merge: all runs are cut at the same key bounds, and for each range of
keys a loser tree merges the runs, which gives the capture history in global order.

Scale: payloads pass once through a shuffle, and only if the duplicated payloads are too many for a
broadcast of checked size; hashes are aggregated before that. A file holds so many records of a class of SIZES that
its bytes are bounded, or one very large record. A
merge task holds one range of the index, whose rows have no payload.

Defined cases: a null html is empty; a null url has an empty target; pages with a null id are archived,
but nothing refers to them; a payload of up to the 2 GB that a row may hold is written and read whole; an empty table
gives no rows; ties of key and time go by the record's id; repeated rows (one id, one payload) are all responses; extra columns aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_dir, checkpointed

LEAST_BYTES, INDEX_ROWS, SMALL = 100, 50_000, 200_000
#: Records in a file by the bytes of their payloads (up to, records); the last holds what is larger.
SIZES = ((1 << 16, 500), (1 << 20, 32), (None, 1))
EPOCH = 1_704_067_200  # captures without a time are dated from 2024-01-01, one second for each id
END = "\r\n\r\n"
_HEADER = re.compile(rb"([A-Za-z-]+): ?(.*)")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, bytes of the payload, and record, the WARC record's text without its final line ends."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html"), "sha": F.sha2("html", 256)})
    same = rows.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first")
    same = checkpointed(same)
    rows = rows.join(F.broadcast(same) if same.count() <= SMALL else same, "sha", "left")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    target = F.regexp_replace("url", r"[\r\n]", "")
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id").cast("long"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.when(refers.isNull(), F.concat(http, F.col("html"))).otherwise(http)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(refers.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Date: "), when, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("sha"),
        F.when(refers.isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    return rows.select("page_id", "bytes", F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, sizes: tuple = SIZES, html_col: str = "html", **columns) -> None:
    """Gzipped WARC files in folders under path, one for each class of sizes, so that a file's bytes are bounded."""
    written = records(pages, html_col=html_col, **columns)
    largest = pages.agg(F.max(F.octet_length(F.col(html_col).cast("string")))).first()[0] or 0
    low = -1
    for k, (high, most) in enumerate(sizes):
        if k == 0 or largest > low:
            own = written.where((F.col("bytes") > low) & (F.lit(True) if high is None else F.col("bytes") <= high)).select("record")
            own.write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/size={k}")
        low = high


def parsed(raw: bytes):
    """(offset, length, headers, block) of each record of an archive."""
    at = 0
    while at < len(raw):
        head_end = raw.index(b"\r\n\r\n", at) + 4
        headers = {m[1].decode().lower(): m[2].decode() for line in raw[at:head_end].split(b"\r\n")[1:] if (m := _HEADER.fullmatch(line))}
        size = int(headers["content-length"])
        if raw[head_end + size : head_end + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where its length says")
        yield at, head_end + size + 4 - at, headers, raw[head_end : head_end + size]
        at = head_end + size + 4


def url_key(url: str) -> str:
    """Host labels reversed, then the path: com,example,www)/path?query, in lower case."""
    host, slash, path = url.partition("://")[2].partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path.partition('#')[0]}".lower()


CAPTURE = "url_key string, captured string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, run string, place long, offset long, length long"

NUMBERS = ("payload_bytes", "place", "offset", "length")


def _captures(batches):
    """A sorted run of captures for each archive; the payload's length and hash are those of the bytes read."""
    names = [c.split()[0] for c in CAPTURE.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            run = []
            for offset, length, headers, block in parsed(gzip.decompress(content)):
                http, _, payload = block.partition(b"\r\n\r\n")
                stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
                response = headers["warc-type"] == "response"
                digest = hashlib.sha256(payload).hexdigest() if response else headers["warc-payload-digest"].partition(":")[2]
                if response and (len(payload) != stated or digest != headers["warc-payload-digest"].partition(":")[2]):
                    raise ValueError(f"{path}: the payload at {offset} is damaged")
                name = lambda key: headers[key][len("<urn:page:") : -1] if key in headers else None
                run.append((url_key(headers["warc-target-uri"]), headers["warc-date"], name("warc-record-id"), stated, digest, headers["warc-type"], name("warc-refers-to"), path, 0, offset, length))
            run.sort(key=lambda r: (r[0], r[1], r[2]))
            whole = dict(zip(names, zip(*run, strict=True), strict=True)) if run else dict.fromkeys(names, ())
            whole["place"] = range(len(run))
            yield pa.RecordBatch.from_arrays([pa.array(whole[n], pa.int64() if n in NUMBERS else pa.string()) for n in names], names=names)


def merged(runs: list[list]) -> list:
    """The runs' entries in order, by a loser tree: inner nodes hold the loser of each match, node 0 the winner."""
    k = len(runs)
    if k < 2:
        return runs[0] if runs else []
    at = [0] * k
    head = lambda i: runs[i][at[i]] if i >= 0 and at[i] < len(runs[i]) else None

    def beats(i: int, j: int) -> bool:
        a, b = head(i), head(j)
        return b is None or a is not None and (a, i) <= (b, j)

    tree = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        left, right = play(2 * node), play(2 * node + 1)
        winner, tree[node] = (left, right) if beats(left, right) else (right, left)
        return winner

    winner, out = play(1), []
    while (entry := head(winner)) is not None:
        out.append(entry)
        at[winner] += 1
        node = (winner + k) // 2
        while node:
            if not beats(winner, tree[node]):
                winner, tree[node] = tree[node], winner
            node //= 2
    return out


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """The runs of one range of keys, each in the order of its archive, merged."""
    keys = list(zip(frame["url_key"], frame["captured"], frame["page_id"], range(len(frame)), strict=True))
    run = frame["run"].to_numpy(dtype=object)
    names, which = np.unique(run, return_inverse=True)
    runs: list[list] = [[] for _ in names]
    for k in np.argsort(frame["place"].to_numpy(), kind="stable").tolist():
        runs[which[k]].append(keys[k])
    order = [e[3] for e in merged(runs)]
    out = frame.iloc[order].reset_index(drop=True)
    return out.assign(position=np.arange(len(out)))


def read_archives(spark, path: str) -> DataFrame:
    """A row for each record, unordered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_captures, CAPTURE)


def capture_history(captures: DataFrame, index_rows: int = INDEX_ROWS) -> DataFrame:
    """captures in the order of URL key, time and record id: by part, then by position in it."""
    key = F.concat_ws("\0", "url_key", "captured", "page_id", "run", F.lpad("offset", 20, "0"))
    keyed = checkpointed(captures.withColumn("_key", key))
    parts = max(1, -(-keyed.count() // index_rows))
    ranged = keyed.select("_key").repartitionByRange(parts, "_key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("_key").alias("least"))
    edges = np.array(sorted(r.least for r in ranged.collect())[1:], dtype=object)

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(dtype=object), side="right").astype(np.int32))

    return keyed.withColumn("part", part("_key")).drop("_key").groupBy("part").applyInPandas(_merge, f"{CAPTURE}, part int, position long")


def op8_warc_index_merge(spark, sf_dir: str) -> DataFrame:
    """Every page archived, read back and listed in the order of its capture history."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    named = lambda c: F.nullif(F.col(c), F.lit("")).cast(kind).alias(c)
    history = capture_history(read_archives(spark, folder))
    return history.select(named("page_id"), "payload_bytes", "payload_digest", "record_type", named("refers_to"))


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
b as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from b where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to
from b left join f using (payload_digest)
"""
