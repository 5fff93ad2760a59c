"""Queries on several datasets: the orders of each priority as text columns, and events with faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare
from .queries_tables import EVENTS, dirty_events, rounded
from .registry import query, table


def by_status(spark, d):
    """Orders by status, F and O."""
    o = table(spark, d, "orders").drop("o_orderkey")
    return {s: o.where(F.col("o_orderstatus") == s) for s in ("F", "O")}


_TWO = "(select *, o_orderstatus as dataset from orders where o_orderstatus in ('F', 'O'))"


@query("workspace_list", f"select dataset, count(*)::bigint as rows, 5::bigint as columns, 5::bigint as shared from {_TWO} group by 1")
def _(spark, d):
    return compare.list_datasets(by_status(spark, d))


@query("shared_columns", "select column_name as \"column\" from information_schema.columns where table_name = 'nation' and column_name <> 'n_nationkey'")
def _(spark, d):
    n = table(spark, d, "nation")
    names = compare.shared_columns({"a": n.drop("n_nationkey"), "b": n})
    return n.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column")) for c in names)))).distinct()


@query("union_counts", f"select dataset, count(*)::bigint as rows, round(sum(o_totalprice), 2) as total from {_TWO} group by 1")
def _(spark, d):
    return rounded(compare.stacked(by_status(spark, d)).groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total")), 2)


_TEXTS = " union all ".join(f"select dataset, '{c}' as \"column\", {c}::varchar as x from {_TWO}" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


@query("shared_kinds", f"with k as (select dataset, \"column\", case when avg((try_cast(x as double) is not null)::int) >= 0.7 then 'numeric' when avg((try_cast(x as timestamp) is not null)::int) >= 0.7 then 'dateLike' else 'categorical' end as kind from ({_TEXTS}) where x <> '' group by all) select \"column\", case when count(distinct kind) = 1 then min(kind) else 'categorical' end as kind from k group by 1")
def _(spark, d):
    return compare.shared_kinds(by_status(spark, d))


@query("compare_describe", f"select dataset, count(*)::bigint as rows, 5::bigint as columns, (count(*) - count(distinct (o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)))::bigint as duplicates, round(avg(o_custkey), 4) as mean, round(quantile_cont(o_custkey, 0.5), 4) as median, round(stddev_samp(o_custkey), 4) as sd from {_TWO} group by 1")
def _(spark, d):
    return compare.compare_describe(by_status(spark, d)).select("dataset", "rows", "columns", "duplicates", "mean", "median", "sd")


@query("stat_diff_numeric", f"with m as (select dataset, round(avg(o_totalprice), 4) as a, round(avg(o_custkey), 4) as b from {_TWO} group by 1) select 'o_totalprice' as \"column\", round(max(a) - min(a), 4) as mean_delta, 2::bigint as datasets from m union all select 'o_custkey', round(max(b) - min(b), 4), 2 from m")
def _(spark, d):
    return compare.stat_diff_numeric(by_status(spark, d))


@query("stat_diff_means", f"select 'o_totalprice' as \"column\", dataset, count(*)::bigint as n, round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.5), 4) as median, round(stddev_samp(o_totalprice), 4) as sd from {_TWO} group by all")
def _(spark, d):
    return compare.numeric_means(by_status(spark, d), ["o_totalprice"])


@query("stat_diff_categorical", f"with c as (select dataset, o_orderpriority as v, count(*) as c from {_TWO} group by all), s as (select dataset, round(max(c) / sum(c), 4) as s from c group by 1) select 'o_orderpriority' as \"column\", round(max(s) - min(s), 4) as dominance_gap from s union all select 'o_orderstatus', 0.0")
def _(spark, d):
    return compare.stat_diff_categorical(by_status(spark, d), ["o_orderpriority", "o_orderstatus"])


_EVENT_TEXTS = " union all ".join(f"select '{c}' as \"column\", {c}::varchar as x from {EVENTS}" for c in ("event_id", "value", "event_type", "user_id"))
_NATION_TEXTS = " union all ".join(f"select '{c}' as \"column\", {c}::varchar as x from nation" for c in ("n_nationkey", "n_name", "n_regionkey"))


def _facts(texts: str, source: str) -> str:
    """One row: whether a fifth of a column is missing, repeated rows, and columns by kind."""
    kinds = f"select \"column\", 100.0 * count_if(x is null or x = '') / count(*) as missing, coalesce(avg(case when x <> '' then (try_cast(x as double) is not null)::int end), 0) as num, coalesce(avg(case when x <> '' then (try_cast(x as timestamp) is not null)::int end), 0) as tim from ({texts}) group by 1"
    return f"(select max(missing) as missing, count_if(num >= 0.7) as n, count_if(num < 0.7 and tim < 0.7) as c from ({kinds})), (select count(*) as rows, (select count(*) from (select distinct * from {source})) as kinds from {source})"


_SCORE = "case when missing >= 20 then 4.0 else 0.0 end + case when rows > kinds then 2.0 else 0.0 end + case when n >= 1 and c >= 1 then 2.0 when n >= 2 then 2.0 when c >= 2 then 1.5 when n + c >= 1 then 1.0 else 0.0 end"


@query("workspace_priority", f"select dataset, score, case when score >= 5 then 'high' when score >= 3 then 'medium' else 'low' end as priority from (select 'events' as dataset, ({_SCORE})::double as score from {_facts(_EVENT_TEXTS, EVENTS)} union all select 'nation', (0.5 + {_SCORE})::double from {_facts(_NATION_TEXTS, 'nation')})")
def _(spark, d):
    return compare.rank_datasets({"events": dirty_events(spark, d), "nation": table(spark, d, "nation")}, active="nation")


_KINDS = f"""k as (select dataset, "column", case when avg((try_cast(x as double) is not null)::int) >= 0.7 then 'numeric' when avg((try_cast(x as timestamp) is not null)::int) >= 0.7 then 'dateLike' else 'categorical' end as kind from ({_TEXTS}) where x <> '' group by all),
s as (select "column", case when count(distinct kind) = 1 then min(kind) else 'categorical' end as kind from k group by 1),
o as (select s.*, row_number() over (partition by kind order by column_index) as i from s join duckdb_columns() c on c.table_name = 'orders' and c.column_name = s."column"),
f as (select max("column") filter (kind = 'numeric' and i = 1) as n1, max("column") filter (kind = 'numeric' and i = 2) as n2, max("column") filter (kind = 'categorical' and i = 1) as c1, max("column") filter (kind = 'categorical' and i = 2) as c2, max("column") filter (kind = 'dateLike' and i = 1) as t1 from o)"""


@query("workspace_chart_plan", f"with {_KINDS} select case when t1 is not null and n1 is not null then 'line' when n1 is not null and c1 is not null then 'bar' when n2 is not null then 'scatter' when n1 is not null then 'histogram' else 'bar' end as type, case when t1 is not null and n1 is not null then t1 when n1 is not null and c1 is not null then c1 else coalesce(n1, c1, t1) end as x, case when n1 is not null and (t1 is not null or c1 is not null) then n1 else n2 end as y, case when n1 is null then 'count' when t1 is not null or c1 is not null then 'mean' end as agg from f")
def _(spark, d):
    return compare.chart_plan(by_status(spark, d))


_LEVELS = "(select case when count(distinct nullif(x, '')) = 2 then 'ttest' when count(distinct nullif(x, '')) > 2 then 'anova' end from texts where dataset = 'F' and \"column\" = c1)"


@query("workspace_compare_plan", f"""with texts as ({_TEXTS}), {_KINDS}, p as (
select 'group' as kind, n1 || ',' || c1 as columns, 'high' as priority, {_LEVELS} as op from f union all select 'correlation', n1 || ',' || n2, 'high', 'corr' from f
union all select 'trend', t1 || ',' || n1, 'medium', 'describe' from f union all select 'association', c1 || ',' || c2, 'medium', 'chisq' from f)
select * from p where columns is not null""")
def _(spark, d):
    return compare.compare_plan(by_status(spark, d)).select("kind", "columns", "priority", "op")


_STEP = "case when (select count(distinct x) from texts t where t.dataset = g.dataset and t.\"column\" = coalesce(g.text, f.c1) and x <> '') = 2 then 'ttest' when (select count(distinct x) from texts t where t.dataset = g.dataset and t.\"column\" = coalesce(g.text, f.c1) and x <> '') > 2 then 'anova' when g.text is null then 'ci_mean' when f.c2 is not null then 'chisq' else 'describe' end"


@query("workspace_follow_ups", f"""with texts as ({_TEXTS}), {_KINDS},
m as (select "column", max(a) - min(a) as gap from (select "column", dataset, round(avg(try_cast(x as double)), 4) as a from texts join s using ("column") where kind = 'numeric' group by all) group by 1 order by 2 desc, 1 limit 3),
v as (select "column", max(r) - min(r) as gap from (select "column", dataset, round(max(c) / sum(c), 4) as r from (select "column", dataset, x, count(*) as c from texts join s using ("column") where kind = 'categorical' and x <> '' group by all) group by all) group by 1 order by 2 desc, 1 limit 3),
g as (select "column", 'numeric' as kind, null as text, dataset from m, (select distinct dataset from texts) union all select "column", 'categorical', "column", dataset from v, (select distinct dataset from texts))
select g."column", g.kind, g.dataset, {_STEP} as op from g, f""")
def _(spark, d):
    return compare.follow_ups(by_status(spark, d)).drop("args_json")
