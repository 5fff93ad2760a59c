"""Queries on sources, column functions, selection, description and quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import describe, profile, quality, quantiles, ranks
from ..sources import tables
from .registry import query, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, digits: int = 4):
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _each(columns: list[str], source: str, body: str) -> str:
    """body for each column, united; {c} is the column."""
    return " union all ".join(f"select '{c}' as \"column\", {body.format(c=c)} from {source}" for c in columns)


_CORE = """count({c})::bigint as n, round(avg({c}), 4) as mean, round(quantile_cont({c}, 0.5), 4) as median, round(min({c}), 4) as min,
 round(max({c}), 4) as max, round(max({c}) - min({c}), 4) as range, round(var_samp({c}), 4) as variance, round(stddev_samp({c}), 4) as std,
 round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.75), 4) as q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) as iqr,
 round(skewness({c}), 4) as skew, round(kurtosis({c}), 4) as kurtosis, {mode} as mode"""


def _core_sql(columns, source):
    mode = lambda c: f"(select v from (select round({c}, 4) as v, count(*) as k from {source} where {c} is not null group by {c} order by k desc, {c} limit 1))"
    return " union all ".join(f"select '{c}' as \"column\", {_CORE.format(c=c, mode=mode(c))} from {source}" for c in columns)


@query("describe_core", _core_sql(LINE, "lineitem"))
def _(spark, d):
    return rounded(describe.numeric_core_stats(table(spark, d, "lineitem"), LINE))


@query("describe_numeric", _each(["o_totalprice"], "orders", "count({c})::bigint as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min, round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.5), 4) as median, round(quantile_cont({c}, 0.75), 4) as q3, round(max({c}), 4) as max"))
def _(spark, d):
    return rounded(describe.describe_numeric(table(spark, d, "orders"), ["o_totalprice"]))


EVENTS = "(select event_id, case when event_id % 7 = 0 then null else value end as value, case when event_id % 5 = 0 then '' else event_type end as event_type, user_id from events)"


def dirty_events(spark, d):
    """events with some values missing and some types blank."""
    e = table(spark, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("event_type"), "user_id")


@query("missing_by_column", _each(["event_id", "value", "event_type", "user_id"], EVENTS, "count(*) filter ({c} is null)::bigint as missing, round(count(*) filter ({c} is null) / count(*), 4) as rate"))
def _(spark, d):
    return rounded(quality.missing_by_column(dirty_events(spark, d)))


@query("null_rate_top", f"select * from ({_each(['event_id', 'value', 'event_type', 'user_id'], EVENTS, 'count(*) filter ({c} is null)::bigint as missing, round(count(*) filter ({c} is null) / count(*), 4) as rate')}) order by missing desc, \"column\" limit 2")
def _(spark, d):
    return rounded(describe.null_rates(dirty_events(spark, d), 2))


@query("missing_pattern", f"select (case when value is null then 1 else 0 end)::int as missing_columns, count(*)::bigint as rows from {EVENTS} group by 1")
def _(spark, d):
    return describe.missing_pattern(dirty_events(spark, d))


@query("duplicate_rows", "select count(*)::bigint as rows, 2::bigint as columns, (count(*) - count(distinct (l_quantity, l_discount)))::bigint as duplicates from lineitem")
def _(spark, d):
    return describe.duplicate_rows(table(spark, d, "lineitem").select("l_quantity", "l_discount"))


@query("dtype_summary", "select case when data_type in ('BIGINT', 'INTEGER', 'DOUBLE') then 'numeric' when data_type like 'TIMESTAMP%' then 'datetime' else 'text' end as kind, count(*)::bigint as columns from duckdb_columns() where table_name = 'orders' group by 1")
def _(spark, d):
    return describe.dtype_summary(table(spark, d, "orders"))


@query("describe_categorical", """with v as (select 'o_orderstatus' as "column", o_orderstatus as value from orders union all select 'o_orderpriority', o_orderpriority from orders),
c as (select "column", value, count(*) as c from v where value is not null group by all),
r as (select *, row_number() over (partition by "column" order by c desc, value) as k, sum(c) over (partition by "column") as n, count(*) over (partition by "column") as u from c)
select "column", n::bigint as count, u::bigint as "unique", value as top, c::bigint as freq from r where k = 1""")
def _(spark, d):
    return describe.describe_categorical(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("value_counts", "select p_brand as value, count(*)::bigint as count, round(count(*) / (select count(*) from part), 6) as ratio from part group by 1 order by 2 desc, 1 limit 10")
def _(spark, d):
    return rounded(describe.value_counts(table(spark, d, "part"), "p_brand"), 6)


@query("column_stats_basic", _each(["value"], "events", "round(avg({c}), 4) as mean, round(quantile_cont({c}, 0.5), 4) as median, round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min, round(max({c}), 4) as max, round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.75), 4) as q3, count({c})::bigint as n"))
def _(spark, d):
    return rounded(describe.numeric_core_stats(table(spark, d, "events"), ["value"]).select("column", "mean", "median", "std", "min", "max", "q1", "q3", "n"))


@query("describe_warnings", "select 'Fewer than 20 rows.' as warning where (select count(*) from region) < 20 union all select 'No categorical column.' where (select bool_and(data_type not like '%CHAR%') from information_schema.columns where table_name = 'region' and column_name <> 'r_name')")
def _(spark, d):
    return spark.createDataFrame([(w,) for w in describe.describe_warnings(table(spark, d, "region").drop("r_name"))], "warning string")


_BOUNDS = """b as (select '{c}' as "column", count({c}) as n, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3, avg({c}) as m, stddev_samp({c}) as s from {t}),
l as (select *, q1 - 1.5 * (q3 - q1) as iqr_low, q3 + 1.5 * (q3 - q1) as iqr_high, m - 3 * s as z_low, m + 3 * s as z_high from b)"""


@query("outlier_summary", f"""with {_BOUNDS.format(c="value", t="events")}
select "column", n::bigint as n, round(iqr_low, 4) as iqr_low, round(iqr_high, 4) as iqr_high, round(z_low, 4) as z_low, round(z_high, 4) as z_high,
 (select count(*) from events where value < iqr_low or value > iqr_high)::bigint as iqr_outliers, (select count(*) from events where value < z_low or value > z_high)::bigint as z_outliers from l""")
def _(spark, d):
    return rounded(quality.outlier_summary(table(spark, d, "events"), ["value"]))


def _clean_sql(kind, winsorize):
    keep = f"select event_id, round(greatest({kind}_low, least({kind}_high, value)), 4) as value, event_type, user_id from x, l" if winsorize else f"select event_id, round(value, 4) as value, event_type, user_id from x, l where value is not null and value between {kind}_low and {kind}_high"
    return f"with x as (select * from {EVENTS}), {_BOUNDS.format(c='value', t='x')} {keep}"


@query("quality_exclude", _clean_sql("iqr", False))
def _(spark, d):
    return rounded(quality.quality_process(dirty_events(spark, d), "exclude", "iqr", ["value"])[0])


@query("quality_winsorize", _clean_sql("iqr", True).replace("round(greatest(iqr_low, least(iqr_high, value)), 4)", "case when value is not null then round(greatest(iqr_low, least(iqr_high, value)), 4) end"))
def _(spark, d):
    return rounded(quality.quality_process(dirty_events(spark, d), "winsorize", "iqr", ["value"])[0])


@query("quality_zscore", _clean_sql("z", False))
def _(spark, d):
    return rounded(quality.quality_process(dirty_events(spark, d), "exclude", "zscore", ["value"])[0])


@query("quality_summary", f"""with x as (select * from {EVENTS}), {_BOUNDS.format(c="value", t="x")},
a as (select count(*) as r, count(*) filter (value is null) as m, count(*) filter (value < iqr_low or value > iqr_high) as o, count(*) filter (value between iqr_low and iqr_high) as k from x, l)
select r::bigint as rows_before, m::bigint as missing_before, o::bigint as outliers_before, k::bigint as rows_after, 0::bigint as missing_after, 0::bigint as outliers_after,
 (k - r)::bigint as rows_delta, (-m)::bigint as missing_delta, (-o)::bigint as outliers_delta from a""")
def _(spark, d):
    return quality.quality_process(dirty_events(spark, d), "exclude", "iqr", ["value"])[1]


def text_orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(*(F.col(c).cast("string").alias(c) for c in o.columns))


_TEXT_ORDERS = "(select " + ", ".join(f"{c}::varchar as {c}" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + " from orders)"


@query("column_kinds", "select \"column\", non_blank, round(numeric_share, 4) as numeric_share, round(date_share, 4) as date_share, case when numeric_share >= 0.7 then 'numeric' when date_share >= 0.7 then 'dateLike' else 'categorical' end as kind from (" + _each(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], _TEXT_ORDERS, "count({c})::bigint as non_blank, avg((try_cast({c} as double) is not null)::int) as numeric_share, avg((try_strptime({c}, '%Y-%m-%d %H:%M:%S') is not null)::int) as date_share") + ")")
def _(spark, d):
    return rounded(profile.column_kinds(text_orders(spark, d)))


@query("profile_top_missing", f"select * from ({_each(['event_id', 'value', 'event_type', 'user_id'], EVENTS, chr(34).join(['count(*) filter ({c} is null or {c}::varchar = ' + repr('') + ')::bigint as missing, round(100 * count(*) filter ({c} is null or {c}::varchar = ' + repr('') + ') / count(*), 1) as rate']))}) where missing > 0 order by rate desc, \"column\" limit 5")
def _(spark, d):
    return profile.top_missing(dirty_events(spark, d))


@query("profile_top_outliers", """with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, count(value) as n from events)
select 'value' as "column", count(*)::bigint as outliers, round(100.0 * count(*) / max(n), 1) as rate from events, q where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) having count(*) > 0""")
def _(spark, d):
    return profile.top_outliers(table(spark, d, "events"), ["value"])


_STATUS = "(select case when o_orderkey % 10 = 0 then 'rare' else 'usual' end as state, o_orderpriority from orders)"


@query("profile_imbalanced", f"select 'state' as \"column\", 'usual' as top_value, round(100.0 * count(*) filter (state = 'usual') / count(*), 1) as rate from {_STATUS}")
def _(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, "rare").otherwise("usual").alias("state"), "o_orderpriority")
    return profile.imbalanced(o, ["state", "o_orderpriority"])


_EVENT_TEXTS = " union all ".join(f"select '{c}' as \"column\", {c}::varchar as x from {EVENTS}" for c in ("event_id", "value", "event_type", "user_id"))
_EVENT_KINDS = f"select \"column\", case when avg((try_cast(x as double) is not null)::int) >= 0.7 then 'numeric' when avg((try_cast(x as timestamp) is not null)::int) >= 0.7 then 'dateLike' else 'categorical' end as kind from ({_EVENT_TEXTS}) where x <> '' group by 1"


@query("profile_row", f"select count(*)::bigint as rows, 4::bigint as columns, (count(*) - (select count(*) from (select distinct * from {EVENTS})))::bigint as duplicates, (select count(*) from ({_EVENT_KINDS}) where kind = 'numeric')::bigint as numeric, (select count(*) from ({_EVENT_KINDS}) where kind = 'categorical')::bigint as categorical, (select count(*) from ({_EVENT_KINDS}) where kind = 'dateLike')::bigint as date_like, (select count(distinct \"column\") from ({_EVENT_TEXTS}) where x is null or x = '')::int as missing from {EVENTS}")
def _(spark, d):
    found = profile.profile(dirty_events(spark, d))
    return found.select("rows", "columns", "duplicates", "numeric", "categorical", "date_like", F.size("missing").alias("missing"))


@query("profile_flags", f"with e as (select * from {EVENTS}), q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, count(value) as n from e), o as (select 100.0 * count(*) / max(n) as r from e, q where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)) select 'missing' as kind, 'high' as severity union all select 'outlier', case when round(r, 1) >= 10 then 'high' else 'medium' end from o where r > 0")
def _(spark, d):
    return profile.flags(dirty_events(spark, d))


# sources and column functions


@query("source_csv", "select n_nationkey::int as n_nationkey, n_name, n_regionkey::int as n_regionkey from nation")
def _(spark, d):
    from .lineage import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/nation-{uuid.uuid4().hex}.csv"
    table(spark, d, "nation").write.mode("overwrite").option("header", True).csv(path)
    return tables.load(spark, path)


@query("blank_filled", "select event_id::varchar as event_id, coalesce((case when event_id % 7 <> 0 then user_id end)::varchar, '') as user_id from events")
def _(spark, d):
    return tables.blank_filled(table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id")))


@query("json_rows", "select event_id, (props->>'$.k')::int as k from events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("rows"))
    return tables.from_json_rows(e, "rows", "k int", ["event_id"])


@query("json_lines_out", "select event_id, case when event_id % 3 <> 0 then round(value, 6) end as value from events")
def _(spark, d):
    from .lineage import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}.json"
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    tables.write_json_lines(e, path)
    return rounded(spark.read.schema("event_id long, value double").json(path), 6)


@query("first_rows", "select * from nation order by n_nationkey limit 7")
def _(spark, d):
    return tables.first_rows(table(spark, d, "nation"), "n_nationkey", 7)


@query("numeric_coercion", "select p_partkey, try_cast(t as double) as strict, case when t = '' then 0 else try_cast(t as double) end as blank_zero from (select p_partkey, case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then p_name else p_size::varchar end as t from part)")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("t"))
    return p.select("p_partkey", scalar.to_number(F.col("t")).alias("strict"), scalar.to_number_zero(F.col("t")).alias("blank_zero"))


@query("labels_and_finite", "select event_id, coalesce(nullif(case when event_id % 5 = 0 then '' else event_type end, ''), '(blank)') as label, case when event_id % 4 <> 0 then round(value, 6) end as finite from events")
def _(spark, d):
    e = dirty_events(spark, d).select("event_id", "event_type").join(table(spark, d, "events").select("event_id", "value"), "event_id")
    x = F.when(F.col("event_id") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return e.select("event_id", scalar.label(F.col("event_type")).alias("label"), F.round(scalar.finite(x), 6).alias("finite"))


@query("percentiles", "select round(quantile_cont(l_extendedprice, 0.05), 4) as p05, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.95), 4) as p95 from lineitem")
def _(spark, d):
    return rounded(quantiles.per_value(table(spark, d, "lineitem"), {"price": F.col("l_extendedprice")}, {"p05": 0.05, "p50": 0.5, "p95": 0.95}).drop("column"))


@query("calendar_buckets", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate::date - dayofweek(o_orderdate)::int, '%Y-%m-%d') as week, strftime(o_orderdate, '%Y-%m') as month from orders")
def _(spark, d):
    time = scalar.parse_time(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", *(scalar.calendar_bucket(time, u).alias(n) for u, n in (("D", "day"), ("W", "week"), ("M", "month"))))


_PATHS = ["/auth/verify/x", "/api/y", "/viz/aggregate", "/viz/prepare", "/stat/run", "/ml/run", "/other"]


@query("feature_codes", "select event_id, (['auth.verify', 'api', 'viz.aggregate', 'viz', 'stat', 'ml', 'unknown'])[1 + event_id % 7] as feature, '10.0.0.' || (event_id % 250) as ip from events")
def _(spark, d):
    path = F.array(*map(F.lit, _PATHS))[(F.col("event_id") % 7).cast("int")]
    ip = F.concat(F.when(F.col("event_id") % 2 == 0, "::ffff:").otherwise(""), F.lit("10.0.0."), (F.col("event_id") % 250).cast("string"))
    return table(spark, d, "events").select("event_id", scalar.feature_code(path).alias("feature"), scalar.plain_ip(ip).alias("ip"))


@query("one_hot", "select o_orderkey, (o_orderstatus = 'O')::int as \"o_orderstatus_O\", (o_orderstatus = 'P')::int as \"o_orderstatus_P\" from orders")
def _(spark, d):
    return scalar.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


# selection and sets


@query("known_columns", "select n_name, n_nationkey from nation")
def _(spark, d):
    return quality.known_columns(table(spark, d, "nation"), ["n_name", "absent", "n_nationkey"])


@query("complete_cases", f"select event_id, round(value, 6) as value from {EVENTS} where value is not null")
def _(spark, d):
    return rounded(quality.complete_cases(dirty_events(spark, d).select("event_id", "value")), 6)


@query("any_missing", f"select event_id, value is null as any_missing from {EVENTS}")
def _(spark, d):
    e = dirty_events(spark, d)
    return e.select("event_id", quality.any_missing(e).alias("any_missing"))


@query("large_groups", "select c_custkey, c_nationkey from customer where c_nationkey in (select c_nationkey from customer group by 1 having count(*) >= 60)")
def _(spark, d):
    return quality.large_groups(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 60)


@query("top_per_group", "select o_orderpriority, o_orderkey, rank from (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey)::int as rank from orders) where rank <= 3")
def _(spark, d):
    return describe.ranked(table(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderpriority", "o_orderkey", "rank")


@query("deduplicated_by_key", "select l_returnflag, l_linestatus, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_returnflag, l_linestatus order by l_orderkey, l_linenumber) as k from lineitem) where k = 1")
def _(spark, d):
    keys = ["l_returnflag", "l_linestatus"]
    return describe.ranked(table(spark, d, "lineitem"), keys, [F.col("l_orderkey"), F.col("l_linenumber")], 1).select(*keys, "l_orderkey", "l_linenumber")


@query("thinned", "select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as k from orders) where k in (select (i * (n - 1)) // 1199 from range(1200) t(i), (select count(*) as n from orders))")
def _(spark, d):
    return ranks.thinned(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
