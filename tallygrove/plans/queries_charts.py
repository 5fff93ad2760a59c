"""Queries on chart aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chart
from .queries_tables import EVENTS, dirty_events, rounded
from .registry import query, table


@query("bar_count", "select l_returnflag as x, count(*)::double as y from lineitem group by 1")
def _(spark, d):
    return chart.grouped(table(spark, d, "lineitem"), "l_returnflag")


@query("bar_mean", f"select coalesce(nullif(event_type, ''), '(blank)') as x, round(coalesce(avg(value), 0), 4) as y from {EVENTS} group by 1")
def _(spark, d):
    return rounded(chart.grouped(dirty_events(spark, d), "event_type", "value", "other"))


@query("bar_sum_hue", "select l_linestatus as series, l_returnflag as x, round(sum(l_quantity), 2) as y from lineitem group by all")
def _(spark, d):
    return rounded(chart.grouped(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "sum", "l_linestatus"), 2)


@query("group_raw", f"select case when event_id % 3 > 0 then user_id % 10 end::varchar as x, round(max(value), 6) as y from {EVENTS} group by 1")
def _(spark, d):
    e = dirty_events(spark, d).withColumn("u", F.when(F.col("event_id") % 3 > 0, F.col("user_id") % 10))
    return rounded(chart.grouped_raw(e, "u", "value", "max"), 6)


_HIST = "with e as (select min(c_acctbal) as lo, max(c_acctbal) as hi, (max(c_acctbal) - min(c_acctbal)) / 30 as w from customer), b as (select least(floor((c_acctbal - lo) / w), 29)::int as bin{0}, count(*) as n from customer, e group by all)"


@query("histogram", _HIST.format("") + " select k::int as bin, round(lo + k * w, 6) as lo, round(lo + (k + 1) * w, 6) as hi, coalesce(n, 0)::bigint as count from e cross join range(30) t(k) left join b on b.bin = k")
def _(spark, d):
    return chart.histogram(table(spark, d, "customer"), "c_acctbal")


@query("histogram_hue", _HIST.format(", c_mktsegment as s") + " select s.s as series, k::int as bin, round(lo + k * w, 6) as lo, round(lo + (k + 1) * w, 6) as hi, coalesce(n, 0)::bigint as count from e cross join range(30) t(k) cross join (select distinct c_mktsegment as s from customer) s left join b on b.bin = k and b.s = s.s")
def _(spark, d):
    return chart.histogram(table(spark, d, "customer"), "c_acctbal", 30, "c_mktsegment")


@query("box_quartiles", "select coalesce(o_orderpriority, '(all)') as grp, round(min(o_totalprice), 4) as min, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.75), 4) as q3, round(max(o_totalprice), 4) as max, count(*)::bigint as n from orders group by grouping sets ((o_orderpriority), ())")
def _(spark, d):
    return rounded(chart.quartiles(table(spark, d, "orders"), "o_totalprice", "o_orderpriority", overall=True))


@query("heatmap_2d", """with e as (select min(l_quantity) as al, (max(l_quantity) - min(l_quantity)) / 20 as aw, min(l_extendedprice) as bl, (max(l_extendedprice) - min(l_extendedprice)) / 20 as bw from lineitem),
c as (select least(floor((l_quantity - al) / aw), 19) as i, least(floor((l_extendedprice - bl) / bw), 19) as j, count(*)::bigint as count from lineitem, e group by all)
select round(al + (i + 0.5) * aw, 6) as x, round(bl + (j + 0.5) * bw, 6) as y, count from c, e""")
def _(spark, d):
    return chart.heatmap_numeric(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("heatmap_cat", "with x as (select distinct l_returnflag as x from lineitem), y as (select distinct l_linestatus as y from lineitem) select x, y, (select count(*) from lineitem where l_returnflag = x and l_linestatus = y)::bigint as count from x, y")
def _(spark, d):
    return chart.heatmap_labels(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("heatmap_sum", "select l_linestatus as y, " + ", ".join(f"round(coalesce(sum(l_quantity) filter (l_returnflag = '{f}'), 0), 2) as \"{f}\"" for f in "ANR") + " from lineitem group by 1")
def _(spark, d):
    return rounded(chart.pivoted(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"), 2)


for _unit, _sql in (("D", "strftime(ts, '%Y-%m-%d')"), ("W", "strftime(ts::date - dayofweek(ts)::int, '%Y-%m-%d')"), ("M", "strftime(ts, '%Y-%m')")):

    @query(f"resample_{_unit.lower()}", f"select {_sql} as x, round(avg(value), 6) as y from events group by 1")
    def _(spark, d, unit=_unit):
        return rounded(chart.resampled(table(spark, d, "events"), "ts", "value", unit), 6)


@query("resample_gap", "with b as (select ts::date as x, sum(value) as y from events group by 1), s as (select unnest(generate_series(min(x)::timestamp, max(x)::timestamp, interval 1 day))::date as x from b) select s.x, round(coalesce(y, 0), 4) as y from s left join b using (x)")
def _(spark, d):
    return rounded(chart.resampled_filled(table(spark, d, "events"), "ts", "value"))


@query("resample_week_end", "with b as (select ts::date + ((7 - dayofweek(ts)) % 7)::int as x, sum(value) as y from events group by 1), s as (select unnest(generate_series(min(x)::timestamp, max(x)::timestamp, interval 7 days))::date as x from b) select s.x, round(coalesce(y, 0), 4) as y from s left join b using (x)")
def _(spark, d):
    return rounded(chart.resampled_filled(table(spark, d, "events"), "ts", "value", "W"))


@query("pie", "select o_orderpriority as x, count(*)::double as y, round(count(*) / sum(count(*)) over (), 6) as share from orders group by 1")
def _(spark, d):
    return rounded(chart.shares(table(spark, d, "orders"), "o_orderpriority"), 6)


@query("waterfall", "with s as (select o_orderpriority as x, sum(o_totalprice) as y from orders group by 1) select x, round(y, 2) as y, round(sum(y) over (order by x) - y, 2) as start, round(sum(y) over (order by x), 2) as \"end\" from s")
def _(spark, d):
    return rounded(chart.waterfall(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 2)


@query("area_stacked", "with s as (select o_orderpriority as x, o_orderstatus as series, sum(o_totalprice) as y from orders group by all) select series, x, round(y, 2) as y, round(sum(y) over (partition by x order by series), 2) as top from s")
def _(spark, d):
    return rounded(chart.stacked(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus"), 2)


@query("treemap", "select l_returnflag as parent, l_linestatus as child, round(sum(l_quantity), 2) as value from lineitem group by grouping sets ((l_returnflag), (l_returnflag, l_linestatus))")
def _(spark, d):
    return rounded(chart.treemap(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"), 2)


@query("radar", "with l as (select c_mktsegment as series, c_nationkey::varchar as axis, arg_max(c_acctbal, c_custkey) as y from customer group by all), a as (select distinct axis from l), s as (select distinct series from l) select s.series, a.axis, coalesce(y, 0) as y from s cross join a left join l on l.series = s.series and l.axis = a.axis")
def _(spark, d):
    return chart.radar(table(spark, d, "customer"), "c_nationkey", "c_acctbal", "c_mktsegment", "c_custkey")


@query("sankey", """with l as (select r_name as source, n_name as target, count(*)::double as value from nation join region on n_regionkey = r_regionkey group by all),
n as (select node, (row_number() over (order by node) - 1)::int as k from (select source as node from l union select target from l))
select source, target, a.k as source_number, b.k as target_number, value from l join n a on a.node = source join n b on b.node = target""")
def _(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chart.sankey(joined, "r_name", "n_name")


@query("scatter_thinned", "with r as (select o_custkey as x, o_totalprice as y, row_number() over (order by o_orderkey) - 1 as k, count(*) over () as n from orders), j as (select *, (k * 1199 + n - 2) // (n - 1) as j from r) select x::double as x, round(y, 4)::double as y, 8.0::double as size from j where n <= 1200 or (j * (n - 1)) // 1199 = k")
def _(spark, d):
    return rounded(chart.points(table(spark, d, "orders"), "o_custkey", "o_totalprice", order=["o_orderkey"]))


@query("scatter_points", "select l_quantity as x, round(l_extendedprice, 4) as y, 8.0::double as size from lineitem ")
def _(spark, d):
    return rounded(chart.points(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("chart_figure")
def _(spark, d):
    return chart.figure(chart.aggregate(table(spark, d, "orders"), "pie", "o_orderpriority"), "pie", "Orders by priority")


@query("chart_spec_line", "select strftime(o_orderdate, '%Y-%m') as x, round(sum(o_totalprice), 2) as y from orders group by 1")
def _(spark, d):
    return rounded(chart.aggregate(table(spark, d, "orders"), "line", "o_orderdate", "o_totalprice", agg="sum", resample="M"), 2)
