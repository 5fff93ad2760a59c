"""Queries on correlation, hypothesis tests and least squares."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import describe, ols, recommend, tests_param, tests_rank
from . import report
from .queries_tables import LINE, rounded
from .registry import query, table

_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query("corr_pairs", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r, round(abs(corr({a}, {b})), 6) as abs_r from lineitem" for a, b in _PAIRS))
def _(spark, d):
    return rounded(tests_param.corr(table(spark, d, "lineitem"), LINE), 6)


@query("corr_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, {'max(1.0)' if a == b else f'round(corr({a}, {b}), 6)'}::double as r from lineitem" for a in LINE for b in LINE))
def _(spark, d):
    return tests_param.corr_matrix(table(spark, d, "lineitem"), LINE)


_TWO = "with g as (select o_orderstatus as s, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders where o_orderstatus in ('F', 'O') group by 1), x as (select a.n as n1, b.n as n2, a.m as m1, b.m as m2, a.v as v1, b.v as v2 from g a, g b where a.s = 'F' and b.s = 'O')"


def _two(spark, d):
    return table(spark, d, "orders").where("o_orderstatus in ('F', 'O')")


@query("ttest_welch", _TWO + " select n1::bigint as n_a, n2::bigint as n_b, round(m1, 4) as mean_a, round(m2, 4) as mean_b, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) as df, round((m1 - m2) / sqrt((v1 + v2) / 2), 6) as cohen_d from x")
def _(spark, d):
    r = tests_param.ttest(_two(spark, d), "o_totalprice", "o_orderstatus")
    return r.select("n_a", "n_b", *(F.round(c, n).alias(c) for c, n in (("mean_a", 4), ("mean_b", 4), ("t", 6), ("df", 4), ("cohen_d", 6))))


@query("ttest_student", _TWO + " select round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) as t, (n1 + n2 - 2)::double as df from x")
def _(spark, d):
    return tests_param.ttest(_two(spark, d), "o_totalprice", "o_orderstatus", equal_var=True).select(F.round("t", 6).alias("t"), "df")


_CELLS = "with c as (select l_returnflag as a, l_linestatus as b, count(*) as o from lineitem group by all), r as (select a, sum(o) as r from c group by a), k as (select b, sum(o) as k from c group by b), n as (select sum(o) as n from c), t as (select r.a, k.b, coalesce(o, 0) as o, r * k / n as e, n from r cross join k cross join n left join c on c.a = r.a and c.b = k.b)"


@query("contingency", _CELLS + " select a, b, o::bigint as observed, round(e, 6) as expected from t")
def _(spark, d):
    return rounded(tests_param.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), 6)


@query("chisq", _CELLS + ", s as (select sum((o - e) ** 2 / e) as x, max(n) as n, count(distinct a) as ka, count(distinct b) as kb from t) select round(x, 6) as chi2, ((ka - 1) * (kb - 1))::bigint as dof, n::bigint as n, round(sqrt(x / (n * (least(ka, kb) - 1))), 6) as cramers_v from s")
def _(spark, d):
    r = tests_param.chisq(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return r.select(F.round("chi2", 6).alias("chi2"), "dof", "n", F.round("cramers_v", 6).alias("cramers_v"))


@query("chisq_yates", """with c as (select (l_quantity > 25)::varchar as a, l_linestatus as b, count(*)::double as o from lineitem group by all), n as (select sum(o) as n from c),
t as (select o, sum(o) over (partition by a) * sum(o) over (partition by b) / n as e, n from c, n) select round(sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e), 6) as chi2, 1::bigint as dof from t""")
def _(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("string").alias("a"), F.col("l_linestatus").alias("b"))
    return tests_param.chisq(x, "a", "b").select(F.round("chi2", 6).alias("chi2"), "dof")


@query("cramers_v_limits")
def _(spark, d):
    return tests_param.chisq(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select("cramers_v", "v_low", "v_high")


_ANOVA = "with g as (select o_orderpriority as g, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1), a as (select count(*) as k, sum(n) as n, sum(n * m) / sum(n) as mm from g), s as (select k, a.n, sum(g.n * (m - mm) ** 2) as b, sum((g.n - 1) * v) as w from g, a group by all)"


@query("anova", _ANOVA + " select round(b / (k - 1) / (w / (n - k)), 8) as f, (k - 1)::bigint as df_between, (n - k)::bigint as df_within, round(b / (b + w), 8) as eta_squared from s")
def _(spark, d):
    r = tests_param.anova(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return r.select(F.round("f", 8).alias("f"), "df_between", "df_within", F.round("eta_squared", 8).alias("eta_squared"))


@query("anova_groups", "select o_orderpriority as grp, count(*)::bigint as n, round(avg(o_totalprice), 4) as mean, round(var_samp(o_totalprice), 2) as var from orders group by 1")
def _(spark, d):
    g = tests_param.group_moments(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return g.select("grp", "n", F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"))


@query("eta_squared_limits")
def _(spark, d):
    return tests_param.eta_squared_limits(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")


@query("jarque_bera", "with m as (select avg(value) as m, count(value) as n from events), s as (select n, avg((value - m) ** 2) as m2, avg((value - m) ** 3) as m3, avg((value - m) ** 4) as m4 from events, m group by n) select n::bigint as n, round(n / 6.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4), 4) as jarque_bera, (select round(avg(value), 6) from events) as mean, (select round(stddev_samp(value), 6) from events) as sd, (select round(skewness(value), 6) from events) as skewness, (select round(kurtosis(value), 6) from events) as kurtosis from s")
def _(spark, d):
    found = tests_param.normality(table(spark, d, "events"), "value", shapiro_most=0)
    return found.select("n", F.round("jarque_bera", 4).alias("jarque_bera"), *(F.round(c, 6).alias(c) for c in ("mean", "sd", "skewness", "kurtosis")))


@query("shapiro")
def _(spark, d):
    return tests_param.normality(table(spark, d, "customer"), "c_acctbal").select("n", "shapiro_w", "shapiro_p")


_SHARES = [round(0.01 + k * 0.98 / 99, 10) for k in range(100)]
_LISTS = [", ".join(f"{v!r}::double" for v in values) for values in (_SHARES, [NormalDist().inv_cdf(p) for p in _SHARES])]


@query("qq_sample", f"select p, round(m + s * z, 4) as theoretical, round(q, 4) as sample from (select avg(value) as m, stddev_samp(value) as s, unnest([{_LISTS[0]}]) as p, unnest([{_LISTS[1]}]) as z, unnest(quantile_cont(value, [{_LISTS[0].replace('::double', '')}])) as q from events)")
def _(spark, d):
    return tests_param.qq_points(table(spark, d, "events"), "value").select("p", F.round("theoretical", 4).alias("theoretical"), F.round("sample", 4).alias("sample"))


@query("ci_mean", "select count(value)::bigint as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(stddev_samp(value) / sqrt(count(value)), 8) as se from events")
def _(spark, d):
    r = tests_param.ci_mean(table(spark, d, "events"), "value")
    return r.select("n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("se", 8).alias("se"))


_RANKED = "with x as (select {g} as g, {v} as v from {t} where {w}), r as (select g, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from x), s as (select g, count(*) as n, sum(r) as r from r group by g)"


@query("mannwhitney", _RANKED.format(g="o_orderstatus", v="o_totalprice", t="orders", w="o_orderstatus in ('F', 'O')") + " select a.n::bigint as n_a, b.n::bigint as n_b, (a.r - a.n * (a.n + 1) / 2)::double as u, round((a.r - a.n * (a.n + 1) / 2) / (a.n * b.n), 6)::double as cles from s a, s b where a.g = 'F' and b.g = 'O'")
def _(spark, d):
    return tests_rank.mannwhitney(_two(spark, d), "o_totalprice", "o_orderstatus").select("n_a", "n_b", "u", F.round("cles", 6).alias("cles"))


@query("wilcoxon", "with d as (select round(l_tax * 100) - round(l_discount * 100) as d from lineitem), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from d where d <> 0) select count(*)::bigint as n, sum(r) filter (d > 0)::double as rank_plus, sum(r) filter (d < 0)::double as rank_minus, least(sum(r) filter (d > 0), sum(r) filter (d < 0))::double as w, any_value(p)::bigint as n_pairs, round(abs(least(sum(r) filter (d > 0), sum(r) filter (d < 0)) - any_value(p) * (any_value(p) + 1) / 4) / sqrt(any_value(p)::double * (any_value(p) + 1) * (2 * any_value(p) + 1) / 24) / sqrt(any_value(p)), 6) as r_approx from r, (select count(*) as p from d)")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.round(F.col("l_tax") * 100).alias("a"), F.round(F.col("l_discount") * 100).alias("b"))
    return tests_rank.wilcoxon(x, "a", "b").select("n", "rank_plus", "rank_minus", "w", "n_pairs", F.round("r_approx", 6).alias("r_approx"))


@query("kruskal", _RANKED.format(g="o_orderpriority", v="o_totalprice", t="orders", w="true") + ", t as (select sum(c ** 3 - c) as t from (select count(*)::double as c from x group by v)), h as (select sum(n) as n, count(*) as k, 12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1) as h from s) select round(h / (1 - t / (n ** 3 - n)), 5)::double as h, (k - 1)::bigint as df, n::bigint as n from h, t")
def _(spark, d):
    return tests_rank.kruskal(table(spark, d, "orders"), "o_totalprice", "o_orderpriority").select(F.round("h", 5).alias("h"), "df", "n")


@query("average_ranks", "select distinct p_size::double as v, count(*) over (partition by p_size)::bigint as ties, (rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0)::double as rank from part")
def _(spark, d):
    from ..operators.ranks import average_ranks

    return average_ranks(table(spark, d, "part").select(F.col("p_size").cast("double").alias("v")), "v")


@query("tukey_diffs", "with g as (select o_orderpriority as g, avg(o_totalprice) as m from orders group by 1) select a.g as group_a, b.g as group_b, round(b.m - a.m, 4) as diff from g a join g b on a.g < b.g")
def _(spark, d):
    return tests_param.tukey(table(spark, d, "orders"), "o_totalprice", "o_orderpriority").select("group_a", "group_b", F.round("diff", 4).alias("diff"))


@query("pairwise_welch", "with g as (select o_orderpriority as g, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1) select a.g as group_a, b.g as group_b, round(a.m - b.m, 4) as diff, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) as t from g a join g b on a.g < b.g")
def _(spark, d):
    return tests_param.pairwise_adjusted(table(spark, d, "orders"), "o_totalprice", "o_orderpriority").select("group_a", "group_b", F.round("diff", 4).alias("diff"), F.round("t", 6).alias("t"))


_P = "with p as (select p_brand as k, (min(p_partkey) * 37 % 1000 + 1) / 20000.0 as p from part group by 1), r as (select k, p, row_number() over (order by p, k) as i, count(*) over () as m from p)"


def _p(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(((F.min("p_partkey") * 37 % 1000 + 1) / 20000.0).alias("p"))


def _adjusted_query(name, method, expression):
    @query(f"adjust_{name}", f"{_P} select k, round(least(1.0, {expression}), 8) as p_adj from r")
    def _(spark, d):
        return tests_param.adjusted(_p(spark, d), "p", method).select("k", F.round("p_adj", 8).alias("p_adj"))


_adjusted_query("bonferroni", "bonferroni", "p * m")
_adjusted_query("holm", "holm", "max(p * (m - i + 1)) over (order by i)")
_adjusted_query("fdr_bh", "fdr_bh", "min(p * m / i) over (order by i desc)")


@query("ols_1", "select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from lineitem".replace("select", "select round(s, 4) as slope, round(i, 3) as intercept, round(r, 8) as r2 from (select", 1).replace(" as i from", " as i, regr_r2(l_extendedprice, l_quantity) as r from") + ")")
def _(spark, d):
    fit = ols.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    c = {t: float(v) for t, v in zip(fit.terms, fit.coef, strict=True)}
    return fit.summary().select(F.round(F.lit(c["l_quantity"]), 4).alias("slope"), F.round(F.lit(c["const"]), 3).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("ols_2", """with m as (select covar_samp(l_quantity, l_quantity) as aa, covar_samp(l_quantity, l_discount) as ab, covar_samp(l_discount, l_discount) as bb, covar_samp(l_quantity, l_extendedprice) as ay, covar_samp(l_discount, l_extendedprice) as by_, avg(l_quantity) as ma, avg(l_discount) as mb, avg(l_extendedprice) as my from lineitem),
c as (select (ay * bb - by_ * ab) / (aa * bb - ab * ab) as p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as q, * from m)
select 'const' as term, round(my - p * ma - q * mb, 2) as coef from c union all select 'l_quantity', round(p, 2) from c union all select 'l_discount', round(q, 2) from c""")
def _(spark, d):
    return ols.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).coefficients().select("term", F.round("coef", 2).alias("coef"))


@query("breusch_pagan", """with b as (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from lineitem),
e as (select l_quantity as x, (l_extendedprice - i - s * l_quantity) ** 2 as e2 from lineitem, b) select round(count(*) * regr_r2(e2, x), 3) as lm from e""")
def _(spark, d):
    return ols.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]).breusch_pagan().select(F.round("lm", 3).alias("lm"))


@query("ols_robust")
def _(spark, d):
    return ols.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_returnflag"], robust="HC3").coefficients()


@query("ols_diagnostics", """with b as (select regr_slope(o_totalprice, o_custkey) as s, regr_intercept(o_totalprice, o_custkey) as i, avg(o_custkey) as m, regr_sxx(o_totalprice, o_custkey) as sxx, count(*) as n from orders),
e as (select o_totalprice - i - s * o_custkey as e, 1.0 / n + (o_custkey - m) ** 2 / sxx as h, n from orders, b), v as (select sum(e * e) / (max(n) - 2) as s2 from e)
select round(max(e * e / (s2 * (1 - h)) * h / ((1 - h) * 2)), 8) as most_cook, round(sum(h), 6) as leverage_sum from e, v""")
def _(spark, d):
    found = ols.ols(table(spark, d, "orders"), "o_totalprice", ["o_custkey"]).diagnostics()
    return found.agg(F.round(F.max("cooks_distance"), 8).alias("most_cook"), F.round(F.sum("leverage"), 6).alias("leverage_sum"))


_RECOMMENDED = """with n as (select count(distinct o_orderstatus) as n from orders), r as (
select 90 as p, 'describe' as op, 'Description' as label, 'o_totalprice' as x_hint, '{}' as args_json, true as fits union all select 80, 'corr', 'Correlations', 'o_totalprice', '{}', true
union all select 30, 'chisq', 'Chi-square test', 'o_orderstatus', '{"a":"o_orderstatus","b":"o_orderpriority"}', true union all select 30, 'wilcoxon', 'Signed-rank test', 'o_totalprice', '{"a":"o_totalprice","b":"o_custkey"}', true
union all select 35, 'ols', 'Least squares', 'o_custkey', '{"x":["o_custkey"],"y":"o_totalprice"}', true union all select 40, 'normality', 'Normality', 'o_totalprice', '{"column":"o_totalprice"}', true
union all select 45, 'ci_mean', 'Interval of the mean', 'o_totalprice', '{"column":"o_totalprice","confidence":0.95}', true
union all select 10, case n when 2 then 'ttest' else 'anova' end, case n when 2 then 't-test' else 'Analysis of variance' end, 'o_orderstatus', '{"group":"o_orderstatus","value":"o_totalprice"}', n >= 2 from n
union all select 15, case n when 2 then 'mannwhitney' else 'kruskal' end, case n when 2 then 'Rank-sum test' else 'Rank test of several groups' end, 'o_orderstatus', '{"group":"o_orderstatus","value":"o_totalprice"}', n >= 2 from n
union all select 20, 'tukey', 'Pairs after Tukey', 'o_orderstatus', '{"alpha":0.05,"group":"o_orderstatus","value":"o_totalprice"}', n > 2 from n
union all select 25, 'pairwise_adjusted', 'Adjusted pairs', 'o_orderstatus', '{"group":"o_orderstatus","pAdjust":"holm","value":"o_totalprice"}', n > 2 from n)
select row_number() over (order by p, op)::int as rank, op, label, x_hint, args_json from r where fits"""


@query("recommend_tests", _RECOMMENDED)
def _(spark, d):
    found = recommend.recommend(table(spark, d, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey"))
    return found.select("rank", "op", "label", "x_hint", "args_json")


@query("report_describe", "select 'l_tax' as \"column\", round(avg(l_tax), 6) as mean from lineitem")
def _(spark, d):
    tables = report.run(table(spark, d, "lineitem").select("l_tax"), "describe").tables
    return tables["numeric"].select("column", F.round("mean", 6).alias("mean"))


@query("constant_columns", "select \"column\" from (select 'flat' as \"column\", min(o_custkey - o_custkey) as low, max(o_custkey - o_custkey) as high from orders union all select 'o_custkey', min(o_custkey), max(o_custkey) from orders union all select 'o_orderkey', min(o_orderkey), max(o_orderkey) from orders) where low = high")
def _(spark, d):
    x = table(spark, d, "orders").select((F.col("o_custkey") - F.col("o_custkey")).alias("flat"), "o_custkey", "o_orderkey")
    return spark.createDataFrame([(c,) for c in ols.constant_columns(x, x.columns)], "column string")
