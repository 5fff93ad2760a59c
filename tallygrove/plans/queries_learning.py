"""Queries on learning, clusters, anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, learning, series
from .queries_tables import rounded
from .registry import query, table


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def _flags(spark, d):
    """Two classes: returned or not."""
    return _lines(spark, d).withColumn("returned", F.when(F.col("l_returnflag") == "R", "yes").otherwise("no")).withColumn("row_key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def _labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")


@query("feature_matrix", "select l_orderkey, l_linenumber, l_quantity, (l_returnflag = 'N')::double as \"flag_N\", (l_returnflag = 'R')::double as \"flag_R\" from lineitem")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows, _, names = learning.features(_lines(spark, d), ["l_quantity", "l_returnflag"])
    v = vector_to_array("features")
    return rows.select("l_orderkey", "l_linenumber", v[0].alias("l_quantity"), *(v[names.index(f"l_returnflag_{x}")].alias(f"flag_{x}") for x in "NR"))


@query("holdout_counts")
def _(spark, d):
    train, test = learning.holdout(_lines(spark, d), ["l_orderkey", "l_linenumber"])
    return train.agg(F.count(F.lit(1)).alias("train")).crossJoin(F.broadcast(test.agg(F.count(F.lit(1)).alias("test"))))


@query("fold_counts")
def _(spark, d):
    return learning.folds(table(spark, d, "orders"), "o_orderkey").groupBy("fold").count()


@query("lin_reg_coefficients", "select round(regr_slope(l_extendedprice, l_quantity), 3) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem")
def _(spark, d):
    from pyspark.ml.regression import LinearRegression

    rows, _, _ = learning.features(_lines(spark, d), ["l_quantity"], "l_extendedprice")
    fitted = LinearRegression(labelCol="l_extendedprice", solver="normal").fit(rows)
    return learning.regression_metrics(fitted.transform(rows), "l_extendedprice").select(F.round(F.lit(float(fitted.coefficients[0])), 3).alias("slope"), F.round(F.lit(float(fitted.intercept)), 2).alias("intercept"), F.round("r2", 6).alias("r2"))


_KEYED = "(select l_orderkey, l_linenumber, l_extendedprice as actual, 1500 * l_quantity as prediction from lineitem)"
_PREDICTED = "(select l_extendedprice as actual, 1500 * l_quantity as prediction from lineitem)"


def _guess(spark, d):
    return _lines(spark, d).select(F.col("l_extendedprice").alias("actual"), (1500 * F.col("l_quantity")).alias("prediction"))


@query("regression_metrics", f"select count(*)::bigint as n, round(avg(abs(actual - prediction)), 4) as mae, round(sqrt(avg((actual - prediction) ** 2)), 4) as rmse, round(1 - avg((actual - prediction) ** 2) / var_pop(actual), 6) as r2 from {_PREDICTED}")
def _(spark, d):
    return learning.regression_metrics(_guess(spark, d)).select("n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("residual_summary", f"select round(min(e), 4) as min, round(list_sort(list(e))[(1 + round_even((count(*) - 1) * 0.05, 0))::int], 4) as q05, round(list_sort(list(e))[(1 + count(*) // 2)::int], 4) as median, round(list_sort(list(e))[(1 + round_even((count(*) - 1) * 0.95, 0))::int], 4) as q95, round(max(e), 4) as max from (select actual - prediction as e from {_PREDICTED})")
def _(spark, d):
    return rounded(learning.residual_summary(_guess(spark, d)))


@query("largest_residuals", f"select l_orderkey, l_linenumber, round(abs(actual - prediction), 4) as off from (select *, row_number() over (order by abs(actual - prediction) desc, l_orderkey * 10 + l_linenumber) as k from {_KEYED}) where k <= 10")
def _(spark, d):
    guess = _lines(spark, d).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_extendedprice").alias("actual"), (1500 * F.col("l_quantity")).alias("prediction"))
    found = learning.largest_residuals(guess, "key")
    return found.select(F.floor(F.col("key") / 10).alias("l_orderkey"), (F.col("key") % 10).cast("int").alias("l_linenumber"), F.round(F.abs("residual"), 4).alias("off"))


_CALLED = "(select l_returnflag as a, case when l_quantity > 30 then 'N' when l_quantity > 10 then 'A' else 'R' end as p from lineitem)"


def _called(spark, d):
    q = F.col("l_quantity")
    return _lines(spark, d).select(F.col("l_returnflag").alias("actual"), F.when(q > 30, "N").when(q > 10, "A").otherwise("R").alias("prediction"))


@query("confusion", f"select x.v as actual, y.v as predicted, (select count(*) from {_CALLED} where a = x.v and p = y.v)::bigint as n from (select unnest(['A', 'N', 'R']) as v) x, (select unnest(['A', 'N', 'R']) as v) y")
def _(spark, d):
    return learning.confusion(_called(spark, d))


@query("weighted_prf", f"""with c as (select v, (select count(*) from {_CALLED} where a = v) as s, (select count(*) from {_CALLED} where p = v) as c, (select count(*) from {_CALLED} where a = v and p = v) as h from (select unnest(['A', 'N', 'R']) as v)),
m as (select s, h, h / c as p, h / s as r from c) select round(sum(h) / sum(s), 6) as accuracy, round(sum(p * s) / sum(s), 6) as precision, round(sum(r * s) / sum(s), 6) as recall, round(sum(2 * p * r / (p + r) * s) / sum(s), 6) as f1 from m""")
def _(spark, d):
    return rounded(learning.classification_metrics(_called(spark, d)), 6)


@query("metric_contract", f"with m as (select avg(abs(actual - prediction)) as mae, avg((actual - prediction) ** 2) as mse, sqrt(avg((actual - prediction) ** 2)) as rmse, 1 - avg((actual - prediction) ** 2) / var_pop(actual) as r2 from {_PREDICTED}) select 'mae' as metric, round(mae, 4) as value, 'lower' as goal, false as is_primary from m union all select 'rmse', round(rmse, 4), 'lower', false from m union all select 'mse', round(mse, 4), 'lower', false from m union all select 'r2', round(r2, 4), 'higher', true from m")
def _(spark, d):
    return rounded(learning.metric_contract(learning.regression_metrics(_guess(spark, d)), "r2"))


for _model in ("linear", "elastic_net", "decision_tree", "random_forest", "gradient_boosting", "voting"):

    @query(f"regression_{_model}")
    def _(spark, d, model=_model):
        rows = _flags(spark, d).select("row_key", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
        return learning.train(rows, "regression", model, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "row_key", preset="fast").metrics


for _model in ("logistic", "decision_tree", "random_forest", "gradient_boosting", "naive_bayes", "linear_svm", "mlp", "adaboost", "voting"):

    @query(f"classification_{_model}")
    def _(spark, d, model=_model):
        return learning.train(_labelled(spark, d), "classification", model, "quality", ["n_chars"], "doc_id", preset="fast").metrics


@query("calibrated_classifier")
def _(spark, d):
    rows, _, _ = learning.features(_labelled(spark, d), ["n_chars"], "quality")
    train, test = learning.holdout(rows.withColumn("label", F.col("quality").cast("double")), "doc_id")
    return learning.calibrated(train.select("label", "features", "doc_id"), test.select("label", "features", "doc_id"), "doc_id").select("doc_id", "calibrated", "prediction")


@query("feature_importance")
def _(spark, d):
    return learning.train(_flags(spark, d), "regression", "random_forest", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "row_key", preset="fast").importance


@query("permutation_importance")
def _(spark, d):
    result = learning.train(_flags(spark, d), "regression", "linear", "l_extendedprice", ["l_quantity", "l_discount"], "row_key")
    score = lambda p: learning.regression_metrics(p, "label").first().r2
    return learning.permutation_importance(result.fitted, result.predictions.select("label", "l_quantity", "l_discount"), ["l_quantity", "l_discount"], ["l_quantity", "l_discount"], score)


@query("cross_validation")
def _(spark, d):
    return learning.cross_validate(_flags(spark, d), "regression", "linear", "l_extendedprice", ["l_quantity", "l_discount"], "row_key", 3).summary


_FOLDS = "(select o_orderkey % 7 as fold, avg(o_totalprice) as score from orders group by 1)"


@query("cv_summary", f"select count(*)::bigint as folds, 'r2' as scoring, round(avg(score), 4) as mean, round(stddev_pop(score), 4) as std, round(min(score), 4) as min, round(max(score), 4) as max from {_FOLDS}")
def _(spark, d):
    scores = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 7).alias("fold")).agg(F.avg("o_totalprice").alias("score"))
    return rounded(learning.cv_summary(scores, "r2"))


@query("gaussian_nb", """with g as (select quality as k, count(*) as n, avg(n_chars) as m, var_pop(n_chars) + 1e-9 * (select var_pop(n_chars) from labels join documents using (doc_id)) as v from labels join documents using (doc_id) group by 1),
s as (select doc_id, k, ln(n / sum(n) over (partition by doc_id)) - 0.5 * ln(2 * pi() * v) - (n_chars - m) ** 2 / (2 * v) as l from labels join documents using (doc_id), g)
select doc_id, arg_max(k, l) as prediction from s group by 1""")
def _(spark, d):
    rows = _labelled(spark, d)
    return learning.gaussian_naive_bayes(rows, rows, ["n_chars"], "quality", "doc_id")


@query("knn", """with t as (select doc_id, n_chars::double as x, quality::varchar as l, doc_id % 5 = 0 as test from labels join documents using (doc_id)),
n as (select a.doc_id, b.l, row_number() over (partition by a.doc_id order by abs(a.x - b.x), b.doc_id) as k from t a join t b on a.test and not b.test),
v as (select doc_id, l, count(*) as v from n where k <= 5 group by all)
select doc_id, l as prediction from (select *, row_number() over (partition by doc_id order by v desc, l) as r from v) where r = 1""")
def _(spark, d):
    rows = _labelled(spark, d)
    test = F.col("doc_id") % 5 == 0
    return learning.knn_classify(rows.where(~test), rows.where(test), ["n_chars"], "quality", "doc_id")


_XY = "select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings"


def _xy(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


@query("dbscan", f"""with recursive p as ({_XY}), n as (select a.vec_id as a, b.vec_id as b from p a join p b on (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.02 * 0.02),
c as (select a from n group by a having count(*) >= 4), l as (select n.a, n.b from n join c on n.a = c.a join c e on n.b = e.a),
r as (select a, a as r from c union select l.b, r.r from r join l on l.a = r.a), k as (select a, min(r) as k from r group by a),
o as (select n.a, min(k.k) as k from n join k on n.b = k.a where n.a not in (select a from c) group by 1)
select p.vec_id, coalesce(k.k, o.k, -1)::bigint as cluster from p left join k on k.a = p.vec_id left join o on o.a = p.vec_id""")
def _(spark, d):
    return learning.dbscan(_xy(spark, d), "vec_id", ["x", "y"], 0.02, 4)


@query("kmeans")
def _(spark, d):
    rows, _, _ = learning.kmeans(_xy(spark, d), ["x", "y"], 3)
    return rows.select("vec_id", "cluster")


@query("cluster_sizes", "select label as cluster, count(*)::bigint as size, round(count(*) / sum(count(*)) over (), 6) as ratio from embeddings group by 1")
def _(spark, d):
    return rounded(learning.cluster_summary(_xy(spark, d).withColumnRenamed("label", "cluster")), 6)


@query("silhouette", """with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, label as l from embeddings), s as (select l as k, count(*) as n from p group by 1),
d as (select a.vec_id, a.l, b.l as k, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as d from p a, p b group by all),
a as (select vec_id, max(d / greatest(n - 1, 1)) filter (d.l = d.k) as a, min(d / n) filter (d.l <> d.k) as b, max(n) filter (d.l = d.k) as n from d join s using (k) group by 1)
select round(avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from a""")
def _(spark, d):
    return rounded(learning.silhouette(_xy(spark, d), ["x", "y"], "label"), 6)


@query("silhouette_squared", f"""with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, label as l from embeddings), s as (select l as k, count(*) as n, avg(x) as mx, avg(y) as my, avg(x * x + y * y) as q from p group by 1),
d as (select p.vec_id, p.l, k, n, (x * x + y * y - 2 * (x * mx + y * my) + q) * case when k = l then n / greatest(1, n - 1) else 1 end as d from p, s),
a as (select vec_id, max(d) filter (k = l) as a, min(d) filter (k <> l) as b, max(n) filter (k = l) as n from d group by 1) select round(avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from a""")
def _(spark, d):
    return rounded(learning.silhouette_squared(_xy(spark, d), ["x", "y"], "label"), 6)


@query("pca_ratios")
def _(spark, d):
    return learning.pca(_lines(spark, d), ["l_quantity", "l_extendedprice", "l_discount"], 2)[1]


@query("isolation_forest")
def _(spark, d):
    return learning.isolation_forest(_xy(spark, d), ["x", "y"], 0.05, key=["vec_id"]).select("vec_id", "score", "outlier")


@query("outliers_by_share", "select o_orderkey, o_totalprice > (select quantile_cont(o_totalprice, 0.95) from orders) as outlier from orders")
def _(spark, d):
    return clusters.above_share(table(spark, d, "orders"), "o_totalprice", 0.05).select("o_orderkey", "outlier")


@query("reconstruction_anomalies")
def _(spark, d):
    return learning.reconstruction_anomalies(_xy(spark, d), ["x", "y"], 1).select("vec_id", "error", "outlier")


def _daily(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.to_timestamp(F.to_date("ts")).alias("day")).agg(F.round(F.sum("value"), 6).alias("y"))


_SERIES = "with s as (select event_type, ts::date as t, round(sum(value), 6) as y from events group by all), r as (select *, row_number() over (partition by event_type order by t) as k, count(*) over (partition by event_type) as n from s)"


@query("series_prepared", _SERIES + " select event_type, (k - 1)::int as k, round(y, 4) as y, n::bigint as n, least(5, n)::int as h from r where n >= 12")
def _(spark, d):
    return series.prepared(_daily(spark, d), "day", "y", ["event_type"], 5).select("event_type", "k", F.round("y", 4).alias("y"), "n", "h")


@query("forecast_naive", _SERIES + " select event_type, (k - n + 5)::int as step, round(y, 4) as actual, round((select y from r b where b.event_type = r.event_type and b.k = b.n - 5), 4) as forecast from r where n >= 12 and k > n - 5")
def _(spark, d):
    return rounded(series.forecast(_daily(spark, d), "day", "y", ["event_type"], "naive", 5))


@query("forecast_moving_avg", _SERIES.replace("with s", "with recursive s") + """, f as (select event_type, 0 as step, list(y order by k) as past from r where n >= 12 and k > n - 5 - 4 and k <= n - 5 group by all
union all select event_type, step + 1, list_append(past, list_sum(past[-4:]) / 4) from f where step < 5)
select f.event_type, f.step::int as step, round(r.y, 4) as actual, round(f.past[-1], 4) as forecast from f join r on r.event_type = f.event_type and r.k = r.n - 5 + f.step where f.step > 0""")
def _(spark, d):
    return rounded(series.forecast(_daily(spark, d), "day", "y", ["event_type"], "moving_avg", 5, window=4))


@query("forecast_history", "with s as (select ts::date as t, round(sum(value), 6) as y from events group by all), r as (select *, row_number() over (order by t) as k, count(*) over () as n from s) select t::timestamp::varchar as t, round(y, 4) as y from r where n >= 12 and k > n - 20")
def _(spark, d):
    daily = table(spark, d, "events").groupBy(F.to_timestamp(F.to_date("ts")).alias("day")).agg(F.round(F.sum("value"), 6).alias("y"))
    return rounded(series.history_tail(daily, "day", "y", horizon=5)).withColumn("t", F.col("t").cast("string"))


for _model in ("exp_smoothing", "ar"):

    @query(f"forecast_{_model}")
    def _(spark, d, model=_model):
        return series.forecast(_daily(spark, d), "day", "y", ["event_type"], model, 5)


@query("forecast_metrics", _SERIES + ", f as (select event_type, y - (select y from r b where b.event_type = r.event_type and b.k = b.n - 5) as e, y from r where n >= 12 and k > n - 5) select event_type, count(*)::bigint as n, round(avg(abs(e)), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse, round(avg(abs(e / y)), 4) as mape, round(list_sort(list(e))[(1 + round_even((count(*) - 1) * 0.05, 0))::int], 4) as q05, round(list_sort(list(e))[(1 + round_even((count(*) - 1) * 0.95, 0))::int], 4) as q95 from f group by 1")
def _(spark, d):
    return rounded(series.forecast_metrics(series.forecast(_daily(spark, d), "day", "y", ["event_type"], "naive", 5), ["event_type"]))
