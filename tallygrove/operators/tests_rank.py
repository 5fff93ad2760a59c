"""Rank tests. Ranks come from counts of distinct values, so no window runs over all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.scalar import to_number
from ..plans.lineage import checkpointed
from .ranks import cumulated, tied_ranks
from .tests_param import _row

MANNWHITNEY = "group_a string, group_b string, n_a long, n_b long, u double, u_other double, rank_sum_a double, p double, cles double, warning string"


def _rank_sums(df: DataFrame, value: str, group: str, least: int = 1) -> DataFrame:
    """grp, n, rank_sum and ties (its part of the sum of t^3 - t over tied values) of each group with at least so many values.

    All comes from one table of how often each group has each value.
    """
    rows = df.select(F.col(group).cast("string").alias("grp"), to_number(F.col(value)).alias("x")).where("grp is not null and x is not null")
    counts = checkpointed(rows.groupBy("grp", "x").agg(F.count(F.lit(1)).alias("n")))
    if least > 1:
        large = counts.groupBy("grp").agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).select("grp")
        counts = counts.join(large, "grp", "left_semi")
    t = F.col("ties").cast("double")
    return tied_ranks(counts, "x").groupBy("grp").agg(F.sum(F.col("n") * F.col("rank")).alias("rank_sum"), F.sum((t * t - 1) * F.col("n")).alias("ties"), F.sum("n").alias("n"))


def mannwhitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the first group, two-sided p (exact for up to 8 values a group without ties) and CLES = U / (n1 n2)."""
    groups = sorted(_rank_sums(df, value, group).select("grp", "n", "rank_sum", "ties").limit(3).collect())
    if len(groups) != 2:
        return _row(df, {"warning": "The test needs two groups."}, MANNWHITNEY)
    a, b = groups
    if min(a.n, b.n) < 2:
        return _row(df, {"group_a": a.grp, "group_b": b.grp, "n_a": a.n, "n_b": b.n, "warning": "The test needs two values in each group."}, MANNWHITNEY)
    n, product = a.n + b.n, a.n * b.n
    u = a.rank_sum - a.n * (a.n + 1) / 2
    ties = a.ties + b.ties
    top = max(u, product - u)
    if ties == 0 and min(a.n, b.n) <= 8 and n <= 200:
        p = min(1.0, 2 * special.mannwhitney_exact_sf(top, a.n, b.n))
    else:
        sd = math.sqrt(product / 12 * ((n + 1) - ties / (n * (n - 1))))
        p = min(1.0, 2 * special.norm_sf((top - product / 2 - 0.5) / sd)) if sd > 0 else 1.0
    return _row(df, {"group_a": a.grp, "group_b": b.grp, "n_a": a.n, "n_b": b.n, "u": u, "u_other": product - u, "rank_sum_a": float(a.rank_sum), "p": p, "cles": u / product}, MANNWHITNEY)


def _median(counts: DataFrame, n: int) -> float:
    """Of n values d, counted."""
    places = F.array(*(F.lit(p) for p in ((n - 1) // 2, n // 2)))
    held = F.exists(places, lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))
    return cumulated(counts, [], "d").where(held).agg(((F.min("d") + F.max("d")) / 2).alias("m")).first().m


WILCOXON = "n_pairs long, n long, w double, rank_plus double, rank_minus double, p double, r_approx double, mean_diff double, median_diff double, warning string"


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed ranks of the n differences a - b that aren't 0 (exact for up to 25 without ties).

    r_approx is the normal deviate of w over the root of the pairs, both with all n_pairs pairs.
    """
    counts = df.select((to_number(F.col(a)) - to_number(F.col(b))).alias("d")).where("d is not null").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts.withColumn("d", F.col("d") + 0.0))
    d = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean"), F.max(F.abs("d")).alias("largest")).first()
    if d.n < 5:
        return _row(df, {"n_pairs": d.n, "warning": "The test needs five pairs."}, WILCOXON)
    if d.largest <= 1e-8:
        return _row(df, {"n_pairs": d.n, "n": 0, "warning": "All differences are 0."}, WILCOXON)
    signed = counts.where("d <> 0").groupBy(F.abs("d").alias("x")).agg(F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("plus"), F.sum("n").alias("n"))
    minus = F.col("n") - F.col("plus")
    s = tied_ranks(signed, "x").agg(F.sum(F.col("plus") * F.col("rank")).alias("p"), F.sum(minus * F.col("rank")).alias("m"), F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("t"), F.sum("ties").alias("n")).first()
    n = s.n
    w, z_sd = min(s.p, s.m), math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    zero_free_ties = s.t
    if n <= 25 and zero_free_ties == 0:
        p = min(1.0, 2 * special.wilcoxon_exact_cdf(w, n))
    else:
        p = min(1.0, 2 * special.norm_cdf((w - n * (n + 1) / 4) / math.sqrt(z_sd**2 - zero_free_ties / 48)))
    r = abs(w - d.n * (d.n + 1) / 4) / math.sqrt(d.n * (d.n + 1) * (2 * d.n + 1) / 24) / math.sqrt(d.n)
    median = _median(counts, d.n)
    return _row(df, {"n_pairs": d.n, "n": n, "w": float(w), "rank_plus": float(s.p), "rank_minus": float(s.m), "p": p, "r_approx": r, "mean_diff": d["mean"], "median_diff": median}, WILCOXON)


KRUSKAL = "h double, p double, df long, n long, groups long, epsilon_squared double, warning string"


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """H corrected for ties, over groups with two values at least, and epsilon squared (0 at least)."""
    s = _rank_sums(df, value, group, 2).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("s"), F.sum("ties").alias("ties")).first()
    if not s.n or s.k < 2:
        return _row(df, {"n": s.n or 0, "groups": s.k, "warning": "The test needs two groups with two values."}, KRUSKAL)
    factor = 1 - s.ties / (float(s.n) ** 3 - s.n)
    if factor <= 0:
        return _row(df, {"n": s.n, "groups": s.k, "warning": "All values are equal."}, KRUSKAL)
    h = (12 / (s.n * (s.n + 1)) * s.s - 3 * (s.n + 1)) / factor
    return _row(df, {"h": h, "p": special.chi2_sf(h, s.k - 1), "df": s.k - 1, "n": s.n, "groups": s.k, "epsilon_squared": max(0.0, (h - s.k + 1) / (s.n - s.k))}, KRUSKAL)
