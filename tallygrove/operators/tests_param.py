"""Correlation and parametric tests: Spark makes a few sums, numpy the probabilities.

Each result is a small DataFrame whose columns are statistics, p-values and confidence limits.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.scalar import clamped, finite, to_number
from ..plans.lineage import checkpointed, if_few
from .describe import excess_kurtosis, numeric_columns, skew
from .quantiles import quantiles
from .ranks import evenly, placed

WIDE = 50  # columns beyond which pairs are summed as matrices


def _row(df: DataFrame, values: dict, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    clean = lambda v: None if v is None or (isinstance(v, float) and not math.isfinite(v)) else v
    return df.sparkSession.createDataFrame([tuple(clean(values.get(n)) for n in names)], schema)


def _wide_pairs(df: DataFrame, columns: list[str], constant: float | None) -> DataFrame:
    """a, b, r of each pair over the rows with both values: each task sums matrices about the columns' means."""
    x = [to_number(F.col(c)).alias(f"x{k}") for k, c in enumerate(columns)]
    rows = df.select(*x)
    means = np.array([m or 0.0 for m in rows.agg(*(F.avg(c) for c in rows.columns)).first()])

    def sums(batches):
        d = len(means)
        total = np.zeros((4, d, d))
        for batch in batches:
            v = batch.to_numpy(dtype=float) - means
            known = np.isfinite(v)
            v = np.where(known, v, 0.0)
            mask = known.astype(float)
            total += np.stack([mask.T @ mask, v.T @ mask, (v**2).T @ mask, v.T @ v])
        i, j = np.triu_indices(d, 1)
        n, s, q, p = total
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sx": s[i, j], "sy": s[j, i], "qx": q[i, j], "qy": q[j, i], "p": p[i, j]})

    numbers = ("n", "sx", "sy", "qx", "qy", "p")
    pairs = rows.mapInPandas(sums, "i int, j int, " + ", ".join(f"{c} double" for c in numbers)).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in numbers))
    spread = lambda s, q: F.greatest(F.col(q) - F.col(s) ** 2 / F.col("n"), F.lit(0.0))
    root = F.sqrt(spread("sx", "qx") * spread("sy", "qy"))
    r = F.coalesce(F.try_divide(F.col("p") - F.col("sx") * F.col("sy") / F.col("n"), F.when(root > 0, root)), F.lit(constant))
    names = F.array(*map(F.lit, columns))
    return pairs.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), r.alias("r"))


def corr(df: DataFrame, columns: list[str] | None = None, top: int | None = None, constant: float | None = 0.0) -> DataFrame:
    """a, b, r, abs_r of each pair of numeric columns; rows with both values count; constant columns have r = constant."""
    columns = columns or numeric_columns(df)
    if len(columns) > WIDE:
        found = _wide_pairs(df, columns, constant)
    else:
        x = {c: to_number(F.col(c)) for c in columns}

        def r(a: str, b: str):
            both = x[a].isNotNull() & x[b].isNotNull()
            spread = F.stddev_pop(F.when(both, x[a])) * F.stddev_pop(F.when(both, x[b]))
            return F.coalesce(F.try_divide(F.covar_pop(x[a], x[b]), F.when(spread > 0, spread)), F.lit(constant))

        pairs = list(itertools.combinations(columns, 2))
        sums = df.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
        found = sums.select(F.inline(F.array(*(f"p{k}" for k in range(len(pairs))))))
    found = found.withColumn("abs_r", F.abs("r"))
    return found.orderBy(F.desc("abs_r"), "a", "b").limit(top) if top else found


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """a, b, r for all ordered pairs, rounded to 6 decimals."""
    columns = columns or numeric_columns(df)
    pairs = corr(df, columns).select("a", "b", "r")
    ones = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return pairs.union(pairs.select(F.col("b"), F.col("a"), "r")).union(ones).select("a", "b", F.round("r", 6).alias("r"))


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """grp, n, mean, var of each group with a value."""
    rows = df.select(F.col(group).cast("string").alias("grp"), to_number(F.col(value)).alias("x")).where("grp is not null and x is not null")
    return rows.groupBy("grp").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def _welch(m1, v1, n1, m2, v2, n2):
    se2 = v1 / n1 + v2 / n2
    if se2 <= 0:
        return None, None
    return (m1 - m2) / math.sqrt(se2), se2**2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))


TTEST = "group_a string, group_b string, n_a long, n_b long, mean_a double, mean_b double, t double, df double, p double, cohen_d double, d_low double, d_high double, warning string"


def ttest(df: DataFrame, value: str, group: str, equal_var: bool = False, levels: tuple[str, str] | None = None) -> DataFrame:
    """Welch's (or Student's) test of two groups, with Cohen's d and its 95 % limits; a warning unless there are two."""
    groups = sorted(group_moments(df, value, group).where(F.col("grp").isin(*levels) if levels else F.lit(True)).limit(3).collect())
    if len(groups) != 2 or min(g.n for g in groups) < 2:
        return _row(df, {"warning": "The test needs two groups with two values each."}, TTEST)
    a, b = groups
    if equal_var:
        pooled = ((a.n - 1) * a["var"] + (b.n - 1) * b["var"]) / (a.n + b.n - 2)
        t, dof = ((a.mean - b.mean) / math.sqrt(pooled * (1 / a.n + 1 / b.n)) if pooled > 0 else None), float(a.n + b.n - 2)
    else:
        t, dof = _welch(a.mean, a["var"], a.n, b.mean, b["var"], b.n)
    sd = math.sqrt((a["var"] + b["var"]) / 2)
    effect = (a.mean - b.mean) / sd if sd > 0 else 0.0
    se = math.sqrt((a.n + b.n) / (a.n * b.n) + effect**2 / (2 * max(1, a.n + b.n - 2)))
    found = {"group_a": a.grp, "group_b": b.grp, "n_a": a.n, "n_b": b.n, "mean_a": a.mean, "mean_b": b.mean, "t": t, "df": dof, "p": 2 * special.t_sf(abs(t), dof) if t is not None else None, "cohen_d": effect}
    z = special.norm_ppf(0.975)
    found |= {"d_low": effect - z * se, "d_high": effect + z * se}
    return _row(df, found, TTEST)


def _counted(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null")
    return checkpointed(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("observed")))


def _expected(cells: DataFrame) -> DataFrame:
    row, column = cells.groupBy("a").agg(F.sum("observed").alias("_r")), cells.groupBy("b").agg(F.sum("observed").alias("_c"))
    total = cells.agg(F.sum("observed").alias("_n"))
    spine = row.crossJoin(if_few(column)).crossJoin(F.broadcast(total))  # the table itself
    return spine.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("_r") * F.col("_c") / F.col("_n")).alias("expected"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, observed, expected for every pair of levels, also those that don't occur.

    Levels, not rows, are paired: the margins' product is the table itself.
    """
    return _expected(_counted(df, a, b))


CHISQ = "chi2 double, p double, dof long, n long, cramers_v double, v_low double, v_high double, warning string"


def _drawn(keys: np.ndarray, counts: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """How often cells with so many rows are drawn in each bootstrap sample: Poisson, from a stream of the cell's own key."""
    out = np.empty((len(keys), samples), np.int64)
    for k, (key, n) in enumerate(zip(keys.astype(np.int64).view(np.uint64).tolist(), counts.tolist(), strict=True)):
        out[k] = np.random.Generator(np.random.Philox(key=[key, seed])).poisson(n, samples)
    return out


def _v_limits(cells: DataFrame, samples: int, seed: int) -> tuple[float, float] | None:
    """95 % bootstrap limits of Cramer's V of a table of a, b, observed; None unless 20 samples have two levels of each.

    A sample draws each cell's rows where the cell is, so nothing grows with the rows and tables of any size are taken; margins are sums by sample.
    """

    @F.pandas_udf("array<long>")
    def draw(key: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(list(_drawn(key.to_numpy(), n.to_numpy(), samples, seed)))

    drawn = cells.where("observed > 0").select("a", "b", F.posexplode(draw(F.xxhash64("a", "b"), F.col("observed"))).alias("i", "o")).where("o > 0")
    drawn = checkpointed(drawn)
    row, column = drawn.groupBy("i", "a").agg(F.sum("o").alias("r")), drawn.groupBy("i", "b").agg(F.sum("o").alias("c"))
    sums = drawn.join(row, ["i", "a"]).join(column, ["i", "b"]).groupBy("i").agg(F.sum("o").cast("double").alias("n"), F.sum(F.col("o") * F.col("o") / F.col("r") / F.col("c")).alias("q"))
    for name, side, size in (("r", row, "kr"), ("c", column, "kc")):
        sums = sums.join(side.groupBy("i").agg(F.count(F.lit(1)).alias(size), F.sum(1 / F.col(name)).alias(f"s{name}")), "i")
    n, k = F.col("n"), F.least("kr", "kc") - 1
    plain = F.greatest(n * (F.col("q") - 1), F.lit(0.0))
    gap = F.sqrt(plain / (n * F.col("sr") * F.col("sc")))  # in a table of 2 x 2 all cells are as far from what is expected
    yates = F.when(gap > 0.5, (gap - 0.5) ** 2).otherwise(0.0) * n * F.col("sr") * F.col("sc")
    chi2 = F.when((F.col("kr") == 2) & (F.col("kc") == 2), yates).otherwise(plain)
    v = [r.v for r in sums.where(k > 0).select(F.sqrt(chi2 / (n * k)).alias("v")).collect()]  # a number a sample
    return tuple(np.percentile(v, [2.5, 97.5]).tolist()) if len(v) >= 20 else None


def chisq(df: DataFrame, a: str, b: str, bootstrap: int = 250, seed: int = 42) -> DataFrame:
    """Independence of two columns, with Yates' correction for 2 x 2, Cramer's V and its bootstrap limits.

    A bootstrap sample draws the table's cells, which costs the same for any number of rows.
    """
    cells = _counted(df, a, b)
    gap = F.abs(F.col("observed") - F.col("expected"))
    sums = _expected(cells).agg(F.sum("observed").alias("n"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"), F.sum(gap**2 / F.col("expected")).alias("plain"), F.sum((gap - F.least(F.lit(0.5), gap)) ** 2 / F.col("expected")).alias("yates")).first()
    if not sums.n or sums.n < 5 or min(sums.r, sums.c) < 2:
        return _row(df, {"n": sums.n or 0, "warning": "The test needs five rows and two levels of each column."}, CHISQ)
    dof = (sums.r - 1) * (sums.c - 1)
    chi2 = sums.yates if dof == 1 else sums.plain
    found = {"chi2": chi2, "dof": dof, "n": sums.n, "p": special.chi2_sf(chi2, dof), "cramers_v": math.sqrt(chi2 / (sums.n * (min(sums.r, sums.c) - 1)))}
    if bootstrap and sums.n >= 20 and (limits := _v_limits(cells, bootstrap, seed)):
        found |= dict(zip(("v_low", "v_high"), limits, strict=True))
    return _row(df, found, CHISQ)


ANOVA = "f double, p double, df_between long, df_within long, ss_between double, ss_within double, ms_between double, ms_within double, eta_squared double, warning string"


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance; sums of squares are of groups with two values at least, mean and df of all rows."""
    groups = group_moments(df, value, group)
    total = groups.agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    valid = groups.where("n >= 2").crossJoin(F.broadcast(total))
    s = valid.agg(F.count(F.lit(1)).alias("k"), F.max("rows").alias("n"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"))
    enough = (F.col("k") >= 2) & (F.col("n") >= 6)
    dfb, dfw = F.col("k") - 1, F.col("n") - F.col("k")
    stat = F.try_divide(F.col("between") / dfb, F.col("within") / dfw)

    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([special.f_sf(x, a, b) if x == x and x is not None else None for x, a, b in zip(f, d1, d2, strict=True)], dtype="float64")

    ok = lambda e: F.when(enough, e)
    return s.select(
        ok(stat).alias("f"), ok(tail(stat, dfb, dfw)).alias("p"), ok(dfb).alias("df_between"), ok(dfw).alias("df_within"), ok(F.col("between")).alias("ss_between"), ok(F.col("within")).alias("ss_within"),
        ok(F.try_divide("between", dfb)).alias("ms_between"), ok(F.try_divide("within", dfw)).alias("ms_within"), ok(F.try_divide(F.col("between"), F.col("between") + F.col("within"))).alias("eta_squared"),
        F.when(~enough, F.lit("The test needs six rows and two groups with two values.")).alias("warning"),
    )


def eta_squared_limits(df: DataFrame, value: str, group: str, bootstrap: int = 250, seed: int = 42) -> DataFrame:
    """95 % bootstrap limits of eta squared; null under 20 rows.

    Equal values of a group are counted first; how often all of them are drawn in each sample is Poisson with their count, from a hash of group
    and value, so the limits are the same however rows are dealt. What is shuffled are sums by group and sample.
    """
    rows = df.select(F.col(group).cast("string").alias("grp"), to_number(F.col(value)).alias("x")).where("grp is not null and x is not null")
    if rows.limit(20).count() < 20:
        return _row(df, {}, "eta_low double, eta_high double")
    counts = rows.groupBy("grp", "x").agg(F.count(F.lit(1)).alias("n")).select("grp", "x", "n", F.xxhash64("grp", "x").alias("k"))

    def sums(batches):
        for batch in batches:
            if not len(batch):
                continue
            codes, names = pd.factorize(batch["grp"])
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) > 0]))
            x = batch["x"].to_numpy()[order][:, None]
            w = _drawn(batch["k"].to_numpy()[order], batch["n"].to_numpy()[order], bootstrap, seed).astype(float)
            parts = [np.add.reduceat(v, first, axis=0).ravel() for v in (w, w * x, w * x * x)]
            yield pd.DataFrame({"b": np.tile(np.arange(bootstrap), len(names)), "grp": np.repeat(np.asarray(names, object), bootstrap), "n": parts[0], "s": parts[1], "q": parts[2]})

    made = counts.mapInPandas(sums, "b int, grp string, n double, s double, q double").groupBy("b", "grp").agg(*(F.sum(c).alias(c) for c in "nsq")).where("n > 0")
    made = made.groupBy("b").agg((F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / F.sum("n")).alias("between"), (F.sum("q") - F.sum("s") ** 2 / F.sum("n")).alias("total")).where("total > 0")
    return made.agg(*(F.percentile(F.round(F.col("between") / F.col("total"), 12), F.lit(p)).alias(n) for p, n in ((0.025, "eta_low"), (0.975, "eta_high"))))


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, mean, sd, population skewness and kurtosis, and bias-corrected skew and excess kurtosis of one column."""
    x = finite(to_number(F.col(column)))
    spread = F.stddev_pop(x) > 0
    shape = [F.when(spread, F.skewness(x)).alias("skewness"), F.when(spread, F.kurtosis(x)).alias("kurtosis"), skew(x).alias("skew"), excess_kurtosis(x).alias("excess")]
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), *shape)


NORMALITY = "n long, mean double, sd double, jarque_bera double, jb_p double, shapiro_w double, shapiro_p double, skewness double, kurtosis double, warning string"


def normality(df: DataFrame, column: str, shapiro_most: int = 5000) -> DataFrame:
    """Mean, sd, bias-corrected skewness and excess kurtosis, Jarque-Bera (of population moments), and Shapiro-Wilk (Royston's approximation) up to so many values."""
    m = moments(df, column).first()
    if m.n < 8 or m.skewness is None:
        return _row(df, {"n": m.n, "warning": "The test needs eight values that differ."}, NORMALITY)
    jb = m.n / 6 * (m.skewness**2 + m.kurtosis**2 / 4)
    found = {"n": m.n, "mean": m["mean"], "sd": m.sd, "jarque_bera": jb, "jb_p": special.chi2_sf(jb, 2), "skewness": m.skew, "kurtosis": m.excess}
    if m.n <= shapiro_most:
        x = np.sort(df.select(to_number(F.col(column)).alias("x")).where("x is not null").toPandas()["x"].to_numpy())
        found |= dict(zip(("shapiro_w", "shapiro_p"), shapiro(x), strict=True))
    return _row(df, found, NORMALITY)


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and p of sorted values, 8 at least, by Royston's weights (1995)."""
    n = len(x)
    m = np.array([special.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, c = 1 / math.sqrt(n), m / math.sqrt((m**2).sum())
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, c[-1]], u)
    second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
    phi = ((m**2).sum() - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    a = m / math.sqrt(phi)
    a[[0, 1, -2, -1]] = [-last, -second, second, last]
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    log = math.log(n)
    if n <= 11:
        g, mu, sd = -2.273 + 0.459 * n, np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-math.log(max(g - math.log1p(-w), 1e-300)) - mu) / sd
    else:
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log))
        z = (math.log1p(-w) - mu) / sd
    return w, special.norm_sf(z)


def qq_points(df: DataFrame, column: str, most: int = 100) -> DataFrame:
    """Normal Q-Q in the column's units: probability, theoretical (with the column's mean and sd, or 1) and sample quantiles at evenly spaced probabilities from .01 to .99."""
    x = finite(to_number(F.col(column)))
    m = moments(df, column).first()
    probs = np.linspace(0.01, 0.99, max(1, min(most, m.n))).round(10).tolist() if m.n else []
    sample = quantiles(df, {"x": x}, probs)["x"] if probs else []
    scale = m.sd or 1.0
    return df.sparkSession.createDataFrame([(p, m["mean"] + scale * special.norm_ppf(p), s) for p, s in zip(probs, sample, strict=True)], "p double, theoretical double, sample double")


def qq_all(rows: DataFrame, column: str, most: int = 1200) -> DataFrame:
    """Standard normal Q-Q of all values, or so many evenly spaced ones: place, theoretical quantile at (place + 1) / (n + 1), sample."""
    found, n = placed(rows.select(F.col(column).cast("double").alias("sample")).where("sample is not null and not isnan(sample)"), ["sample"])

    @F.pandas_udf("double")
    def theoretical(place: pd.Series) -> pd.Series:
        return pd.Series([special.norm_ppf((k + 1) / (n + 1)) for k in place], dtype="float64")

    return evenly(found, n, most).select("place", theoretical("place").alias("theoretical"), "sample")


CI_MEAN = "n long, mean double, sd double, se double, low double, high double, confidence double, warning string"


def ci_mean(df: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    """The mean's limits by Student's t."""
    m, confidence = moments(df, column).first(), clamped(confidence, 0.5, 0.999, 0.95)
    if m.n < 2:
        return _row(df, {"n": m.n, "warning": "The interval needs two values."}, CI_MEAN)
    se = m.sd / math.sqrt(m.n)
    half = special.t_ppf((1 + confidence) / 2, m.n - 1) * se
    return _row(df, {"n": m.n, "mean": m["mean"], "sd": m.sd, "se": se, "low": m["mean"] - half, "high": m["mean"] + half, "confidence": confidence}, CI_MEAN)


def _pairs(df: DataFrame, value: str, group: str) -> DataFrame:
    """Moments of each pair of groups with two values at least; groups, not rows, are paired."""
    g = group_moments(df, value, group).where("n >= 2")
    a, b = (g.select(*(F.col(c).alias(f"{c}_{s}") for c in g.columns)) for s in "ab")
    return a.join(b, F.col("grp_a") < F.col("grp_b"))


def tukey(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Tukey-Kramer: difference (b - a), adjusted p, limits and rejection for each pair of groups."""
    alpha = clamped(alpha, 0.001, 0.2, 0.05)
    g = group_moments(df, value, group).where("n >= 2")
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum((F.col("n") - 1) * F.col("var")).alias("ss")).first()
    if s.k < 2:
        return df.sparkSession.createDataFrame([], "group_a string, group_b string, diff double, q double, p_adj double, low double, high double, reject boolean")
    k, dof = s.k, float(s.n - s.k)
    mse, critical = s.ss / dof, special.studentized_range_ppf(1 - alpha, k, dof)

    @F.pandas_udf("double")
    def tail(q: pd.Series) -> pd.Series:
        return q.map(lambda x: special.studentized_range_sf(x, k, dof))

    se = F.sqrt(F.lit(mse / 2) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    pairs = _pairs(df, value, group).select(F.col("grp_a").alias("group_a"), F.col("grp_b").alias("group_b"), (F.col("mean_b") - F.col("mean_a")).alias("diff"), se.alias("se"))
    pairs = pairs.withColumn("q", F.coalesce(F.try_divide(F.abs("diff"), F.col("se")), F.lit(0.0))).withColumn("p_adj", tail("q"))
    return pairs.select("group_a", "group_b", "diff", "q", "p_adj", (F.col("diff") - critical * F.col("se")).alias("low"), (F.col("diff") + critical * F.col("se")).alias("high"), (F.col("p_adj") < alpha).alias("reject"))


def adjusted(df: DataFrame, p: str, method: str = "holm") -> DataFrame:
    """df with p_adj: bonferroni, holm or fdr_bh over all rows. For tables of tests, which are small."""
    from pyspark.sql import Window

    n = df.agg(F.count(p).alias("_m"))
    if method == "bonferroni":
        return df.crossJoin(F.broadcast(n)).withColumn("p_adj", F.least(F.lit(1.0), F.col(p) * F.col("_m"))).drop("_m")
    ranked = df.crossJoin(F.broadcast(n)).withColumn("_i", F.row_number().over(Window.orderBy(p)))
    if method == "holm":
        running = F.max(F.col(p) * (F.col("_m") - F.col("_i") + 1)).over(Window.orderBy("_i"))
    elif method == "fdr_bh":
        running = F.min(F.col(p) * F.col("_m") / F.col("_i")).over(Window.orderBy(F.desc("_i")))
    else:
        raise ValueError("method is holm, bonferroni or fdr_bh")
    return ranked.withColumn("p_adj", F.least(F.lit(1.0), running)).drop("_m", "_i")


def pairwise_adjusted(df: DataFrame, value: str, group: str, method: str = "holm") -> DataFrame:
    """Welch's test of each pair of groups with adjusted p, most significant first."""
    se2 = F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b")
    dof = F.try_divide(se2**2, (F.col("var_a") / F.col("n_a")) ** 2 / (F.col("n_a") - 1) + (F.col("var_b") / F.col("n_b")) ** 2 / (F.col("n_b") - 1))
    tests = _pairs(df, value, group).select(F.col("grp_a").alias("group_a"), F.col("grp_b").alias("group_b"), (F.col("mean_a") - F.col("mean_b")).alias("diff"), F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(se2)).alias("t"), dof.alias("df"))

    @F.pandas_udf("double")
    def both_tails(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([2 * special.t_sf(abs(x), y) if x == x and y == y else None for x, y in zip(t, d, strict=True)], dtype="float64")

    return adjusted(tests.withColumn("p", both_tails("t", "df")), "p", method).orderBy("p_adj", "group_a", "group_b")
