"""K-means with all starts in one scan, silhouettes, and isolation forests with exact samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed, discard
from .quantiles import quantiles

ROUNDS, TOLERANCE = 300, 1e-4


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centre."""
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)


def _seeded(points: DataFrame, k: int, starts: int, seed: int) -> np.ndarray:
    """k-means++ centres of all starts (starts, k, d): one scan a centre draws a point in each start.

    A point's arrival is exponential with its weight times its squared distance to the nearest centre so far as rate, from a hash of
    the point, and the first to arrive is drawn; so points are drawn in proportion, in parallel and the same on every run.
    """
    d = len(points.first().x)
    centres = np.zeros((starts, 0, d))
    for c in range(k):

        def race(frames: Iterator[pd.DataFrame], centres=centres, c=c) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple] = {}
            for frame in frames:
                if not len(frame):
                    continue
                x, w, h = np.stack(frame["x"].to_numpy()), frame["w"].to_numpy(), frame["h"].to_numpy(np.int64).view(np.uint64)
                for s in range(starts):
                    rate = w * (_gaps(x, centres[s]).min(axis=1) if c else 1.0)
                    u = h ^ np.uint64(((s + 1) * 0x9E3779B97F4A7C15 + (c + 1) * 0xD1B54A32D192ED03 + seed) % (1 << 64))
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                        u = (u ^ (u >> np.uint64(shift))) * np.uint64(factor)
                    with np.errstate(divide="ignore"):
                        arrival = -np.log(((u >> np.uint64(11)) + 0.5) / 2.0**53) / rate
                    i = int(np.argmin(arrival))
                    if s not in best or (arrival[i], tuple(x[i])) < best[s]:
                        best[s] = (float(arrival[i]), tuple(x[i]))
            yield pd.DataFrame([(s, a, list(x)) for s, (a, x) in best.items()], columns=["start", "arrival", "x"]).astype({"x": object})

        drawn = points.mapInPandas(race, "start int, arrival double, x array<double>").groupBy("start").agg(F.min(F.struct("arrival", "x")).alias("m"))
        new = {r.start: r.m.x for r in drawn.collect()}  # a point a start
        centres = np.concatenate([centres, np.array([new[s] for s in range(starts)])[:, None, :]], axis=1)
    return centres


def lloyd(rows: DataFrame, k: int, starts: int = 10, seed: int = 42, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(centres, inertia) of the best start over rows with x, an array; a scan moves the centres of all starts that still move.

    Equal points are one weighted point. A task sends sums by start and cluster, so the driver holds starts x k x d numbers.
    A start ends when its centres' squared moves are under TOLERANCE of the mean variance; a cluster without points keeps its centre.
    """
    points = checkpointed(rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn("h", F.xxhash64("x")))
    if points.isEmpty():
        return np.zeros((0, 0)), 0.0
    centres = _seeded(points, k, starts, seed)
    d = centres.shape[2]
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = points.agg(F.sum("w").alias("n"), *(F.sum(F.col("w") * c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(F.col("w") * c * c).alias(f"q{i}") for i, c in enumerate(x))).first()
    variance = float(np.mean([max(0.0, sums[f"q{i}"] / sums.n - (sums[f"s{i}"] / sums.n) ** 2) for i in range(d)]))
    inertia, live = np.full(starts, np.inf), list(range(starts))
    for step in range(rounds + 1):

        def moved(frames: Iterator[pd.DataFrame], centres=centres, live=tuple(live)) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(live), k, d + 2))
            for frame in frames:
                if len(frame):
                    x, w = np.stack(frame["x"].to_numpy()), frame["w"].to_numpy()
                    for i, s in enumerate(live):
                        gaps = _gaps(x, centres[s])
                        own = gaps.argmin(axis=1)
                        for j, v in enumerate([*(w * x[:, j] for j in range(d)), w, w * gaps[np.arange(len(x)), own]]):
                            total[i, :, j] += np.bincount(own, weights=v, minlength=k)
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        found = points.mapInPandas(moved, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
        total = found["v"].to_numpy().reshape(len(live), k, d + 2)
        still = []
        for i, s in enumerate(live):
            inertia[s] = total[i, :, d + 1].sum()
            weight = total[i, :, d]
            new = np.where(weight[:, None] > 0, total[i, :, :d] / np.maximum(weight, 1e-300)[:, None], centres[s])
            if step < rounds and ((new - centres[s]) ** 2).sum() > TOLERANCE * variance:
                still.append(s)
                centres[s] = new
        if not still:
            break
        live = still
    discard(points)
    best = int(np.argmin(inertia))
    return centres[best], float(inertia[best])


def nearest_centre(x: Column, centres: np.ndarray) -> Column:
    """The number of the centre nearest to an array; of equally near ones the first."""
    gap = lambda c: sum(((F.get(x, F.lit(i)) - float(v)) ** 2 for i, v in enumerate(c)), F.lit(0.0))
    return F.array_min(F.array(*(F.struct(gap(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres))))["k"]


def silhouette(df: DataFrame, columns: list[str], cluster: str = "cluster", block: int = 8192) -> DataFrame:
    """The mean silhouette with Euclidean distances; null with under two clusters.

    It needs all distances, so the work is quadratic: equal points of a cluster are weighted points, these are dealt to blocks, and a task takes
    two blocks, computes each distance once for both of its points and puts out a sum for each point and cluster. For large tables silhouette_squared is linear.
    """
    rows = df.select(F.col(cluster).cast("string").alias("k"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    points = checkpointed(rows.groupBy("k", "x").agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn("p", F.monotonically_increasing_id()))
    sizes = points.groupBy("k").agg(F.sum("w").alias("n"))
    blocks = max(1, -(-points.count() // block))
    dealt = points.withColumn("b", F.pmod(F.xxhash64("k", "x"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q")
    met = dealt.select("*", other).select("p", "k", "x", "w", "b", F.least("b", "q").alias("i"), F.greatest("b", "q").alias("j"))

    def listed(p: np.ndarray, names: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"p": np.repeat(p, len(names)), "o": np.tile(names, len(p)), "s": sums.ravel()})

    def summed(pair: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pair["i"].iloc[0]), int(pair["j"].iloc[0])
        own, others = (pair[pair["b"] == b].sort_values("k", na_position="last") for b in (lo, hi))
        if not len(own) or not len(others):
            return pd.DataFrame({"p": np.zeros(0, np.int64), "o": np.zeros(0, object), "s": np.zeros(0)})
        x, y = np.stack(own["x"].to_numpy()).T, np.stack(others["x"].to_numpy()).T
        (codes, names), (to, to_names) = (pd.factorize(f["k"], use_na_sentinel=False) for f in (own, others))
        v, w = own["w"].to_numpy(), others["w"].to_numpy()
        first = np.flatnonzero(np.diff(to, prepend=-1))  # where a cluster's points begin
        back, out = np.zeros((len(names), len(others))), []
        for at in range(0, len(own), 64):
            gaps = np.zeros((min(64, len(own) - at), len(others)))
            for a, b in zip(x, y, strict=True):
                d = a[at : at + 64, None] - b
                gaps += d * d
            np.sqrt(gaps, out=gaps)
            out.append(listed(own["p"].to_numpy()[at : at + 64], to_names, np.add.reduceat(gaps * w, first, axis=1)))
            if lo < hi:
                some = codes[at : at + 64]
                begins = np.flatnonzero(np.diff(some, prepend=-1))
                back[some[begins]] += np.add.reduceat(gaps * v[at : at + 64, None], begins, axis=0)
        if lo < hi:
            out.append(listed(others["p"].to_numpy(), names, back.T))
        return pd.concat(out)

    sums = met.groupBy("i", "j").applyInPandas(summed, "p long, o string, s double").groupBy("p", "o").agg(F.sum("s").alias("s"))
    sums = sums.join(points.select("p", "k", "w"), "p").join(F.broadcast(sizes.withColumnRenamed("k", "o")), "o")
    own = F.max(F.when(F.col("k") == F.col("o"), F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a")
    other = F.min(F.when(F.col("k") != F.col("o"), F.col("s") / F.col("n"))).alias("b")
    alone = F.max(F.when(F.col("k") == F.col("o"), F.col("n"))).alias("n")
    each = sums.groupBy("p", "w").agg(own, other, alone)
    score = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.agg(F.when(F.count("b") > 0, F.sum(score * F.col("w")) / F.sum("w")).alias("silhouette"))


def silhouette_squared(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """The mean silhouette with squared Euclidean distances, from sums per cluster, so linear in the rows.

    The mean squared distance of x to a cluster is |x|^2 - 2 x.m + s, with the cluster's mean m and mean square s.
    """
    x = [F.col(c).cast("double") for c in columns]
    sums = df.groupBy(F.col(cluster).alias("k")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), F.avg(sum((c * c for c in x), F.lit(0.0))).alias("s"))
    clusters = sums.orderBy("k").collect()  # one row a cluster
    if len(clusters) < 2:
        return df.agg(F.lit(None).cast("double").alias("silhouette"))
    square = sum((c * c for c in x), F.lit(0.0))
    distance = lambda c: square - 2 * sum((v * float(c[f"m{i}"]) for i, v in enumerate(x)), F.lit(0.0)) + float(c.s)
    own = F.coalesce(*(F.when(F.col(cluster) == c.k, distance(c) * c.n / max(1, c.n - 1)) for c in clusters))
    alone = F.coalesce(*(F.when(F.col(cluster) == c.k, F.lit(c.n == 1)) for c in clusters))
    other = F.least(*(F.when(F.col(cluster) != c.k, distance(c)) for c in clusters), F.lit(None).cast("double"))
    score = F.when(alone, 0.0).otherwise(F.coalesce(F.try_divide(other - own, F.greatest(other, own)), F.lit(0.0)))
    return df.agg(F.avg(score).alias("silhouette"))


# isolation forest


def bottom_samples(rows: DataFrame, keys: list[str], trees: int, sample: int, seed: int) -> DataFrame:
    """rows with tree and r: for each tree the sample rows with the least hashes of their keys, whatever the partitions.

    Only rows whose hash for a tree is small are put out; if that leaves a tree short, which is unlikely, all are.
    """
    n = rows.count()
    names = [c for c in rows.columns]
    place = lambda t: F.pmod(F.xxhash64(*keys, F.lit(seed), t), F.lit(1 << 40))
    share = min(1.0, 4 * sample / max(1, n))
    while True:
        cells = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), place(t).alias("r")))
        drawn = rows.select("*", F.inline(F.filter(cells, lambda c: c["r"] < int(share * (1 << 40)))))
        order = Window.partitionBy("tree").orderBy("r", *names)
        drawn = checkpointed(drawn.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= sample).drop("_i"))
        if share >= 1 or drawn.count() == trees * min(sample, n):
            return drawn
        share = 1.0


def isolation_forest(df: DataFrame, columns: list[str], contamination: float | None = None, trees: int = 100, sample: int = 256, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """df with score (0 to 1, high is odd) and outlier: trees are grown in parallel on samples of exactly so many rows, then broadcast.

    Samples are drawn by a hash of key, by default the columns, so the result is the same for any partitions. outlier: a score above the
    interpolated quantile at 1 - contamination, else above 0.5.
    """
    x = [F.col(c).cast("double").alias(c) for c in columns]
    keys = [f"_k{i}" for i in range(len(key or ()))]
    rows = df.na.drop(subset=columns)
    drawn = bottom_samples(rows.select(*x, *(F.col(c).alias(k) for c, k in zip(key or (), keys, strict=True))), keys or columns, trees, sample, seed)

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["r", *columns])
        rng, data = np.random.default_rng(seed + int(frame["tree"].iloc[0])), frame[columns].to_numpy()
        most, nodes = int(np.ceil(np.log2(max(2, len(data))))), []

        def build(own: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, float(len(own)), depth])
            spread = own.max(axis=0) > own.min(axis=0) if len(own) else np.zeros(1, bool)
            if depth < most and len(own) > 1 and spread.any():
                c = int(rng.choice(np.flatnonzero(spread)))
                cut = rng.uniform(own[:, c].min(), own[:, c].max())
                nodes[at][:2] = [c, cut]
                nodes[at][2] = build(own[own[:, c] < cut], depth + 1)
                nodes[at][3] = build(own[own[:, c] >= cut], depth + 1)
            return at

        build(data, 0)
        return pd.DataFrame({"tree": frame["tree"].iloc[0], "nodes": [[list(map(float, n)) for n in nodes]], "size": len(data)})

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, nodes array<array<double>>, size int").toPandas().sort_values("tree")  # trees of 2 * sample nodes
    if not len(grown):
        return rows.withColumns({"score": F.lit(None).cast("double"), "outlier": F.lit(False)})
    forest, size = [np.array(list(map(list, n))) for n in grown["nodes"]], float(grown["size"].mean())
    depth_of = lambda n: np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))
    typical = float(depth_of(np.array([max(2.0, size)]))[0])

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        data = np.array(v.tolist(), dtype=float).reshape(len(v), len(columns))
        total = np.zeros(len(data))
        for t in forest:
            at = np.zeros(len(data), int)
            while (inner := t[at, 0] >= 0).any():
                own = np.flatnonzero(inner)
                left = data[own, t[at[own], 0].astype(int)] < t[at[own], 1]
                at[own] = np.where(left, t[at[own], 2], t[at[own], 3]).astype(int)
            total += t[at, 5] + depth_of(t[at, 4])
        return pd.Series(2.0 ** (-total / max(1, len(forest)) / typical))

    scored = rows.withColumn("score", score(F.array(*(F.col(c).cast("double") for c in columns))))
    if contamination is None:
        return scored.withColumn("outlier", F.col("score") > 0.5)
    return above_share(checkpointed(scored), "score", contamination)


def above_share(rows: DataFrame, score: str, share: float) -> DataFrame:
    """rows with outlier: whether the score is above its interpolated quantile at 1 - share, a ratio of at most a half."""
    share = share if 0 < share <= 0.5 else 0.05
    limit = quantiles(rows, {"s": F.col(score)}, [1 - share])["s"][0]
    return rows.withColumn("outlier", F.coalesce(F.col(score) > F.lit(limit), F.lit(False)))
