"""Nearest neighbours and density clusters by cells with bounding boxes; neither compares all rows with all.

Points are rows with x, an array of numbers without nulls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import FEW, checkpointed, discard, if_few

CELL, FAN, SAMPLE = 2048, 256, 4096


def as_points(df: DataFrame, columns: list[str], **named: Column) -> DataFrame:
    """The named columns and x; rows with a null or NaN are left out."""
    numbers = [F.col(c).cast("double") for c in columns]
    return df.select(*(c.alias(n) for n, c in named.items()), F.array(*numbers).alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


# cells of about equal counts


def _halved(points: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """(dimension, cut) of each node of a tree that halves a sample along its widest dimension; a node that can't be cut sends all left."""
    dims, cuts, parts = [], [], [points]
    for _ in range(depth):
        following = []
        for own in parts:
            dim, cut = 0, float("inf")
            if len(own) > 1:
                width = own.max(axis=0) - own.min(axis=0)
                for d in np.argsort(-width, kind="stable").tolist():
                    if width[d] <= 0:
                        break
                    values = np.sort(own[:, d])
                    middle = values[len(values) // 2]
                    middle = middle if middle > values[0] else values[np.searchsorted(values, middle, "right")]
                    dim, cut = d, float(middle)
                    break
            dims.append(dim)
            cuts.append(cut)
            left = own[:, dim] < cut if len(own) else np.zeros(0, bool)
            following += [own[left], own[~left]]
        parts = following
    return dims, cuts


def _leaf() -> Column:
    """The number of the leaf that x reaches in the tree of dims and cuts."""
    step = lambda at, _: 2 * at + F.when(F.get("x", F.get("dims", at)) >= F.get("cuts", at), 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), F.col("depth")), F.lit(0), step) - F.call_function("shiftleft", F.lit(1), F.col("depth")) + 1


@dataclass
class Cells:
    """Points dealt to cells, and the levels of trees above them."""

    points: DataFrame  # with cell
    trees: list[DataFrame]  # cell, depth, dims, cuts, of each level
    boxes: list[DataFrame]  # cell, parent, low, high, n, of each level
    width: int

    def routed(self, rows: DataFrame) -> DataFrame:
        """rows (with x) with cell, and cells, the path from the root to it."""
        rows = rows.withColumns({"cell": F.lit(0).cast("long"), "cells": F.array(F.lit(0).cast("long"))})
        for tree in self.trees:
            deeper = F.col("cell") * FAN + _leaf()
            rows = rows.join(if_few(tree), "cell", "left").withColumn("cell", F.when(F.col("depth").isNull(), F.col("cell")).otherwise(deeper))
            rows = rows.withColumn("cells", F.when(F.col("depth").isNull(), F.col("cells")).otherwise(F.array_append("cells", F.col("cell")))).drop("depth", "dims", "cuts")
        return rows


def _boxes(points: DataFrame, parent: Column, width: int) -> DataFrame:
    extent = [F.array(*(f(F.get("x", F.lit(i))) for i in range(width))).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    return checkpointed(points.groupBy("cell", parent.alias("parent")).agg(*extent, F.count(F.lit(1)).alias("n")))


def celled(points: DataFrame, width: int, order: list[str], cell: int = CELL) -> Cells:
    """Points (distinct by order) in cells of about `cell` rows; cells of equal points can be larger.

    Each level splits what is still too large in up to FAN parts by a tree that a task builds on SAMPLE points of the cell,
    those with the least hashes. The children of cell c are numbered from c * FAN + 1 on.
    """
    rows = checkpointed(points.withColumn("cell", F.lit(0).cast("long")))
    boxes, trees = [_boxes(rows, F.lit(-1).cast("long"), width)], []
    while True:
        large = boxes[-1].where((F.col("n") > 2 * cell) & (F.col("low") != F.col("high")))
        large = checkpointed(large.select("cell", F.col("n").alias("_n")))
        if large.isEmpty():
            return Cells(rows, trees, boxes, width)
        rank = F.pmod(F.xxhash64(*order, F.lit(len(trees))), F.lit(1 << 40))
        sample = rows.join(if_few(large), "cell").withColumn("_r", rank).where(F.col("_r") <= F.lit(float(1 << 40)) * 2 * SAMPLE / F.col("_n"))
        sample = sample.withColumn("_i", F.row_number().over(Window.partitionBy("cell").orderBy("_r", *order))).where(F.col("_i") <= SAMPLE)

        def grown(frame: pd.DataFrame) -> pd.DataFrame:
            depth = min(FAN.bit_length() - 1, max(1, int(np.ceil(np.log2(frame["_n"].iloc[0] / cell)))))
            dims, cuts = _halved(np.stack(frame["x"].to_numpy()), depth)
            return pd.DataFrame({"cell": [frame["cell"].iloc[0]], "depth": [depth], "dims": [dims], "cuts": [cuts]})

        tree = checkpointed(sample.select("cell", "_n", "x").groupBy("cell").applyInPandas(grown, "cell long, depth int, dims array<int>, cuts array<double>"))
        deeper = F.when(F.col("depth").isNull(), F.col("cell")).otherwise(F.col("cell") * FAN + _leaf())
        moved = checkpointed(rows.join(if_few(tree), "cell", "left").select(*points.columns, deeper.alias("_to"), F.when(F.col("depth").isNotNull(), F.col("cell")).alias("_from")))
        discard(rows)
        rows = moved.withColumnRenamed("_to", "cell")
        rows._written_at = moved._written_at
        trees.append(tree)
        boxes.append(_boxes(rows.where("_from is not null"), F.col("_from"), width))
        rows = rows.drop("_from")
        rows._written_at = moved._written_at


def _gap(width: int, far: bool = False) -> Column:
    """The distance of x to the box's nearest (or farthest) point."""
    total = F.lit(0.0)
    for i in range(width):
        x, low, high = (F.get(c, F.lit(i)) for c in ("x", "low", "high"))
        side = F.greatest(F.abs(x - low), F.abs(x - high)) if far else F.greatest(low - x, x - high, F.lit(0.0))
        total = total + side * side
    return F.sqrt(total)


def _searched(points: DataFrame, asked: DataFrame, k: int, key_type: str, block: int = CELL) -> DataFrame:
    """x, near (distance, key, label) of the k nearest points in each asked cell; a cell's queries are dealt to chunks of about block rows.

    A cell's points are few, or equal, of which k are kept; they are copied to each chunk.
    """
    chunks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    chunks = checkpointed(chunks)
    left = points.join(chunks, "cell").select(*points.columns, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = asked.select("x", "cell").join(chunks, "cell").select("x", F.col("cell").alias("to"), F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int").alias("dealt"))

    def near(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"x": [], "d": [], "key": [], "label": []}
        if len(own) and len(queries):
            x, keys, labels = np.stack(own["x"].to_numpy()), own["key"].to_numpy(), own["label"].to_numpy()
            for q in queries["x"]:
                d = np.sqrt(((x - q) ** 2).sum(axis=1))
                at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                at = at[np.lexsort((keys[at], d[at]))[:k]]
                out["x"] += [q] * len(at)
                out["d"] += d[at].tolist()
                out["key"] += keys[at].tolist()
                out["label"] += labels[at].tolist()
        return pd.DataFrame(out, dtype=object)

    return left.groupBy("cell", "chunk").cogroup(right.groupBy("to", "dealt")).applyInPandas(near, f"x array<double>, d double, key {key_type}, label string")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest by x: nearer first, then the smaller key; what each task keeps is cut before it is shuffled."""
    order = F.row_number().over(Window.partitionBy("x").orderBy("d", "key"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def visited_cells(cells: Cells, bounds: DataFrame) -> DataFrame:
    """x, cell: the leaves (but own) with a box no farther from x than its bound, found from the root down.

    bounds has x, own (a leaf) and bound.
    """
    slack = F.col("bound") * (1 + 1e-12)
    rows, done = bounds.withColumn("cell", F.lit(0).cast("long")), None
    for level in range(len(cells.trees) + 1):
        inner = cells.trees[level].select("cell", F.lit(True).alias("inner")) if level < len(cells.trees) else None
        if inner is not None:
            rows = rows.join(if_few(inner), "cell", "left")
            leaves = rows.where("inner is null").drop("inner")
        else:
            leaves = rows
        done = leaves if done is None else done.unionByName(leaves)
        if inner is None:
            break
        down = cells.boxes[level + 1].select(F.col("parent").alias("cell"), F.col("cell").alias("child"), "low", "high")
        rows = rows.where("inner").drop("inner").join(if_few(down), "cell").where(_gap(cells.width) <= slack).select("x", "own", "bound", F.col("child").alias("cell"))
    return done.where("cell <> own").select("x", "cell")


def nearest(points: DataFrame, asked: DataFrame, width: int, k: int, cell: int = CELL) -> DataFrame:
    """x, rank, d, key, label: the k nearest points (key, label, x) of each distinct asked x; of equally near ones those with smaller keys.

    Equal points are cut to the k with the smallest keys, as no others can be among the nearest. A query's own cell gives a bound
    on its k-th distance (from the boxes above it, if the cell has fewer points); then only cells with a box within the bound are visited.
    Rows that are shuffled are the points, the queries and the visits.
    """
    equal = F.row_number().over(Window.partitionBy("x").orderBy("key"))
    kept = points.withColumn("_e", equal).where(F.col("_e") <= k).drop("_e")
    cells = celled(kept, width, ["x", "key"], cell)
    key_type = dict(points.dtypes)["key"]
    queries = checkpointed(cells.routed(asked.select("x").distinct()))
    first = checkpointed(_searched(cells.points, queries, k, key_type))
    own = first.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("bound")).where(F.col("n") >= k).select("x", "bound")
    above = cells.boxes[0]
    for more in cells.boxes[1:]:
        above = above.unionByName(more)
    # a cell with fewer than k points bounds nothing; the nearest box above it that has them does
    wider = queries.join(own, "x", "left_anti").select("x", F.col("cell").alias("own"), F.explode("cells").alias("cell")).join(if_few(above), "cell").where((F.col("n") >= k) | (F.col("parent") == -1))
    wider = wider.groupBy("x", "own").agg(F.min(_gap(width, far=True)).alias("bound"))
    bounds = checkpointed(queries.select("x", F.col("cell").alias("own")).join(own, "x").select("x", "own", "bound").unionByName(wider.select("x", "own", "bound")))
    more = _searched(cells.points, visited_cells(cells, bounds), k, key_type)
    return _best(first.unionByName(more), k).select("x", "rank", "d", "key", "label")


def knn_classify(train: DataFrame, test: DataFrame, columns: list[str], label: str, key: str, k: int = 5, cell: int = CELL) -> DataFrame:
    """key, prediction: the commonest label of the k nearest (ties: nearer, then smaller key; among labels the smaller).

    Rows with a null number take no part.
    """
    points = as_points(train, columns, key=F.col(key), label=F.col(label).cast("string"))
    asked = checkpointed(as_points(test, columns, **{key: F.col(key)}))
    found = nearest(points, asked, len(columns), k, cell)
    votes = found.groupBy("x", "label").agg(F.count(F.lit(1)).alias("v"))
    winner = votes.groupBy("x").agg(F.min_by("label", F.struct(-F.col("v"), "label")).alias("prediction"))
    return asked.join(winner, "x").select(key, "prediction")


# density clusters


def _within(points: DataFrame, probes: DataFrame, eps: float, block: int) -> DataFrame:
    """probes with n, the weight (w) of points within eps in the cell that they ask for; a row for each block of it that has some.

    A cell's points are dealt to blocks of about so many rows and its probes copied to each; a task takes several blocks, so that
    small cells don't make small tasks.
    """
    points = points.select("cell", "x", "w")
    sizes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    facts = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("points"), F.count(F.lit(1)).alias("cells")).first()
    tasks, sizes = max(1, facts.points // (4 * block)), F.broadcast(sizes) if facts.cells <= FEW else sizes
    blocks = F.ceil(F.col("_n") / block).cast("int")
    spot = lambda c, b: F.xxhash64(c, b)
    kept = points.join(sizes, "cell").withColumn("_spot", spot("cell", F.pmod(F.xxhash64("x"), blocks).cast("int"))).select("cell", "x", "w", "_spot", F.pmod("_spot", F.lit(tasks)).alias("_task"))
    sent = probes.join(sizes, "cell").withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("_spot", spot("cell", F.col("_b")))
    sent = sent.select(*(F.col(c).alias(f"p_{c}") for c in probes.columns), F.col("_spot").alias("p_spot"), F.pmod("_spot", F.lit(tasks)).alias("p_task"))
    named = [c for c in probes.columns if c not in ("x", "cell")]

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({c: [] for c in [*named, "n"]}, dtype=object)
        own = own.sort_values("_spot", ignore_index=True)
        x, p, w = np.stack(own["x"].to_numpy()), np.stack(asked["p_x"].to_numpy()), own["w"].to_numpy()
        low, high = (np.searchsorted(own["_spot"].to_numpy(), asked["p_spot"].to_numpy(), side) for side in ("left", "right"))
        cells = own["cell"].to_numpy()
        same = [a < b and tuple(cells[a]) == tuple(c) for a, b, c in zip(low.tolist(), high.tolist(), asked["p_cell"], strict=True)]
        size = np.where(same, high - low, 0)
        total, n, at = np.cumsum(size), np.zeros(len(asked), np.int64), 0
        while at < len(asked):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")))
            which = np.repeat(np.arange(at, to), size[at:to])
            other = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
            near = sum((p[which, i] - x[other, i]) ** 2 for i in range(x.shape[1])) <= eps * eps
            n[at:to] = np.bincount(which[near] - at, weights=w[other[near]], minlength=to - at)
            at = to
        hit = n > 0
        return asked.loc[hit, [f"p_{c}" for c in named]].rename(columns=lambda c: c[2:]).astype(object).assign(n=n[hit])

    types = dict(probes.dtypes)
    return kept.groupBy("_task").cogroup(sent.groupBy("p_task")).applyInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in named), "n long"]))


def _cell_pairs(cells: DataFrame, side: float, eps: float, width: int) -> DataFrame:
    """a, b: ordered pairs of different cells that points within eps can lie in; found by their first two places, then by all."""
    reach, keyed = int(np.ceil(eps / side)), min(width, 2)
    place = lambda c: F.array(*(F.get(c, F.lit(i)) for i in range(keyed)))
    offsets = F.array(*(F.array(*(F.lit(v).cast("long") for v in o)) for o in product(range(-reach, reach + 1), repeat=keyed)))
    left = cells.select(F.col("cell").alias("a"), F.explode(F.transform(offsets, lambda o: F.zip_with(place("cell"), o, lambda x, y: x + y))).alias("_p"))
    right = cells.select(F.col("cell").alias("b"), place("cell").alias("_p"))
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, v: s + v * v)
    return left.join(right, "_p").where((F.col("a") != F.col("b")) & (apart * (side * side) <= eps * eps * (1 + 1e-9))).select("a", "b")


def united(links: DataFrame, nodes: DataFrame, few: int = FEW) -> DataFrame:
    """node, root: the least node of each component of links (a, b), for all nodes.

    Few links are united by one task; more spread the least node by labels and hops until nothing changes.
    """
    if links.limit(few + 1).count() <= few:

        def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parent: dict = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for frame in frames:
                for a, b in zip(frame["a"].map(tuple) if frame["a"].dtype == object else frame["a"], frame["b"].map(tuple) if frame["b"].dtype == object else frame["b"], strict=True):
                    a, b = sorted((root(a), root(b)))
                    parent[b] = a
            own = list(parent)
            plain = lambda v: list(v) if isinstance(v, tuple) else v
            yield pd.DataFrame({"node": [plain(v) for v in own], "root": [plain(root(v)) for v in own]}, dtype=object)

        kind = dict(links.dtypes)["a"]
        roots = links.select("a", "b").coalesce(1).mapInPandas(forest, f"node {kind}, root {kind}")
        return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(nodes.withColumn("root", F.col("node")))
    while True:
        spread = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("least"))
        moved = checkpointed(labels.join(spread, labels.node == spread.a, "left").select("node", F.least("root", F.coalesce("least", "root")).alias("new"), "root"))
        hop = moved.select(F.col("node").alias("new"), F.col("new").alias("hop"))
        after = checkpointed(moved.join(hop, "new", "left").select("node", F.least("new", F.coalesce("hop", "new")).alias("root"), F.col("root").alias("was")))
        changed = not after.where("root <> was").isEmpty()
        discard(moved, labels)
        labels = after
        if not changed:
            return labels.select("node", "root")
        kept, labels = after._written_at, after.drop("was")
        labels._written_at = kept


def _parts(points: DataFrame, side: float, width: int, level: int) -> DataFrame:
    """cell, part, low, high, n and least (id) of the parts of cells that are halved level times along all dimensions."""
    place = F.transform("x", lambda v, i: F.floor((v / side - F.get("cell", i)) * (1 << level)))
    extent = [F.array(*(f(F.get("x", F.lit(i))) for i in range(width))).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    return checkpointed(points.groupBy("cell", place.alias("part")).agg(*extent, F.count(F.lit(1)).alias("n"), F.min("id").alias("least")))


def _undecided(points: DataFrame, whole: DataFrame, pairs: DataFrame, eps: float, side: float, width: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of cells that boxes prove linked, pairs of parts of cells that only points can tell).

    A pair whose boxes are nowhere farther apart than eps is linked, and one whose boxes are everywhere farther is not. What is
    left is halved along all dimensions, as long as a part has more than block points. whole has the cells as they are.
    """
    linked, leaves, level, parts = None, None, 0, whole
    rows = pairs.select("a", "b", *(F.array_repeat(F.lit(0).cast("long"), width).alias(c) for c in ("pa", "pb")))
    gap = lambda i: F.greatest(F.get("lowb", F.lit(i)) - F.get("higha", F.lit(i)), F.get("lowa", F.lit(i)) - F.get("highb", F.lit(i)), F.lit(0.0))
    span = lambda i: F.greatest(F.abs(F.get("higha", F.lit(i)) - F.get("lowb", F.lit(i))), F.abs(F.get("highb", F.lit(i)) - F.get("lowa", F.lit(i))))
    square = lambda f: sum((f(i) * f(i) for i in range(width)), F.lit(0.0))
    while True:
        for s in "ab":
            own = parts.select(F.col("cell").alias(s), F.col("part").alias(f"p{s}"), F.col("low").alias(f"low{s}"), F.col("high").alias(f"high{s}"), F.col("n").alias(f"n{s}"))
            rows = rows.join(own, [s, f"p{s}"])
        wide = (F.col("na") > block) | (F.col("nb") > block)
        rows = checkpointed(rows.select("a", "b", "pa", "pb", wide.alias("wide"), (square(span) <= eps * eps).alias("sure")).where(F.col("sure") | (square(gap) <= eps * eps)))
        sure = rows.where("sure").select("a", "b").distinct()
        linked = sure if linked is None else linked.unionByName(sure)
        left = rows.where("not sure").join(sure, ["a", "b"], "left_anti") if level else rows.where("not sure")
        small = left.where(~F.col("wide")).select("a", "b", "pa", "pb").withColumn("level", F.lit(level))
        leaves = small if leaves is None else leaves.unionByName(small)
        rows = left.where("wide").select("a", "b", "pa", "pb")
        level += 1
        if level > 30 or rows.isEmpty():  # parts of a cell's 2^-30 can't be told apart and go to points as they are
            return linked, leaves.unionByName(rows.withColumn("level", F.lit(level - 1)))
        parts = _parts(points, side, width, level)
        corners = F.array(*(F.array(*(F.lit(v).cast("long") for v in o)) for o in product((0, 1), repeat=width)))
        halves = lambda s: F.transform(corners, lambda o: F.zip_with(f"p{s}", o, lambda p, v: 2 * p + v))
        for s in "ab":
            rows = rows.withColumn(f"p{s}", F.explode(halves(s)))


def _linked_by_points(core: DataFrame, pairs: DataFrame, eps: float, side: float, block: int) -> DataFrame:
    """a, b of the pairs of parts of cells that hold core points within eps of each other."""
    place = F.transform("x", lambda v, i: F.floor((v / side - F.get("cell", i)) * F.call_function("shiftleft", F.lit(1), F.col("level"))))
    sides = []
    for s in "ab":
        wanted = pairs.select(F.col(s).alias("cell"), F.col(f"p{s}").alias("part"), "level").distinct()
        sides.append(core.join(wanted, "cell").where(place == F.col("part")).select("x", "w", "cell", "part", "level"))
    spot = lambda cell, part: F.concat(cell, part, F.array(F.col("level").cast("long")))
    own = sides[1].select("x", "w", spot("cell", "part").alias("cell"))
    asked = sides[0].select("x", F.col("cell").alias("a"), F.col("part").alias("pa"), "level").join(pairs, ["a", "pa", "level"]).select("x", "a", "b", spot("b", "pb").alias("cell"))
    return _within(own, asked, eps, block).select("a", "b").distinct()


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, min_samples: int, block: int = CELL) -> DataFrame:
    """key, cluster: the smallest key of the cluster's core points, -1 for noise.

    Cells have sides of eps / sqrt(d), so points of a cell are all neighbours: a cell with min_samples rows is core as a whole, and
    only the few points of other cells are compared with their surroundings. Clusters are components of the graph of cells with core points,
    two of which are linked if their closest core points lie within eps. Equal points are one weighted point. Large cells are
    dealt to blocks, so no task holds a cell.
    """
    width = len(columns)
    side = eps / width**0.5
    raw = as_points(df, columns, key=F.col(key))
    cell = F.transform("x", lambda v: F.floor(v / side))
    points = checkpointed(raw.groupBy("x").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("w")).withColumn("cell", cell))
    cells = checkpointed(points.groupBy("cell").agg(F.sum("w").alias("own")))
    near = checkpointed(_cell_pairs(cells, side, eps, width))
    sparse = checkpointed(points.join(cells.where(F.col("own") < min_samples), "cell"))
    probes = sparse.select("id", "x", F.col("cell").alias("a")).join(near, "a").select("id", "x", F.col("b").alias("cell"))
    around = _within(points, probes, eps, block).groupBy("id").agg(F.sum("n").alias("n"))
    judged = checkpointed(sparse.join(around, "id", "left").select("id", "x", "w", "cell", ((F.col("own") + F.coalesce("n", F.lit(0))) >= min_samples).alias("core")))
    dense = points.join(cells.where(F.col("own") >= min_samples).select("cell"), "cell", "left_semi")
    core = checkpointed(dense.select("id", "x", "w", "cell").unionByName(judged.where("core").drop("core")))
    whole = _parts(core, side, width, 0)
    pairs = near.where(F.col("a") < F.col("b"))
    for s in "ab":
        pairs = pairs.join(whole.select(F.col("cell").alias(s)), s, "left_semi")
    linked, left = _undecided(core, whole, pairs, eps, side, width, block)
    links = checkpointed(linked.unionByName(_linked_by_points(core, left, eps, side, block)))
    roots = united(links, whole.select(F.col("cell").alias("node")))
    labels = roots.join(whole.select(F.col("cell").alias("node"), "least"), "node")
    named = checkpointed(labels.join(labels.groupBy("root").agg(F.min("least").alias("cluster")), "root").select(F.col("node").alias("cell"), "cluster"))
    # a point that isn't core belongs to the least cluster with a core point within eps; in its own cell all are
    edge = judged.where("not core").select("id", "x", F.col("cell").alias("a"))
    inner = edge.join(named, edge.a == named.cell).select("id", "cluster")
    reached = edge.join(near, "a").select("id", "x", F.col("b").alias("cell")).join(named, "cell")
    border = inner.unionByName(_within(core, reached, eps, block).select("id", "cluster")).groupBy("id").agg(F.min("cluster").alias("cluster"))
    found = core.join(named, "cell").select("id", "cluster").unionByName(border)
    by_point = points.join(found, "id", "left").select("x", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return raw.join(by_point, "x").select(F.col("key").alias(key), "cluster")
