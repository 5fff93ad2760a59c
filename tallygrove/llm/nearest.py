"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree splits a sample of vectors into BRANCH clusters again and again. Every vector goes to the leaf
that it reaches by nearest centroids. A query takes nodes from a priority queue, nearest centroid first,
and so visits leaves in order of promise; how many is widened until the recall measured against brute
force, over all vectors, of CALIBRATION queries reaches RECALL.

Scale: the tree is fitted on the driver on at most SAMPLE vectors taken by a hash; all vectors are
indexed. Leaves that hold far more than LEAF entries are split in tasks, each on a sample of FIT of its own entries, again
and again, so the tree grows with the table up to about LEAVES leaves, which bounds what is sent around; beyond that, leaves grow. Equal vectors are one entry with their neighbours + 1 smallest ids, more of which can't be in a
result, so a common vector costs no more than a rare one. Leaves stand on shelves of about BLOCK entries; a
shelf's leaves that a query visits are compared in one task, for BLOCK queries at most, and leave the
query's few best rows. A leaf too large for a shelf is split.

Defined cases: vectors that are null, zero, of another than the commonest length, or that hold a null or
a non-finite number take no part, nor do rows with a null id; repeated rows count once; ties go to the
smaller id; an empty table, or one of empty arrays, gives no rows; with fewer candidates all are returned; extra columns aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed, discard
from ._sample import hashed_sample

SAMPLE, BRANCH, LEAF, CALIBRATION, RECALL, BLOCK, VISITING = 50_000, 8, 100, 100, 0.95, 4096, 128
FIT, LEAVES, WIDE = 4000, 40_000, 4  # rows that one leaf's subtree is fitted on; leaves at most, about; leaves of over WIDE times the wanted size are split


class KMeansTree:
    """Centroids and children by node; leaves are numbered in leaf_of (-1 for inner nodes)."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 5):
        self.rng, self.centroids, self.children, self.leaf_of = np.random.default_rng(seed), [sample.mean(axis=0)], [[]], [-1]
        self.branch, self.leaves, work = branch, 0, [(0, np.arange(len(sample)))]
        while work:
            node, own = work.pop()
            groups = self._split(sample[own]) if len(own) > leaf else None
            if groups is None:
                self.leaf_of[node], self.leaves = self.leaves, self.leaves + 1
                continue
            for g in range(groups.max() + 1):
                mine = own[groups == g]
                if len(mine):
                    self.centroids.append(sample[mine].mean(axis=0))
                    self.children.append([])
                    self.leaf_of.append(-1)
                    self.children[node].append(len(self.centroids) - 1)
                    work.append((len(self.centroids) - 1, mine))
        self.centroids = np.array(self.centroids)

    def graft(self, leaf: int, nodes: list[tuple[list[int], np.ndarray]]) -> None:
        """Puts a subtree (children and centroid of each node, the root first) in a leaf's place; number() must follow."""
        root, base = self._node_of[leaf], len(self.children) - 1
        at = lambda k: base + k if k else root
        self.children[root] = [at(k) for k in nodes[0][0]]
        self.children += [[at(k) for k in kids] for kids, _ in nodes[1:]]
        self._grafted = [*getattr(self, "_grafted", ()), *(c for _, c in nodes[1:])]

    def nodes_of_leaves(self) -> None:
        self._node_of = {leaf: node for node, leaf in enumerate(self.leaf_of) if leaf >= 0}

    def number(self) -> None:
        """Numbers the leaves anew."""
        if grafted := getattr(self, "_grafted", None):
            self.centroids = np.vstack([self.centroids, *grafted])
        self._grafted, self._node_of, self.leaves, self.leaf_of = [], {}, 0, []
        for kids in self.children:
            self.leaf_of.append(-1 if kids else self.leaves)
            self.leaves += not kids

    def _split(self, x: np.ndarray, rounds: int = 12) -> np.ndarray | None:
        centres = x[self.rng.choice(len(x), min(self.branch, len(x)), replace=False)]
        for _ in range(rounds):
            near = ((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]).argmin(axis=1)
            centres = np.array([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        return near if len(np.unique(near)) > 1 else None

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector reaches."""
        node, moving = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(moving):
            at = node[moving]
            stay = np.array([self.leaf_of[k] >= 0 for k in at.tolist()], dtype=bool)
            moving, at = moving[~stay], at[~stay]
            for k in np.unique(at).tolist():
                own, kids = moving[at == k], np.array(self.children[k])
                node[own] = kids[((x[own][:, None, :] - self.centroids[kids][None, :, :]) ** 2).sum(axis=2).argmin(axis=1)]
        return np.array([self.leaf_of[k] for k in node.tolist()], dtype=np.int32)

    def visits(self, q: np.ndarray, leaves: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: so many, and more until they hold at least so many entries by sizes."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < leaves or held < least):
            _, node = heapq.heappop(queue)
            if self.leaf_of[node] >= 0:
                out.append(self.leaf_of[node])
                held += int(sizes[out[-1]]) if sizes is not None else 0
            for kid, d in zip(self.children[node], ((self.centroids[self.children[node]] - q) ** 2).sum(axis=1).tolist() if self.children[node] else (), strict=True):
                heapq.heappush(queue, (d, kid))
        return out


def _encoded(size: int):
    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            raw = flat.tobytes()
            step = 8 * size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[k * step : (k + 1) * step] for k in range(batch.num_rows)], pa.binary())], names=["vec_id", "vec"])

    return run


def vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id and vec (64-bit floats as bytes) of the rows that take part, and their length."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = common.n if common else 0
    return rows.where(F.size("v") == size).mapInArrow(_encoded(size), "vec_id long, vec binary"), size


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, size)


def _gathered(most: int):
    """Of one task's rows, each distinct vector with its smallest ids."""

    def run(batches):
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seen.setdefault(v, [])
                if len(own) < most or i < own[-1]:
                    if i not in own:
                        own.append(i)
                        own.sort()
                        del own[most:]
        items = list(seen.items())
        for at in range(0, len(items), 5000):
            some = items[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in some], pa.binary()), pa.array([x for _, x in some], pa.list_(pa.int64()))], names=["vec", "ids"])

    return run


def _placed(tree: KMeansTree, size: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaf(_matrix(batch.column(0).to_pylist(), size)), pa.int32())], names=["vec", "ids", "leaf"])

    return run


def grown(tree: KMeansTree, entries: DataFrame, size: int, leaf: int = LEAF, most: int = LEAVES) -> DataFrame:
    """entries (vec, ids, leaf) by the tree, whose wide leaves have been split as long as that makes more leaves."""
    spark, schema = entries.sparkSession, "leaf int, node int, kids array<int>, centroid binary"
    while True:
        sizes = {r["leaf"]: r["count"] for r in entries.groupBy("leaf").count().collect()}  # a row a leaf
        wanted = max(leaf, -(-sum(sizes.values()) // most))
        wide = [(k, n) for k, n in sizes.items() if n > WIDE * wanted]
        if not wide or tree.leaves >= 2 * most:
            return entries

        def fitted(frame: pd.DataFrame) -> pd.DataFrame:
            x, (own, n) = _matrix(frame["vec"].sort_values(), size), frame[["leaf", "n"]].iloc[0].tolist()
            sub = KMeansTree(x, leaf=max(2, round(wanted * len(x) / n)))
            return pd.DataFrame({"leaf": own, "node": range(len(sub.children)), "kids": sub.children, "centroid": [c.tobytes() for c in sub.centroids]})

        of_leaf = F.broadcast(spark.createDataFrame(wide, "leaf int, n long"))
        place = F.pmod(F.xxhash64("vec", F.lit(7)), F.lit(1 << 30)) * F.col("n")
        picked = entries.select("vec", "leaf").join(of_leaf, "leaf").where(place < F.lit(FIT * (1 << 30)))
        found = picked.groupBy("leaf").applyInPandas(fitted, schema).orderBy("leaf", "node").toPandas()
        before = tree.leaves
        tree.nodes_of_leaves()
        for k, own in found.groupby("leaf"):
            if len(own) > 1:
                tree.graft(int(k), [(list(map(int, kids)), np.frombuffer(c, np.float64)) for kids, c in zip(own["kids"], own["centroid"], strict=True)])
        tree.number()
        if tree.leaves == before:
            return entries
        narrow = checkpointed(entries.select("vec", "ids").mapInArrow(_placed(tree, size), "vec binary, ids array<long>, leaf int"))
        discard(entries)
        entries = narrow


def _nearest(queries: np.ndarray, x: np.ndarray, ids: list, most: int):
    """For each query its best (distance, id) among entries, ties to smaller ids."""
    for k, q in enumerate(queries):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        near = np.flatnonzero(d <= np.partition(d, most - 1)[most - 1]) if len(d) > most else np.arange(len(d))
        for distance, i in sorted((float(d[e]), i) for e in near.tolist() for i in ids[e])[:most]:
            yield k, distance, i


def _truth(queries: np.ndarray, size: int, most: int):
    """The nearest entries of each calibration query among one task's, with their leaves."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, leaf = _matrix(batch.column(0).to_pylist(), size), batch.column(2).to_pylist()
            found = list(_nearest(queries, x, [[k] for k in range(len(x))], most))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64()), pa.array([leaf[f[2]] for f in found], pa.int32())], names=["q", "d", "leaf"])

    return run


def calibrated(tree: KMeansTree, entries: DataFrame, queries: np.ndarray, neighbours: int, recall: float) -> int:
    """The fewest leaves at which the queries' recall, against brute force over all entries, reaches recall."""
    found = entries.mapInArrow(_truth(queries, queries.shape[1], neighbours + 1), "q int, d double, leaf int")
    found = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "leaf"))), 1, neighbours + 1).alias("near")).collect()
    needed = []
    for row in found:
        order = {leaf: k for k, leaf in enumerate(tree.visits(queries[row.q], tree.leaves))}
        needed += [order[n.leaf] + 1 for n in row.near[1:]]  # the first is the query itself
    return int(np.quantile(needed, recall, method="inverted_cdf")) if needed else tree.leaves


def nearest_neighbours(table: DataFrame, query_rows, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = 10, recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) for the rows that the condition query_rows on vec_id picks."""
    rows, size = vectors(table, id_col, vector_col)
    empty = "query_id long, rank int, vec_id long, score double"
    if not size:
        return table.sparkSession.createDataFrame([], empty)
    most = neighbours + 1
    local = rows.mapInArrow(_gathered(most), "vec binary, ids array<long>")
    entries = local.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))
    entries = checkpointed(entries)
    picked = hashed_sample(entries.select("vec"), F.xxhash64("vec"), sample, entries.count()).toPandas()["vec"]
    tree = KMeansTree(_matrix(picked, size), leaf=leaf)
    entries = checkpointed(entries.mapInArrow(_placed(tree, size), "vec binary, ids array<long>, leaf int"))
    entries = grown(tree, entries, size, leaf)
    asked = checkpointed(rows.where(query_rows).distinct())
    distinct = asked.groupBy("vec").agg(F.min("vec_id").alias("q"))
    trial = hashed_sample(distinct, F.xxhash64("vec", "q"), CALIBRATION, distinct.count()).toPandas()["vec"]
    if not len(trial):
        return table.sparkSession.createDataFrame([], empty)
    leaves = calibrated(tree, entries, _matrix(trial, size), neighbours, recall)

    sizes = entries.groupBy("leaf").count().toPandas().set_index("leaf")["count"].reindex(range(tree.leaves), fill_value=0).to_numpy()
    shelf_of = np.cumsum(sizes) // BLOCK  # leaves next to each other share a shelf of about BLOCK entries
    parts = np.maximum(1, -(-np.bincount(shelf_of, weights=sizes).astype(int) // (2 * BLOCK))).tolist()

    def visiting(batches):
        for batch in batches:
            rows = []
            for k, q in enumerate(_matrix(batch.column(0).to_pylist(), size)):
                by_shelf: dict[int, list[int]] = {}
                for leaf in tree.visits(q, leaves, sizes, most):
                    by_shelf.setdefault(int(shelf_of[leaf]), []).append(leaf)
                rows += [(k, s, v) for s, v in by_shelf.items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["vec", "q", "shelf", "leaves"])

    visits = checkpointed(distinct.repartition(max(1, -(-distinct.count() // VISITING)), "vec").mapInArrow(visiting, "vec binary, q long, shelf int, leaves array<int>"))
    askers = visits.groupBy("shelf").count().toPandas().set_index("shelf")["count"].reindex(range(len(parts)), fill_value=0).to_numpy()
    spark = table.sparkSession  # two tables with a row a leaf or a shelf
    on_shelf = F.broadcast(spark.createDataFrame([(k, int(s)) for k, s in enumerate(shelf_of)], "leaf int, shelf int"))
    counts = list(zip(range(len(parts)), parts, np.maximum(1, -(-askers // BLOCK)).tolist(), strict=True))
    shelves = lambda: F.broadcast(spark.createDataFrame(counts, "shelf int, entry_parts int, query_parts int"))
    spread = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    split = lambda key, count: F.pmod(F.xxhash64(key), count).cast("int")
    left = entries.join(on_shelf, "leaf").join(shelves(), "shelf").withColumn("i", split("vec", F.col("entry_parts"))).withColumn("j", spread(F.col("query_parts"))).drop("entry_parts", "query_parts")
    right = visits.join(shelves(), "shelf").withColumn("j", split("q", F.col("query_parts"))).withColumn("i", spread(F.col("entry_parts"))).drop("entry_parts", "query_parts")

    def compared(entry: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(entry) and len(query):
            entry = entry.sort_values("leaf")
            x, ids, leaf = _matrix(entry["vec"], size), entry["ids"].tolist(), entry["leaf"].to_numpy()
            for k, (q, own) in enumerate(zip(_matrix(query["vec"], size), query["leaves"], strict=True)):
                at = np.flatnonzero(np.isin(leaf, own))
                found += [(k, d, i) for _, d, i in _nearest(q[None, :], x[at], [ids[e] for e in at.tolist()], most)]
        return pd.DataFrame({"q": query["q"].to_numpy()[[f[0] for f in found]] if found else np.zeros(0, np.int64), "score": np.array([f[1] for f in found], float), "vec_id": np.array([f[2] for f in found], np.int64)})

    keys = ["shelf", "i", "j"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compared, "q long, score double, vec_id long")
    best = best.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, most).alias("near"))
    named = asked.join(distinct.withColumnRenamed("q", "_q"), "vec").select("_q", F.col("vec_id").alias("query_id"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, neighbours)
    found = named.join(best, named._q == best.q).select("query_id", F.posexplode(others).alias("k", "x"))
    return found.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op7_kmeans_tree_search(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
