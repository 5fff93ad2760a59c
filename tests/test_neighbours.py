"""Nearest neighbours and density clusters against brute force, with cells, blocks and parts small enough to be split."""

import collections
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import neighbours


def frame(spark, points, labels=None):
    names = [f"c{i}" for i in range(points.shape[1])]
    rows = [(k, *map(float, p), *([labels[k]] if labels else [])) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, ["key", *names, *(["label"] if labels else [])]), names


@pytest.mark.parametrize(("n", "width", "cell"), [(400, 2, 20), (300, 1, 10), (500, 3, 16), (7, 2, 2)])
def test_knn_equals_brute_force(spark, n, width, cell):
    rng = np.random.default_rng(n)
    x, asked = np.round(rng.normal(size=(n, width)), 1 if width < 3 else 2), np.round(rng.normal(size=(40, width)), 1)
    asked[0], asked[1] = 50, asked[2]
    labels = ["abc"[k % 3] for k in range(n)]
    train, names = frame(spark, x, labels)
    got = {r.key: r.prediction for r in neighbours.knn_classify(train, frame(spark, asked)[0], names, "label", "key", 5, cell).collect()}
    for q, row in enumerate(asked):
        near = sorted((np.sqrt(((row - y) ** 2).sum()), k, labels[k]) for k, y in enumerate(x))[:5]
        votes = collections.Counter(label for _, _, label in near)
        assert got[q] == min(votes, key=lambda v: (-votes[v], v))


def test_knn_of_equal_points_nulls_and_empty_tables(spark):
    schema = "key long, x double, label string"
    train = spark.createDataFrame([(k, 1.0, "b" if k < 3 else "a") for k in range(500)] + [(900, None, "z"), (901, float("nan"), "z"), (902, 9.0, None)], schema)
    test = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 9.0, None)], schema)
    assert {r.key: r.prediction for r in neighbours.knn_classify(train, test, ["x"], "label", "key", 5, 4).collect()} == {1: "b", 3: "b"}
    assert neighbours.knn_classify(train.where("false"), test, ["x"], "label", "key").count() == neighbours.knn_classify(train, test.where("false"), ["x"], "label", "key").count() == 0


def test_knn_visits_few_cells(spark):
    rng = np.random.default_rng(1)
    train, names = frame(spark, rng.random((20_000, 2)))
    cells = neighbours.celled(neighbours.as_points(train, names, key=F.col("key")), 2, ["x", "key"], 100)
    sizes = [r.n for r in cells.points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 200 and len(sizes) > 100
    asked = cells.routed(neighbours.as_points(frame(spark, rng.random((200, 2)))[0], names))
    bounds = asked.select("x", F.col("cell").alias("own"), F.lit(0.02).alias("bound"))
    visited = neighbours.visited_cells(cells, bounds).groupBy("x").count().agg(F.max("count")).first()[0]
    assert visited <= 8
    # no point within the bound is in a cell that is not visited
    pairs = neighbours.visited_cells(cells, bounds).select("x", "cell").unionByName(asked.select("x", "cell")).collect()
    known = {(tuple(r.x), r.cell) for r in pairs}
    rows = [(tuple(r.x), r.cell) for r in cells.points.collect()]
    xs = np.array([x for x, _ in rows])
    for q in {x for x, _ in known}:
        for k in np.flatnonzero(((xs - q) ** 2).sum(1) <= 0.02**2):
            assert (q, rows[k][1]) in known


def brute_clusters(points, eps, least):
    near = ((points[:, None] - points[None]) ** 2).sum(-1) <= eps * eps
    core, root = near.sum(1) >= least, -np.ones(len(points), int)
    for k in range(len(points)):
        if core[k] and root[k] < 0:
            stack, root[k] = [k], k
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if root[j] < 0:
                        root[j] = k
                        stack.append(j)
    return [int(root[k]) if core[k] else int(min(root[np.flatnonzero(near[k] & core)], default=-1)) for k in range(len(points))]


# plain; cells in parts and links by labels; one column; three columns; one large cluster in small parts
@pytest.mark.parametrize(("n", "width", "eps", "least", "block", "few"), [(300, 2, 0.15, 4, 2048, 200_000), (300, 2, 0.3, 4, 8, 0), (200, 1, 0.02, 3, 4, 200_000), (400, 3, 0.5, 5, 16, 200_000), (500, 2, 1.5, 4, 20, 0)])
def test_dbscan_equals_brute_force(spark, monkeypatch, n, width, eps, least, block, few):
    monkeypatch.setattr(neighbours.united, "__defaults__", (few,))
    points = np.round(np.random.default_rng(n + width).normal(size=(n, width)), 2)
    df, names = frame(spark, points)
    assert [r.cluster for r in neighbours.dbscan(df, "key", names, eps, least, block).orderBy("key").collect()] == brute_clusters(points, eps, least)


def test_dbscan_of_dense_cells_takes_seconds(spark):
    df, names = frame(spark, np.random.default_rng(0).random((100_000, 2)) * [1.4, 0.7])
    began = time.monotonic()
    assert [tuple(r) for r in neighbours.dbscan(df, "key", names, 1.0, 5).groupBy("cluster").count().collect()] == [(0, 100_000)]
    assert time.monotonic() - began < 60


def test_dbscan_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0), (4, None), (5, 9.0)], "key long, x double")
    assert sorted(tuple(r) for r in neighbours.dbscan(df, "key", ["x"], 0.5, 3).collect()) == [(1, 1), (2, 1), (3, 1), (5, -1)]
    assert neighbours.dbscan(df.where("false"), "key", ["x"], 0.5, 3).count() == 0
