"""Distributed DBSCAN and k-means against the same in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold import operators as O
from terrafold.functions import native
from terrafold.geom import cluster
from terrafold.operators.tables import Tables, components, numbered


def points(rng, kind):
    if kind == "blobs":
        p = np.vstack([rng.normal(c, 0.4, (120, 2)) for c in ((0, 0), (3, 0), (1.5, 2.6), (20, -7))] + [rng.uniform(-10, 25, (80, 2))])
    elif kind == "grid":  # distances of exactly eps, borders between clusters, copies
        p = np.array([(x, y) for x in range(14) for y in range(14) if (x * 7 + y * 3) % 5], float) / 2
        p = np.vstack([p, p[:40], p[:40]])
    elif kind == "lines":  # long thin clusters whose cells' extreme positions aren't near
        t = np.arange(150)
        p = np.vstack([np.column_stack([t * 0.3, np.sin(t / 9) * 4]), np.column_stack([t * 0.3, np.sin(t / 9) * 4 + 1.4]), np.column_stack([np.full(30, 60.0), np.arange(30) * 0.9])])
    else:  # one crowded spot
        p = np.vstack([rng.normal(0, 0.01, (600, 2)), rng.uniform(-3, 3, (150, 2)), np.zeros((60, 2))])
    return p[rng.permutation(len(p))]


@pytest.mark.parametrize("kind,eps,least", [("blobs", 0.5, 4), ("grid", 0.5, 4), ("lines", 1.0, 2), ("crowd", 0.5, 4)])
def test_dbscan_equals_one_task(spark, kind, eps, least):
    rng = np.random.default_rng(5)
    halves = [points(rng, kind), points(rng, kind)[:200]]
    rows = [(half, i, float(x), float(y)) for half, p in zip(("a", None), halves, strict=True) for i, (x, y) in enumerate(p)]
    df = spark.createDataFrame([*rows, ("a", 10**6, None, None)], "half string, i long, x double, y double").repartition(5)
    df = df.select("half", "i", native.st_point(F.col("x"), F.col("y")).alias("pt"), F.lit("mine").alias("l0"))
    found = O.cluster_dbscan(df, "pt", eps, least, by=["half"], order=["i"], out="c")
    assert found.columns == [*df.columns, "c"]
    got = {(r.half, r.i): r.c for r in found.collect()}
    for half, p in zip(("a", None), halves, strict=True):
        want = cluster.dbscan(p, eps, least).tolist()
        assert [got[half, i] for i in range(len(p))] == [None if n < 0 else n for n in want]
    assert got["a", 10**6] is None and len(got) == len(rows) + 1


def test_dbscan_of_texts_and_nothing(spark):
    t = spark.createDataFrame([(1, "POLYGON((0 0,2 0,2 2,0 2,0 0))"), (2, "POINT(1 1.5)"), (3, "POINT(9 9)"), (4, "POINT EMPTY"), (5, None)], "i int, g string")
    assert {r.i: r.cluster for r in O.cluster_dbscan(t, "g", 1.0, 2).collect()} == {1: 0, 2: 0, 3: None, 4: None, 5: None}
    assert O.cluster_dbscan(t.limit(0), "g", 1.0, 2).count() == 0


def cost(p, labels):
    return sum(((p[labels == k] - p[labels == k].mean(0)) ** 2).sum() for k in np.unique(labels))


def test_kmeans_spread_over_tasks(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.normal(c, 0.5, (200, 2)) for c in ((0, 0), (10, 0), (0, 10), (10, 10), (5, 30))] + [np.full((300, 2), 3.25)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(-1, None, 1.0)], "i long, x double, y double").repartition(6)
    df = df.select("i", native.st_point(F.col("x"), F.col("y")).alias("pt"))
    got = {r.i: r.cluster for r in O.cluster_kmeans(df, "pt", 6, limit=100).collect()}
    assert got.pop(-1) is None and len(got) == len(p)
    labels = np.array([got[i] for i in range(len(p))])
    assert cost(p, labels) <= 1.001 * cost(p, cluster.kmeans(p, 6))
    assert all(len(set(labels[a : a + 200])) == 1 for a in range(0, 1000, 200)) and len(set(labels)) == 6
    again = {r.i: r.cluster for r in O.cluster_kmeans(df.repartition(3), "pt", 6, limit=100).collect()}
    assert all(again[i] == got[i] for i in got)  # the same starts, however the rows are dealt


def test_kmeans_partitions_of_both_sizes(spark):
    df = spark.range(900).select("id", F.when(F.col("id") < 800, "big").when(F.col("id") < 850, "small").alias("h"), native.st_point(F.col("id") % 2 * 100 + F.col("id") % 7, F.col("id") % 5).alias("pt"))
    got = O.cluster_kmeans(df, "pt", 2, by=["h"], order=["id"], limit=500).collect()
    assert len(got) == 900
    for h in ("big", "small", None):
        assert len({(r.id % 2, r.cluster) for r in got if r.h == h}) == 2
    with pytest.raises(Exception, match="k must be"):
        O.cluster_kmeans(df, "pt", 700, limit=600, by=["h"]).collect()
    few = spark.range(50).select(native.st_point(F.lit(1), F.lit(2)).alias("pt"))
    assert {r.cluster for r in O.cluster_kmeans(few, "pt", 3, limit=10).collect()} <= {0, 1, 2}


def test_components_and_numbers(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    t = Tables(spark)
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), t).collect()}
    assert all(got.get(i, i) == i - i % 20 for i in range(60)) and got[100] == 0 and got[201] == got[202] == 200 and 300 not in got
    rows = numbered(spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v")).repartition(7), ["v"], t, "n").collect()
    assert all(r.v == r.n for r in rows)


def test_union_along_a_curve(spark):
    """A tiling: what is left of the squares falls from level to level."""
    from terrafold.operators.aggregates import spread_bits, union_by

    got = spark.range(3).select(spread_bits(F.lit(0b1011).cast("long")).alias("v")).first().v
    assert got == 0b1000101
    tiles = spark.range(1024).select((F.col("id") % 2).cast("string").alias("z"), F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d,%d %d))", *[c for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)) for c in (F.col("id") % 32 + dx, F.floor(F.col("id") / 32) + dy)]).alias("g"))
    from terrafold.functions import call

    for fan in (4, 64, 5000):
        u = union_by(tiles, [], "g", "u", fan=fan).select(call("ST_Area", F.col("u")).alias("a"), call("ST_NPoints", F.col("u")).alias("n")).collect()
        assert len(u) == 1 and u[0].a == 1024 and u[0].n < 200
    by = {r.z: r.a for r in union_by(tiles.unionByName(tiles).unionByName(spark.createDataFrame([("x", None), ("y", "POINT(1 1)")], "z string, g string")), ["z"], "g", "box", fan=8).select("z", call("ST_Area", F.col("box")).alias("a")).collect()}
    assert by["0"] == by["1"] == 512 and not by["x"] and not by["y"]
    assert union_by(tiles.limit(0), ["z"], "g").count() == 0


def test_shuffled_bytes_fall(spark):
    from terrafold.operators import aggregates

    tiles = spark.range(4096).select(F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d,%d %d))", *[c for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)) for c in (F.col("id") % 64 + dx, F.floor(F.col("id") / 64) + dy)]).alias("g"), F.col("id"))
    sizes = []
    for shift in (2, 4, 6):  # squares of 2, 4 and 8 tiles a side are united
        z = F.shiftright(aggregates.spread_bits(F.col("id") % 64).bitwiseOR(F.shiftleft(aggregates.spread_bits(F.floor(F.col("id") / 64)), 1)), shift)
        level = tiles.groupBy(z.alias("z")).agg(aggregates.st_mem_union(F.col("g")).alias("u"))
        sizes.append(level.agg(F.sum(F.octet_length("u"))).first()[0])
    assert sizes[0] > 1.5 * sizes[1] > 2 * sizes[2]


def test_dbscan_query_equals_its_sql_on_large_keys(spark, tmp_path):
    """Keys beyond 10,000 put the digits' strips on top of each other before."""
    from terrafold.plans import queries as Q

    spark.range(25_000).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.k: r["first"] for r in Q.QUERIES["st_clusterdbscan"](spark, str(tmp_path)).collect()}
    assert got == {k: k % 10 for k in range(25_000)}
