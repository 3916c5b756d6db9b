"""Cluster windows and spatial aggregates as SQL text."""

import pytest
from pyspark.sql import functions as F

from terrafold import operators as O
from terrafold.functions import native, register_all
from terrafold.geom import model
from terrafold.sql import spatial_sql


@pytest.fixture(scope="module")
def crowd(spark):
    register_all(spark)
    i = F.col("id")
    df = spark.range(300).select(i, (i % 3).alias("part"), native.st_point(F.when(i % 29 > 0, (i * 37) % 50 + F.floor(i / 100) * 200), (i * 91) % 50).alias("pt"))
    df = df.withColumn("shape", F.when(F.col("pt").isNotNull(), F.format_string("POINT(%s %s)", F.col("pt.x"), F.col("pt.y")))).withColumn("box", native.st_make_envelope(F.col("pt.x"), F.col("pt.y"), F.col("pt.x") + 1, F.col("pt.y") + 2))
    df.createOrReplaceTempView("crowd")
    return spark


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("g", ["pt", "shape"])
def test_dbscan_window(crowd, g):
    found = spatial_sql(crowd, f"SELECT id, ST_ClusterDBSCAN({g}, 8.5, 4) OVER (PARTITION BY part ORDER BY id) AS c FROM crowd")
    want = O.cluster_dbscan(crowd.table("crowd"), g, 8.5, 4, ["part"], ["id"], "c").select("id", "c")
    assert found.columns == ["id", "c"] and rows(found) == rows(want)
    assert len({r.c for r in want.collect()}) > 3


def test_window_without_partitions_over_expressions(crowd):
    found = spatial_sql(crowd, "SELECT id, ST_ClusterDBSCAN(ST_Translate(ST_Centroid(ST_Buffer(shape, 1)), 0, 0), 8.5, 3) OVER () + 1 AS c FROM crowd WHERE ST_X(pt) < 300")
    want = O.cluster_dbscan(crowd.table("crowd").filter("pt.x < 300"), "pt", 8.5, 3, out="c").select("id", F.col("c") + 1)
    assert {(r[0] is None, r[1] is None) for r in found.collect()} == {(False, False)} and len(found.collect()) == want.count()
    groups = lambda df: sorted(sorted(r[0] for r in df.collect() if r[1] == n) for n in {r[1] for r in df.collect()})
    assert groups(found) == groups(want)


def test_kmeans_beside_built_in_windows(crowd):
    text = "SELECT id, ST_ClusterKMeans(pt, 3) OVER (PARTITION BY part ORDER BY id) AS k, row_number() OVER (PARTITION BY part ORDER BY id) AS n, ST_ClusterDBSCAN(pt, 8.5, 4) OVER (PARTITION BY part ORDER BY id) AS c FROM crowd"
    k = O.cluster_kmeans(crowd.table("crowd"), "pt", 3, ["part"], ["id"], "k")
    want = O.cluster_dbscan(k, "pt", 8.5, 4, ["part"], ["id"], "c").selectExpr("id", "k", "CAST(id DIV 3 + 1 AS INT)", "c")
    assert rows(spatial_sql(crowd, text)) == rows(want)


def test_clusters_feed_the_rest_of_a_statement(crowd):
    text = "WITH t AS (SELECT *, ST_ClusterDBSCAN(pt, 8.5, 4) OVER (PARTITION BY part) AS c FROM crowd) SELECT part, c, count(*) AS n, ST_Extent(pt) AS e FROM t WHERE c IS NOT NULL GROUP BY part, c"
    t = O.cluster_dbscan(crowd.table("crowd"), "pt", 8.5, 4, ["part"], out="c").filter("c IS NOT NULL")
    want = t.groupBy("part", "c").agg(F.count("*"), F.struct(F.min("pt.x"), F.min("pt.y"), F.max("pt.x"), F.max("pt.y"), F.lit(0)))
    tidy = lambda df: sorted((r[0], r[1], r[2], tuple(r[3])) for r in df.collect())
    assert tidy(spatial_sql(crowd, text)) == tidy(want)


def test_windows_that_are_refused(crowd):
    for text, why in (("ST_ClusterDBSCAN(pt, 8.5, 4) OVER (ORDER BY id DESC)", "ascending"), ("ST_ClusterKMeans(pt, id) OVER ()", "constant"), ("ST_ClusterDBSCAN(pt, -1, 4) OVER ()", "positive")):
        with pytest.raises(ValueError, match=why):
            spatial_sql(crowd, f"SELECT {text} AS c FROM crowd")
    with pytest.raises(Exception, match="spatial_sql"):
        crowd.sql("SELECT ST_ClusterKMeans(pt, 2) OVER (PARTITION BY part) AS c FROM crowd").collect()


def test_aggregates_beside_built_in_ones(crowd):
    text = "SELECT part, count(*) AS n, ST_Extent({g}) AS e, max(id) - min(id) AS d, ST_Extent(CASE WHEN id < 100 THEN {g} END) AS low FROM crowd GROUP BY part HAVING count(*) > 1 ORDER BY part"
    want = crowd.table("crowd").groupBy("part").agg(F.count("*"), F.min("pt.x"), F.max("pt.y"), F.max("id") - F.min("id"), F.max(F.when(F.col("id") < 100, F.col("pt.x"))))
    for g in ("pt", "shape"):
        found = spatial_sql(crowd, text.format(g=g))
        assert [(r.part, r.n, r.e.xmin, r.e.ymax, r.d, r.low.xmax) for r in found.collect()] == [tuple(r) for r in want.orderBy("part").collect()]
        assert ("Python" in found._jdf.queryExecution().executedPlan().toString()) == (g == "shape")
    assert spatial_sql(crowd, "SELECT ST_Extent(box) AS e FROM crowd").first().e.xmax == crowd.table("crowd").agg(F.max("box.xmax")).first()[0]


def test_collections_beside_built_in_ones(crowd):
    r = spatial_sql(crowd, "SELECT ST_NumGeometries(ST_Collect(shape)) AS n, count(shape) AS m, count(DISTINCT shape) AS e, ST_Area(ST_MemUnion(ST_Expand(pt, 0.5))) AS a, sum(id) AS s FROM crowd").first()
    assert r.n == r.m and r.s == 299 * 150 and 0 < r.a <= r.e + 1e-6
    none = spatial_sql(crowd, "SELECT ST_Collect(shape) AS c, ST_Extent(pt) AS e, ST_MemUnion(box) AS u, count(*) AS n FROM crowd WHERE id < 0").first()
    assert tuple(none) == (None, None, None, 0)
    one = spatial_sql(crowd, "SELECT ST_Collect(shape) AS c, count(*) AS n FROM crowd WHERE id = 1").first()
    assert one.n == 1 and model.read_wkb(bytes(one.c)).box() is not None


def test_counts_over_a_spatial_join_without_its_pairs(spark, monkeypatch):
    """GROUP BY over a join, and over FROM a, b WHERE with a SQL function in it, which was a cross join before."""
    from terrafold import sql
    register_all(spark)

    spark.sql("SELECT id AS k, CAST(id % 5 AS DOUBLE) AS x, CAST(id % 3 AS DOUBLE) AS y FROM range(60)").createOrReplaceTempView("tf_few")
    spark.sql("SELECT CASE WHEN id % 9 = 0 THEN NULL ELSE id END AS o, ST_Point(id % 8, id % 4) AS pt FROM range(90)").createOrReplaceTempView("tf_many")
    cases = [
        ("FROM tf_few f, tf_many m WHERE ST_Distance(ST_Point(f.x, f.y), m.pt) <= 1 AND m.o % 2 = 0", "FROM tf_few f JOIN tf_many m ON pow(f.x - m.pt.x, 2) + pow(f.y - m.pt.y, 2) <= 1 AND m.o % 2 = 0"),
        ("FROM tf_few f LEFT JOIN tf_many m ON ST_Intersects(ST_Point(f.x, f.y), m.pt) AND m.o >= f.k AND f.k % 4 <> 0", "FROM tf_few f LEFT JOIN tf_many m ON f.x = m.pt.x AND f.y = m.pt.y AND m.o >= f.k AND f.k % 4 <> 0"),
    ]
    used, own = [], sql._added_up
    monkeypatch.setattr(sql, "_added_up", lambda *a: used.append(own(*a)) or used[-1])
    for spatial, plain in cases:
        text = "SELECT f.k % 7 AS g, count(*) AS n, count(m.o) + 1 AS some, sum(m.o) AS total, coalesce(min(m.o), -1) AS low, max(m.o) AS high {} GROUP BY f.k % 7 HAVING count(*) > 2"
        got = sql.spatial_sql(spark, text.format(spatial))
        want = spark.sql(text.format(plain))
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert any(u is not None for u in used)
        used.clear()
