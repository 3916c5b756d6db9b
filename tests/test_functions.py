"""SQL functions, null and type rules, aggregates, clustering and the join, end to end."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from terrafold import operators as O
from terrafold.functions import call, native, register_all
from terrafold.functions import scalar as S
from terrafold.plans import queries as Q

SF = "/root/testdata/sf0.001"
UNIT, SHIFTED = "POLYGON((0 0,1 0,1 1,0 1,0 0))", "POLYGON((0.5 0,1.5 0,1.5 1,0.5 1,0.5 0))"


@pytest.fixture(scope="module")
def sql(spark):
    names = register_all(spark)
    assert len(names) == len({n.lower() for n in names}) >= 121 and register_all(spark) == names

    def run(*expressions, source=""):
        return spark.sql("SELECT " + ", ".join(expressions) + source).collect()[0]
    return run


def test_pinned_values(sql):
    r = sql(
        f"ST_Area(ST_Union('{UNIT}','{SHIFTED}'))", f"ST_Area(ST_Intersection('{UNIT}','{SHIFTED}'))", f"ST_Area(ST_Difference('{UNIT}','{SHIFTED}'))", f"ST_Area(ST_SymDifference('{UNIT}','{SHIFTED}'))",
        f"ST_Area(ST_Buffer('{UNIT}', 0.5))", f"ST_Relate('{UNIT}', 'POINT(.5 .5)', 'T*****FF*')", f"ST_DFullyWithin('{UNIT}', 'POINT(0 0)', 1.0)", f"ST_DFullyWithin('{UNIT}', 'POINT(0 0)', 1.5)",
        "ST_AsText(ST_SnapToGrid('POINT(1.234 5.678)', 0.5))", "ST_Area(ST_DelaunayTriangles('MULTIPOINT(0 0,4 0,4 4,0 4,2 2)'))", "ST_NumGeometries(ST_VoronoiPolygons('MULTIPOINT(0 0,4 0,4 4,0 4,2 2)'))",
        "ST_DistanceSphere('POINT(-0.1278 51.5074)', 'POINT(2.3522 48.8566)')", "ST_DistanceSpheroid('POINT(-0.1278 51.5074)', 'POINT(2.3522 48.8566)')", "ST_GeoHash('POINT(-0.1278 51.5074)', 6)", "length(ST_GeoHash('POINT(0 0)'))",
    )
    assert r[:4] == pytest.approx((1.5, 0.5, 0.5, 1.0)) and r[4] == pytest.approx(3 + math.pi / 4, abs=0.05)
    assert r[5:8] == ("true", False, True) and r[8:11] == ("POINT(1 5.5)", 16.0, 5)
    assert 330e3 < r[11] < 350e3 and 330e3 < r[12] < 350e3 and r[11] != r[12] and r[13:] == ("gcpvj0", 20)
    x, y = sql(*[f"ST_{c}(ST_Transform(ST_SetSRID('POINT(-0.1278 51.5074)', 4326), 3857))" for c in "XY"])
    assert -14300 < x < -14100 and 6710000 < y < 6712000


def test_nulls_empties_and_wrong_types(sql):
    nulls = [f"ST_{n}(CAST(NULL AS STRING))" for n in ("X", "Area", "AsText", "IsValid", "Envelope", "Dump", "NPoints", "SRID", "Buffer".replace("Buffer", "Centroid"))]
    assert set(sql(*nulls, f"ST_Intersects(NULL, '{UNIT}')", "ST_Buffer('POINT(0 0)', NULL)", "ST_Point(NULL, 1)", "ST_MakeEnvelope(1, 2, NULL, 4)")) == {None}
    wrong = ["ST_X('LINESTRING(0 0,1 1)')", "ST_NumPoints('POINT(0 0)')", "ST_StartPoint('POINT(0 0)')", "ST_ExteriorRing('POINT(0 0)')", "ST_MakePolygon('POINT(0 0)')", "ST_FrechetDistance('POINT(0 0)', 'POINT(0 0)')", f"ST_Union('{UNIT}', 'POINT(0 0)')", "ST_PointN('LINESTRING(0 0,1 1)', 0)", "ST_PointN('LINESTRING(0 0,1 1)', 3)", "ST_LineInterpolatePoint('LINESTRING(0 0,1 1)', 1.5)", "ST_RemovePoint('LINESTRING(0 0,1 1)', 0)", "ST_Azimuth('POINT(0 0)', 'POINT(0 0)')", "ST_PointFromGeoHash('ai')", "ST_GeoHash('POINT(999 0)', 5)", "ST_SnapToGrid('POINT(1 1)', 0)", "ST_Segmentize('LINESTRING(0 0,1 1)', 0)", "ST_ChaikinSmoothing('LINESTRING(0 0,1 1)', 9)", "ST_ZMin('POINT Z(0 0 1)')", "ST_XMin('POINT EMPTY')", "ST_Envelope('POINT EMPTY')", "ST_Centroid('POLYGON EMPTY')", "ST_Distance('POINT EMPTY', 'POINT(0 0)')"]
    assert set(sql(*wrong)) == {None}
    assert sql(*[f"ST_{p}('POINT EMPTY', '{UNIT}')" for p in ("Intersects", "Disjoint", "Contains", "Within", "Covers", "CoveredBy")]) == (False, True, False, False, False, False)
    assert math.isnan(sql("ST_MaxDistance('POINT EMPTY', 'POINT(0 0)')")[0])
    for bad, message in (("ST_Area(1)", "not a geometry"), (f"ST_Intersects(ST_SetSRID('{UNIT}', 4326), '{UNIT}')", "cannot mix coordinate reference systems"), (f"ST_Union('{UNIT}')", "expected 2 arguments"), ("ST_GeomFromGeoJSON('{')", "cannot read GeoJSON"), ("ST_GeomFromText('POINT(1')", "cannot read WKT"), ("ST_Transform('POINT(0 0)', 3857)", "known SRID"), ("ST_Relate('POINT(0 0)', 'POINT(0 0)', 'T*')", "nine characters"), ("ST_GeoHash('POINT(0 0)', 21)", "between 1 and 20")):
        with pytest.raises(Exception, match=message):
            sql(bad)


def test_dimensions_travel(sql):
    z = "'LINESTRING ZM(0 0 1 2,3 4 5 6)'"
    assert sql(f"ST_AsText(ST_EndPoint({z}))", f"ST_M(ST_StartPoint({z}))", f"ST_AsText(ST_Force2D({z}))", f"ST_AsText(ST_Force3D('POINT M(1 2 3)'))", f"ST_AsText(ST_Translate({z}, 1, 1))", f"ST_AsText(ST_FlipCoordinates({z}))", f"ST_CoordDim({z})") == (
        "POINT ZM(3 4 5 6)", 2.0, "LINESTRING(0 0,3 4)", "POINT Z(1 2 0)", "LINESTRING ZM(1 1 1 2,4 5 5 6)", "LINESTRING ZM(0 0 1 2,4 3 5 6)", 4)
    assert sql("ST_SRID(ST_GeomFromEWKB(ST_AsEWKB(ST_SetSRID('POINT(1 1)', 4326))))", "ST_SRID(ST_SetSRID(ST_SetSRID('POINT(1 1)', 4326), 0))", "ST_SRID(ST_Buffer(ST_SetSRID('POINT(1 1)', 27700), 1))", "ST_AsText(ST_AddPoint('LINESTRING(0 0,1 1)', 'POINT(2 2)', NULL))", "ST_AsText(ST_AddPoint('LINESTRING(0 0,1 1)', 'POINT(2 2)', 0))", "ST_AddPoint('LINESTRING(0 0,1 1)', 'POINT(2 2)', 5)") == (0, 0, 27700, "LINESTRING(0 0,1 1,2 2)", "LINESTRING(2 2,0 0,1 1)", None)
    assert sql("ST_GeometryType(ST_MakeEnvelope(0, 0, 1, 1))", "ST_NPoints(ST_MakeEnvelope(0, 0, 1, 1))", "ST_AsText(ST_ExteriorRing(ST_MakeEnvelope(0, 0, 1, 1)))") == ("ST_Polygon", 5, "LINESTRING(0 0,1 0,1 1,0 1,0 0)")


def test_column_form_and_constants(spark):
    polygon = "POLYGON((0 0,10 0,10 10,0 10,0 0))"
    pts = spark.range(400).select("id", native.st_point((F.col("id") % 20) - 5, (F.col("id") / 20).cast("int") - 5).alias("p"))
    pts = pts.unionByName(spark.createDataFrame([(999, None)], pts.schema))
    register_all(spark)
    for name in S.PREDICATES:
        for args in ((F.col("p"), polygon), (polygon, F.col("p"))):
            quick = {r.id: r.v for r in pts.select("id", call(name, *args).alias("v")).collect()}
            exact = S.predicate(name)
            from terrafold.geom.model import point, read_wkt

            g = read_wkt(polygon)
            for r in pts.collect():
                want = None if r.p is None else exact(*[g if a is polygon else point(r.p.x, r.p.y) for a in args])
                assert quick[r.id] == want, (name, r)
    with pytest.raises(TypeError, match="must be a constant"):
        call("ST_DWithin", F.col("p"), polygon, F.col("id"))
    plan = pts.select(F.col("p.x"), native.box_area(native.point_box(F.col("p"))))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_aggregates(spark, sql):
    t = spark.createDataFrame([(1, UNIT), (1, SHIFTED), (1, None), (2, None), (3, "POINT(1 1)")], "k int, g string")
    t.createOrReplaceTempView("aggregate_input")
    r = {x.k: x for x in t.groupBy("k").agg(O.st_extent(F.col("g")).alias("e"), F.count(F.lit(1)).alias("n"), call("ST_NPoints", O.st_collect(F.col("g"))).alias("c"), call("ST_Area", O.st_mem_union(F.col("g"))).alias("u")).collect()}
    assert (r[1].e.xmin, r[1].e.xmax, r[1].n, r[1].c, r[1].u) == (0.0, 1.5, 3, 10, 1.5)
    assert (r[2].e, r[2].c, r[2].u) == (None, None, None) and (r[3].c, r[3].u) == (1, None)
    got = spark.sql("SELECT k, ST_AsText(ST_Collect(g)) AS c FROM aggregate_input GROUP BY k").collect()
    assert dict(got)[3] == "POINT(1 1)" and dict(got)[2] is None
    assert spark.sql("SELECT ST_Area(ST_MemUnion(g)) AS a FROM aggregate_input").collect()[0].a == 1.5
    assert spark.sql("SELECT ST_XMax(ST_Extent(g)) AS a FROM aggregate_input").collect()[0].a == 1.5
    from terrafold.operators.aggregates import union_by

    assert union_by(t, ["k"], "g").select("k", call("ST_Area", F.col("geom")).alias("a")).filter("k = 1").collect()[0].a == 1.5


def test_clusters(spark):
    t = spark.createDataFrame([(i, f"POINT({x} {y})") for i, (x, y) in enumerate([(0, 0), (0.1, 0.1), (0.2, 0), (50, 50), (50.1, 50.1), (50.2, 50)])] + [(9, None), (8, "POINT EMPTY")], "i int, g string")
    for out in (O.cluster_kmeans(t, "g", 2, order=["i"]), O.cluster_dbscan(t, "g", 1.0, 2, order=["i"])):
        c = {r.i: r.cluster for r in out.collect()}
        assert c[0] == c[1] == c[2] != c[3] == c[4] == c[5] and c[9] is c[8] is None
    assert {r.cluster for r in O.cluster_dbscan(t, "g", 1.0, 4).collect()} == {None}
    with pytest.raises(Exception, match="k must be"):
        O.cluster_kmeans(t, "g", 7).collect()
    with pytest.raises(ValueError):
        O.cluster_dbscan(t, "g", 0, 2)


def boxes(spark, seed, n, name):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, s = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.5, 6, 6, 6, 60])
        rows.append((i, f"POLYGON(({x} {y},{x + s} {y},{x + s} {y + s},{x} {y + s},{x} {y}))"))
    return spark.createDataFrame([*rows, (n, None), (n + 1, "POLYGON EMPTY")], f"{name}_id int, {name} string")


@pytest.mark.parametrize("pred", [p for p in O.join.JOINABLE if p != "ST_DWithin"])
def test_join_equals_nested_loop(spark, pred):
    register_all(spark)
    a, b = boxes(spark, 1, 60, "a"), boxes(spark, 2, 60, "b")
    if pred == "ST_Equals":
        b = a.withColumnsRenamed({"a_id": "b_id", "a": "b"})
    want = {tuple(r) for r in a.crossJoin(b).filter(F.expr(f"{pred}(a, b)")).select("a_id", "b_id").collect()}
    for cell in (None, 3.0):
        found = [tuple(r) for r in O.spatial_join(a, b, pred, "a", "b", cell=cell).select("a_id", "b_id").collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_other_joins(spark):
    register_all(spark)
    a, p = boxes(spark, 3, 40, "a"), spark.range(80).select("id", native.st_point((F.col("id") * 37) % 100 - 50, (F.col("id") * 91) % 100 - 50).alias("p"))
    inner = {(r.a_id, r.id) for r in O.spatial_join(a, p, "ST_Intersects", "a", "p").collect()}
    assert inner == {(r.a_id, r.id) for r in a.crossJoin(p).filter(F.expr("ST_Intersects(a, p)")).collect()}
    ids, points = {r.a_id for r in a.collect()}, set(range(80))
    hit, met = {i for i, _ in inner}, {j for _, j in inner}
    rows = lambda how: [(r.a_id, r.id) for r in O.spatial_join(a, p, "ST_Intersects", "a", "p", how=how).collect()]
    left, right = inner | {(i, None) for i in ids - hit}, inner | {(None, j) for j in points - met}
    assert set(rows("left")) == left and set(rows("right")) == right and set(rows("full")) == left | right
    assert {r.a_id for r in O.spatial_join(a, p, "ST_Intersects", "a", "p", how="left_semi").collect()} == hit
    assert {r.a_id for r in O.spatial_join(a, p, "ST_Intersects", "a", "p", how="left_anti").collect()} == ids - hit
    near = {(r.a_id, r.id) for r in O.spatial_join(a, p, "ST_DWithin", "a", "p", distance=4.0).collect()}
    assert near == {(r.a_id, r.id) for r in a.crossJoin(p).filter(F.expr("ST_DWithin(a, p, 4.0)")).collect()} and near > inner
    for bad in ({"pred": "ST_Disjoint"}, {"pred": "ST_DWithin"}):
        with pytest.raises(ValueError):
            O.spatial_join(a, p, bad["pred"], "a", "p")
    assert O.spatial_join(a.limit(0), p, "ST_Intersects", "a", "p").count() == 0


def test_every_query_has_its_oracle(spark):
    assert set(Q.QUERIES) == set(Q.ORACLES)
    covered = {n.lower() for n in register_all(spark)} - {n.split("_pattern")[0] for n in Q.QUERIES}
    assert covered == set()


@pytest.mark.parametrize("name", ["st_relate", "st_union", "st_buffer", "st_dump", "st_extent", "st_memunion", "st_clusterkmeans", "st_clusterdbscan", "spatial_join_intersects", "spatial_join_covers", "spatial_join_left", "st_distancesphere"])
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("part", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(Q.ORACLES[name])
    found = Q.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want.fetchall()))
