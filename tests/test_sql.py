"""Plans and rows of spatial SQL: joins, native forms, prefilters."""

import pytest
from pyspark.sql import functions as F

from terrafold.functions import native, register_all
from terrafold.sql import planned, spatial_sql


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    register_all(spark)
    d = str(tmp_path_factory.mktemp("points"))
    p = spark.range(400).select(F.col("id").alias("o"), native.st_point(F.when(F.col("id") % 97 > 0, (F.col("id") * 37) % 100), (F.col("id") * 91) % 100).alias("pt"), (F.col("id") % 5).alias("g"))
    p.write.parquet(d + "/dots")
    spark.read.parquet(d + "/dots").createOrReplaceTempView("dots")
    x, y, w = (F.col("id") * 53) % 100, (F.col("id") * 29) % 100, F.col("id") % 9
    s = spark.range(60).select(F.col("id").alias("k"), native.st_make_envelope(x, y, x + w, y + w).alias("box"), F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d))", x, y, x + w + 1, y, x + w + 1, y + w + 1, x, y).alias("shape"), (F.col("id") % 5).alias("g"), w.alias("w"))
    s.write.parquet(d + "/shapes")
    spark.read.parquet(d + "/shapes").createOrReplaceTempView("shapes")
    return spark


JOINS = [
    "SELECT s.k, d.o FROM shapes s JOIN dots d ON ST_Intersects(s.shape, d.pt)",
    "SELECT s.k, d.o, s.g FROM shapes s JOIN dots d ON ST_Intersects(d.pt, s.shape) AND s.g = d.g AND s.w > 2 AND d.o < 300 AND s.k <> d.o",
    "SELECT * FROM shapes s, dots d WHERE ST_Contains(ST_Buffer(s.shape, 12), d.pt) AND s.g + 1 = d.g",
    "SELECT s.k, d.o FROM shapes s JOIN dots d ON ST_ContainsProperly(ST_Buffer(d.pt, 4), ST_Envelope(s.shape))",
    "SELECT s.k, d.o FROM dots d JOIN shapes s ON ST_ContainsProperly(ST_Expand(s.box, 3), d.pt)",
    "SELECT s.k, d.o FROM shapes s JOIN dots d ON ST_DWithin(s.shape, d.pt, 2.5)",
    "SELECT s.k, d.o FROM shapes s JOIN dots d ON ST_Distance(d.pt, s.shape) < 3",
    "SELECT s.k, d.o FROM shapes s JOIN dots d ON ST_DFullyWithin(s.shape, d.pt, 9)",
    "SELECT a.k, b.k AS other, d.o FROM shapes a JOIN shapes b ON ST_Overlaps(a.shape, b.shape) AND a.k < b.k JOIN dots d ON ST_Within(d.pt, b.shape)",
    "WITH t AS (SELECT k, ST_Envelope(shape) AS e FROM shapes WHERE w > 1) SELECT g, count(*) AS n FROM t JOIN dots ON ST_Covers(e, pt) GROUP BY g HAVING count(*) > 1",
    "SELECT s.k, d.o FROM shapes s JOIN dots d ON ST_Disjoint(s.box, d.pt) AND s.k = d.o",
]


@pytest.mark.parametrize("text", JOINS)
def test_inner_joins(views, text):
    want = sorted(map(repr, views.sql(text).collect()))
    found = spatial_sql(views, text)
    assert found.columns == views.sql(text).columns
    got = plan(found)
    assert "NestedLoop" not in got and "Cartesian" not in got
    assert sorted(map(repr, found.collect())) == want and want


@pytest.mark.parametrize("kind", ["LEFT", "RIGHT", "FULL", "LEFT SEMI", "LEFT ANTI"])
def test_other_joins(views, kind):
    """Spark itself refuses these: rows come from the pairs that hold."""
    on = "ST_Intersects(s.shape, d.pt) AND s.w > 2 AND d.o % 3 = 0 AND s.g <> d.g"
    pairs = {(r.k, r.o) for r in views.sql(f"SELECT s.k, d.o FROM shapes s JOIN dots d ON {on}").collect()}
    columns = "s.k" if "LEFT " in kind else "s.k, d.o"
    found = spatial_sql(views, f"SELECT {columns} FROM shapes s {kind} JOIN dots d ON {on}")
    assert "NestedLoop" not in plan(found)
    met, hit = {k for k, _ in pairs}, {o for _, o in pairs}
    if "LEFT " in kind:
        assert sorted(r.k for r in found.collect()) == sorted(met if kind.endswith("SEMI") else set(range(60)) - met)
        return
    want = list(pairs)
    if kind in ("LEFT", "FULL"):
        want += [(k, None) for k in set(range(60)) - met]
    if kind in ("RIGHT", "FULL"):
        want += [(None, o) for o in set(range(400)) - hit]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


NATIVE = [
    "ST_X(pt)", "ST_Y(pt)", "ST_Z(pt)", "ST_SRID(pt)", "ST_XMin(pt)", "ST_YMax(ST_Expand(pt, 2))", "ST_Area(ST_Expand(pt, 2))", "ST_Area(pt)", "ST_Distance(pt, ST_Point(3, 4))",
    "ST_BBoxIntersects(pt, ST_MakeEnvelope(10, 10, 50, 60))", "ST_X(ST_Translate(pt, 1, -2))", "ST_Y(ST_Scale(ST_Translate(pt, 1, 2), 3, 4))", "ST_X(ST_FlipCoordinates(pt))", "ST_Y(ST_Affine(pt, 1, 2, 3, 4, 5, 6))",
    "ST_Envelope(pt)", "ST_Expand(pt, 1.5)", "ST_GeometryType(pt)", "ST_NPoints(pt)", "ST_IsEmpty(pt)", "ST_Dimension(pt)", "ST_Intersects(pt, ST_MakeEnvelope(10, 10, 50, 60))", "ST_Within(pt, ST_MakeEnvelope(60, 50, 10, 10))",
    "ST_Disjoint(ST_Expand(pt, 1), ST_MakeEnvelope(10, 10, 50, 60))", "ST_Touches(pt, ST_MakeEnvelope(0, 10, 37, 60))", "ST_DWithin(pt, ST_Point(50, 50), 20)", "ST_Perimeter(ST_Expand(pt, 2))", "ST_Equals(pt, ST_Point(37, 91))",
    "CASE WHEN ST_X(pt) > 40 THEN ST_Area(ST_Expand(pt, ST_Y(pt))) END",
]


def test_native_forms_equal_python(views):
    text = "SELECT o, " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(NATIVE)) + " FROM dots"
    found = spatial_sql(views, text)
    assert found.schema.simpleString() == views.sql(text).schema.simpleString()
    assert "Python" not in plan(found) and "Python" in plan(views.sql(text))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, views.sql(text).collect()))


def test_what_has_no_native_form_stays(views):
    text = "SELECT ST_AsText(ST_Translate(pt, 1, 2)) AS t, ST_Translate(pt, 1, 2) AS b, ST_X(ST_Centroid(ST_Buffer(pt, 1))) AS x, sum(ST_X(pt)) OVER (ORDER BY o) AS s FROM dots WHERE o < 20"
    found = spatial_sql(views, text)
    assert found.schema.simpleString() == views.sql(text).schema.simpleString() and sorted(map(repr, found.collect())) == sorted(map(repr, views.sql(text).collect()))


def test_mixed_srids_raise(views):
    for e in ("ST_Distance(pt, p2)", "ST_Intersects(pt, p2)"):
        df = views.table("dots").withColumn("p2", native.st_point(F.lit(1), F.lit(2), srid=4326)).selectExpr(f"{e} AS r")
        with pytest.raises(Exception, match="mix coordinate"):
            planned(df).collect()


TRIANGLE = "POLYGON((10 10,60 10,60 70,10 10))"


@pytest.mark.parametrize("term", [f"ST_Within(pt, '{TRIANGLE}')", f"ST_Intersects(ST_GeomFromText('{TRIANGLE}'), pt)", f"ST_DWithin(pt, ST_GeomFromText('{TRIANGLE}'), 3)", "ST_Covers(ST_MakeEnvelope(10, 10, 60, 70), pt)", f"ST_CoveredBy(pt, ST_AsText('{TRIANGLE}')) AND o % 2 = 0"])
def test_ranges_reach_the_scan(views, term):
    text = f"SELECT o FROM dots WHERE {term}"
    found = spatial_sql(views, text)
    pushed = plan(found).split("PushedFilters: [")[1]
    scanned = [p for p in ("GreaterThanOrEqual(pt.x", "LessThanOrEqual(pt.x", "GreaterThanOrEqual(pt.y", "LessThanOrEqual(pt.y") if p in str(found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metadata().apply("PushedFilters"))]
    assert len(scanned) == 4, pushed[:300]
    assert sorted(r.o for r in found.collect()) == sorted(r.o for r in views.sql(text).collect()) != []


def test_ranges_for_boxes(views):
    for term in (f"ST_Intersects(box, '{TRIANGLE}')", f"NOT ST_Intersects(box, '{TRIANGLE}')", f"ST_Disjoint(box, '{TRIANGLE}')", f"ST_Within(box, '{TRIANGLE}') OR k = 3"):
        text = f"SELECT k FROM shapes WHERE {term}"
        assert sorted(r.k for r in spatial_sql(views, text).collect()) == sorted(r.k for r in views.sql(text).collect())


def test_parameters_and_bad_constants(views):
    assert spatial_sql(views, "SELECT o FROM dots WHERE ST_X(pt) > :low", low=90).count() == views.sql("SELECT o FROM dots WHERE pt.x > 90 AND pt.y IS NOT NULL").count()
    with pytest.raises(Exception, match="POLYGON"):
        spatial_sql(views, "SELECT o FROM dots WHERE ST_Within(pt, 'POLYGON((')").collect()
