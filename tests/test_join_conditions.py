"""Compound conditions, ST_Disjoint and clashing column names in the spatial join, against nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from terrafold import operators as O
from terrafold.functions import native, register_all

HOW = ["inner", "left", "right", "full", "left_semi", "left_anti"]


@pytest.fixture(scope="module")
def sides(spark):
    register_all(spark)
    rng = random.Random(11)
    rows = []
    for i in range(50):
        x, y, s = rng.uniform(0, 40), rng.uniform(0, 40), rng.choice([2, 5, 30])
        rows.append((i, rng.choice(["u", "v", None]), rng.randint(0, 9), f"POLYGON(({x} {y},{x + s} {y},{x + s} {y + s},{x} {y + s},{x} {y}))"))
    rows += [(50, "u", 1, None), (51, "u", 2, "POLYGON EMPTY"), rows[3], rows[3]]
    dots = [(i, rng.choice(["u", "v", None]), rng.randint(0, 9), float(rng.randint(0, 60)), float(rng.randint(0, 60))) for i in range(70)]
    dots += [(70, "u", 1, None, None), dots[5]]
    a = spark.createDataFrame(rows, "a int, ka string, va int, shape string")
    b = spark.createDataFrame(dots, "b int, kb string, vb int, x double, y double").select("b", "kb", "vb", native.st_point(F.col("x"), F.col("y")).alias("pt"))
    pairs = {}
    met = a.crossJoin(b).filter("ST_Intersects(shape, pt)").select("a", "ka", "va", "b", "kb", "vb").collect()
    return a, b, a.collect(), b.collect(), met


def nested(a_rows, b_rows, hold, how):
    """(a, b) rows of a join of any kind from the pairs that hold."""
    a, b = [r.a for r in a_rows], [r.b for r in b_rows]
    met_a, met_b = {x for x, _ in hold}, {y for _, y in hold}
    if how == "left_semi":
        return sorted(x for x in a if x in met_a)
    if how == "left_anti":
        return sorted(x for x in a if x not in met_a)
    out = list(hold)
    if how in ("left", "full"):
        out += [(x, None) for x in a if x not in met_a]
    if how in ("right", "full"):
        out += [(None, y) for y in b if y not in met_b]
    return sorted(out, key=repr)


def rows(df, how):
    return sorted(r.a for r in df.collect()) if "_" in how else sorted(((r.a, r.b) for r in df.select("a", "b").collect()), key=repr)


@pytest.mark.parametrize("how", HOW)
def test_equal_and_residual(sides, how):
    a, b, a_rows, b_rows, met = sides
    hold = [(r.a, r.b) for r in met if r.ka is not None and r.ka == r.kb and r.va != r.vb]
    found = O.spatial_join(a, b, "ST_Intersects", "shape", "pt", how=how, equal=[("ka", "kb")], residual="va <> vb")
    assert rows(found, how) == nested(a_rows, b_rows, hold, how)
    if how == "full":
        plain = [(r.a, r.b) for r in met if r.va > r.vb]
        assert rows(O.spatial_join(a, b, "ST_Intersects", "shape", "pt", how=how, residual=F.col("va") > F.col("vb")), how) == nested(a_rows, b_rows, plain, how)


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_disjoint(sides, how):
    a, b, a_rows, b_rows, met = sides
    apart = a.crossJoin(b).filter("ST_Disjoint(shape, pt)").select("a", "ka", "b", "kb").collect()
    assert rows(O.spatial_join(a, b, "ST_Disjoint", "shape", "pt", how=how), how) == nested(a_rows, b_rows, [(r.a, r.b) for r in apart], how)
    same = [(r.a, r.b) for r in apart if r.ka is not None and r.ka == r.kb]
    assert rows(O.spatial_join(a, b, "ST_Disjoint", "shape", "pt", how=how, equal=[("ka", "kb")]), how) == nested(a_rows, b_rows, same, how)
    near = b.filter("b = 9")  # all rows but those that it meets
    alone = a.crossJoin(near).filter("ST_Disjoint(shape, pt)").select("a", "b").collect()
    assert rows(O.spatial_join(a, near, "ST_Disjoint", "shape", "pt", how=how), how) == nested(a_rows, near.collect(), [(r.a, r.b) for r in alone], how)
    assert O.spatial_join(a, b.limit(0), "ST_Disjoint", "shape", "pt", how=how).count() == (0 if how == "left_semi" else len(a_rows))


def test_disjoint_by_equal_columns(sides):
    a, b, a_rows, b_rows, _ = sides
    apart = a.crossJoin(b).filter("ST_Disjoint(shape, pt) AND ka = kb").select("a", "b").collect()
    assert rows(O.spatial_join(a, b, "ST_Disjoint", "shape", "pt", equal=[("ka", "kb")]), "inner") == sorted(((r.a, r.b) for r in apart), key=repr)
    for how in ("inner", "left"):
        with pytest.raises(ValueError, match="ST_Disjoint"):
            O.spatial_join(a, b, "ST_Disjoint", "shape", "pt", how=how)


@pytest.mark.parametrize("how", ["inner", "full", "left_semi"])
def test_names_that_the_join_uses_itself(sides, how):
    a, b, a_rows, b_rows, met = sides
    a = a.withColumnsRenamed({"ka": "box", "va": "Level"}).withColumn("own_level", F.lit("mine"))
    b = b.withColumnsRenamed({"kb": "cx", "vb": "k0"}).withColumn("cy", F.lit("yours")).withColumn("_box", F.lit(7))
    found = O.spatial_join(a, b, "ST_Intersects", "shape", "pt", how=how)
    assert rows(found, how) == nested(a_rows, b_rows, [(r.a, r.b) for r in met], how)
    assert found.columns == a.columns + ([] if "_" in how else b.columns)
    for r in found.collect():
        assert r.a is None or (r.own_level == "mine" and r.box in ("u", "v", None))
        assert "_" in how or r.b is None or (r.cy == "yours" and r._box == 7)


def test_odd_column_names_and_shared_ones(sides):
    a, b, a_rows, b_rows, met = sides
    odd = a.withColumnsRenamed({"shape": "my.shape", "ka": "a`b"})
    found = O.spatial_join(odd, b, "ST_Intersects", "my.shape", "pt", how="left", equal=[("a`b", "kb")])
    assert rows(found, "left") == nested(a_rows, b_rows, [(r.a, r.b) for r in met if r.ka is not None and r.ka == r.kb], "left")
    with pytest.raises(ValueError, match="columns on both sides"):
        O.spatial_join(a, b.withColumnRenamed("b", "A"), "ST_Intersects", "shape", "pt")
    same = b.withColumnRenamed("b", "a")
    assert rows(O.spatial_join(a, same, "ST_Intersects", "shape", "pt", how="left_semi"), "left_semi") == nested(a_rows, b_rows, [(r.a, r.b) for r in met], "left_semi")


def test_boxes_in_any_order(spark):
    a = spark.createDataFrame([(1, 5.0, 5.0, 0.0, 0.0)], "a int, x1 double, y1 double, x2 double, y2 double")
    a = a.select("a", native.st_make_envelope(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("box"))
    b = spark.range(8).select(F.col("id").alias("b"), native.st_point(F.col("id"), F.col("id")).alias("pt"))
    assert {r.b for r in O.spatial_join(a, b, "ST_Intersects", "box", "pt").collect()} == set(range(6))
