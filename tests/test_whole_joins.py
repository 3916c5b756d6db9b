"""The registered joins take whole tables: against brute force and their SQL where ids go past 1000."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from terrafold.plans import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def pairs():
    """k, and per kind of join the pairs that hold (parts by orders, for boxes parts by parts)."""
    part, orders = pq.read_table(f"{SF}/part.parquet", columns=["p_partkey", "p_size"]), pq.read_table(f"{SF}/orders.parquet", columns=["o_orderkey"])
    k, w, o = part["p_partkey"].to_numpy(), part["p_size"].to_numpy().astype(np.int64), orders["o_orderkey"].to_numpy()
    x, y, ox, oy = k * 53 % 1000, k * 97 % 1000, o * 37 % 1000, o * 91 % 1000
    dx, dy = ox[None] - x[:, None], oy[None] - y[:, None]
    inside = (dx >= 0) & (dx <= w[:, None]) & (dy >= 0) & (dy <= w[:, None])
    meet = lambda a: (a[:, None] <= (a + w)[None]) & (a[None] <= (a + w)[:, None])
    return k, {"dwithin": dx * dx + dy * dy <= 25, "left": inside, "covers": inside & (dy <= dx), "bboxintersects": meet(x) & meet(y) & (k[:, None] < k[None])}


def test_joins_take_whole_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("part", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    k, holds = pairs()
    assert k.max() > 1000
    for name, found in holds.items():
        full = f"spatial_join_{name}"
        got = sorted(map(tuple, queries.QUERIES[full](spark, SF).collect()))
        if name == "bboxintersects":
            want = [(int(k[a]), int(k[b])) for a, b in np.argwhere(found)]
        else:
            want = [(int(i), int(n)) for i, n in zip(k, found.sum(axis=1), strict=True) if n or name == "left"]
        assert got == sorted(want), name
        assert got == sorted(c.sql(queries.ORACLES[full]).fetchall()), name


def _sides(spark):
    """Many rows to a place, nulls, and columns to compare."""
    left = spark.range(400).selectExpr("id AS k", "id % 7 AS eq", "CASE WHEN id % 31 = 0 THEN NULL ELSE named_struct('xmin', CAST(id % 9 AS DOUBLE), 'ymin', CAST(id % 4 AS DOUBLE), 'xmax', CAST(id % 9 + id % 3 + 1 AS DOUBLE), 'ymax', CAST(id % 4 + 2 AS DOUBLE), 'srid', 0) END AS box")
    right = spark.range(600).selectExpr("CASE WHEN id % 50 = 3 THEN NULL ELSE id END AS o", "id % 7 AS eq2", "named_struct('x', CAST(id % 11 AS DOUBLE), 'y', CAST(id % 6 AS DOUBLE), 'z', CAST(NULL AS DOUBLE), 'm', CAST(NULL AS DOUBLE), 'srid', 0) AS pt")
    return left, right


def test_rows_that_share_geometries_are_joined_once(spark, monkeypatch):
    from terrafold.operators import join

    left, right = _sides(spark)
    args = dict(pred="ST_Intersects", left_geom="box", right_geom="pt", equal=[("eq", "eq2")], residual="k < o")
    plain = sorted(map(tuple, join.spatial_join(left, right, **args, _shared=False).select("k", "o").collect()))
    called, own = [], join._by_geometry
    monkeypatch.setattr(join, "SAMPLE", 100)
    monkeypatch.setattr(join, "_by_geometry", lambda *a: called.append(1) or own(*a))
    for how in ("inner", "left_semi"):
        found = join.spatial_join(left, right, **args, how=how)
        want = plain if how == "inner" else sorted({(k,) for k, _ in plain})
        assert sorted(tuple(r)[: 1 if how != "inner" else 2] for r in found.select(*(["k", "o"] if how == "inner" else ["k"])).collect()) == want
    assert called and found.columns == left.columns


def test_aggregates_over_partners(spark):
    """Without forming pairs: with equal columns, a rest, and a comparison of both sides, each way."""
    from pyspark.sql import functions as F

    from terrafold import operators as O

    left, right = _sides(spark)
    aggregates = {"n": ("count", None), "some": ("count", "o"), "total": ("sum", "o"), "low": ("min", "o"), "high": ("max", "o")}
    pairs = O.spatial_join(left, right, "ST_Intersects", "box", "pt")
    cases = [(None, None, "true"), ("(k + eq2) % 3 <> 0", None, "(k + eq2) % 3 <> 0")] + [(None, ("k", sign, "o"), f"o {sign} k") for sign in (">", ">=", "<", "<=")] + [("eq2 > 1", ("k", ">", "o"), "eq2 > 1 AND o > k")]
    for residual, compare, condition in cases:
        want = pairs.filter(condition).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("o").alias("some"), F.sum("o").alias("total"), F.min("o").alias("low"), F.max("o").alias("high"))
        want = {r.k: tuple(r)[1:] for r in want.collect()}
        got = O.spatial_aggregate(left, right, "ST_Intersects", "box", "pt", aggregates, residual=residual, compare=compare)
        assert got.columns == [*left.columns, *aggregates]
        rows = got.collect()
        assert sorted(r.k for r in rows) == list(range(400))
        assert {r.k: tuple(r)[3:] for r in rows} == {k: want.get(k, (0, 0, None, None, None)) for k in range(400)}, condition
    got = O.spatial_aggregate(left, right, "ST_Intersects", "box", "pt", {"n": ("count", None)}, equal=[("eq", "eq2")])
    want = {r.k: r["count"] for r in pairs.filter("eq = eq2").groupBy("k").count().collect()}
    assert {r.k: r.n for r in got.collect() if r.n} == want
