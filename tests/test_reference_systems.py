"""Reprojection against published points, round trips, and whole columns against row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafold.functions import arrow, call, native, register_all, scalar
from terrafold.geom import crs, model


def dms(d: int, m: int, s: float) -> float:
    return d + m / 60 + s / 3600


@pytest.mark.parametrize(
    ("lon", "lat", "source", "target", "x", "y"),
    [
        (dms(1, 43, 4.5177), dms(52, 39, 27.2531), 4277, 27700, 651409.903, 313177.270),  # worked example of the national grid's guide
        (5, 50, 4258, 3035, 3962799.451, 2999718.853),  # worked example of the azimuthal equal-area method
        (2.3522, 48.8566, 4171, 2154, 652469.023, 6862035.259),
        (50, -75, 4326, 3031, 1255380.793, 1053389.561),  # worked example of polar stereographic, turned by its 70 degrees and moved to zero
        (10, 0, 4326, 6933, 964862.803, 0),
        (3, 46.5, 4171, 2154, 700000, 6600000),
        (-96, 23, 4269, 5070, 0, 0),
        (-0.1278, 51.5074, 4326, 3857, -14226.63, 6711542.48),
        (9, 0, 4326, 32632, 500000, 0),
    ],
)
def test_published_points(lon, lat, source, target, x, y):
    got = crs.transform(np.array([[lon, lat]], float), source, target)
    assert got[0] == pytest.approx((x, y), abs=0.01)
    assert crs.transform(got, target, source)[0] == pytest.approx((lon, lat), abs=1e-8)


PLACES = {27700: (-6, 50, 1, 58), 4277: (-6, 50, 1, 58), 4314: (6, 48, 13, 54), 31467: (7, 47, 11, 55), 2193: (167, -47, 178, -34), 3347: (-130, 45, -60, 75), 2263: (-75, 40, -72, 42), 5070: (-120, 25, -70, 49), 3577: (115, -40, 150, -12), 3031: (-180, -89, 180, -60), 3413: (-180, 60, 180, 89), 3995: (-180, 60, 180, 89), 6933: (-180, -80, 180, 80), 3395: (-179, -80, 179, 80), 26918: (-78, 20, -72, 50), 32733: (12, -60, 18, 0), 32660: (174, 0, 180, 60)}


@pytest.mark.parametrize("srid", sorted(set(crs.SYSTEMS) | set(PLACES)))
def test_round_trips(srid):
    x0, y0, x1, y1 = PLACES.get(srid, (2, 45, 20, 60))
    rng = np.random.default_rng(srid)
    there = np.column_stack([rng.uniform(x0, x1, 500), rng.uniform(y0, y1, 500), np.arange(500.0)])
    got = crs.transform(crs.transform(there, 4326, srid), srid, 4326)
    assert got == pytest.approx(there, abs=5e-8 if crs.system(srid).shift else 1e-9)


def test_equal_area_keeps_areas():
    """A cell of a tenth of a degree has the same area in all three projections, and its true one."""
    cell = np.array([[10, 50], [10.1, 50], [10.1, 50.1], [10, 50.1]], float)
    fine = np.concatenate([np.linspace(a, b, 200, endpoint=False) for a, b in zip(cell, np.roll(cell, -1, 0), strict=True)])
    sizes = []
    for srid in (3035, 5070, 6933):
        x, y = crs.transform(fine, 4258, srid).T
        sizes.append(abs(np.dot(x - x[0], np.roll(y - y[0], -1)) - np.dot(np.roll(x - x[0], -1), y - y[0])) / 2)
    assert sizes == pytest.approx([sizes[0]] * 3, rel=1e-6)


def test_unknown_systems():
    for s, t in ((4326, 2056), (999999, 4326)):
        with pytest.raises(ValueError, match="2056|999999"):
            crs.transform(np.zeros((1, 2)), s, t)


def test_whole_columns_equal_row_by_row():
    f = scalar.SCALARS["ST_Transform"]
    texts = {
        "POINT": [f"POINT({k / 10} {50 + k / 7})" for k in range(9)],
        "LINE": [f"LINESTRING({k} 50,{k + 1} 51,{k} {52 + k / 3})" for k in range(9)],
        "POLYGON": [f"POLYGON(({k} 50,{k + 1} 50,{k + 1} {51 + k / 9},{k} 50))" for k in range(9)],
        "mixed": ["POINT(1 50)", "LINESTRING(1 50,2 51)", "POINT EMPTY", "POINT Z(1 50 7)"],
        "holes": ["POLYGON((0 50,9 50,9 59,0 50),(3 51,4 51,4 52,3 51))"] * 3,
    }
    for rows in texts.values():
        own = [model.write_wkb(model.with_srid(model.read_wkt(x), 4326)) for x in rows]
        for values in (own, [None, *own, None], own[1:]):
            a = pa.array(values, pa.binary())
            for column in (a, pa.concat_arrays([pa.array([b"x"], pa.binary()), a]).slice(1)):
                got = arrow.run(f, (column, pa.array([27700] * len(a), pa.int32())))
                rowwise = [None if v is None else arrow.run(f, (pa.array([v], pa.binary()), pa.array([27700], pa.int32())))[0].as_py() for v in values]
                for x, y in zip(got.to_pylist(), rowwise, strict=True):
                    if x is None or y is None:
                        assert x is y
                        continue
                    g, h = model.read_wkb(x), model.read_wkb(y)
                    assert (g.kind, g.z, g.srid, len(x)) == (h.kind, h.z, 27700, len(y))
                    assert g.coords() == pytest.approx(h.coords(), abs=1e-7)
                    if g.kind == model.POLYGON:
                        assert all((r[0] == r[-1]).all() for r in g.data)


def test_mixed_systems_and_missing_ones():
    f = scalar.SCALARS["ST_Transform"]
    p = model.read_wkt("POINT(10 50)")
    utm = model.read_wkb(arrow.run(f, (pa.array([model.write_wkb(model.with_srid(p, 4326))]), pa.array([32632], pa.int32())))[0].as_py())
    both = pa.array([model.write_wkb(model.with_srid(p, 4326)), model.write_wkb(utm)])
    a, b = (model.read_wkb(x) for x in arrow.run(f, (both, pa.array([3035, 3035], pa.int32()))).to_pylist())
    assert a.srid == b.srid == 3035 and a.coords()[0] == pytest.approx(b.coords()[0], abs=1e-3)
    with pytest.raises(ValueError, match="known SRID"):
        arrow.run(f, (pa.array([model.write_wkb(p)] * 2), pa.array([3035, 3035], pa.int32())))


def test_structs_in_spark(spark):
    register_all(spark)
    points = spark.range(50).select(F.col("id"), native.st_point(F.col("id") / 10, F.lit(50.0)).alias("p")).selectExpr("id", "IF(id % 7 = 0, NULL, struct(p.x, p.y, p.z, p.m, 4326 AS srid)) AS p")
    rows = points.select("id", call("ST_AsText", call("ST_Transform", F.col("p"), 3035)).alias("t"), call("ST_SRID", call("ST_Transform", F.col("p"), 3035)).alias("s")).collect()
    for r in rows:
        if r.id % 7 == 0:
            assert r.t is None
            continue
        x, y = map(float, r.t[6:-1].split())
        assert r.s == 3035 and (x, y) == pytest.approx(tuple(crs.transform(np.array([[r.id / 10, 50.0]]), 4326, 3035)[0]), abs=1e-6)
