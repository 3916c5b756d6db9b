"""Predicates, overlay, validity, inner points and buffers of whole columns against the same row by row."""

import random

import numpy as np
import pyarrow as pa
import pytest

from terrafold.functions import arrow
from terrafold.functions import columns as C
from terrafold.functions import scalar as S
from terrafold.geom import many, model, plane, shape
from terrafold.geom.model import LINE, MULTIPOLYGON, POINT, POLYGON, Geometry


def shapes(rng, kind, n=40):
    def ring(k):
        p = [[float(rng.randint(0, 7)) if rng.random() < 0.6 else round(rng.uniform(0, 7), 3) for _ in range(2)] for _ in range(k)]
        return np.array([*p, p[0]])

    def box(m):
        x, y, w, h = (rng.randint(1, m) for _ in range(4))
        return np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]], float)

    def one(k):
        if k == "polygon":
            return Geometry(POLYGON, rng.choice([lambda: [box(6)], lambda: [box(6), box(4)], lambda: [ring(rng.randint(3, 6))]])())
        if k == "line":
            return Geometry(LINE, ring(rng.randint(2, 6))[: None if rng.random() < 0.3 else -1])
        if k == "point":
            return Geometry(POINT, ring(1)[0])
        return one(rng.choice(["polygon", "line", "point"])) if rng.random() < 0.8 else Geometry(MULTIPOLYGON, [one("polygon").data for _ in range(2)])

    return pa.array([None if rng.random() < 0.05 else model.write_wkt(one(kind)) for _ in range(n)], pa.string())


def by_row(f, *args):
    out = []
    for row in zip(*[a.to_pylist() for a in args], strict=True):
        v = None if None in row else f.call(*[model.read_wkt(x) if isinstance(x, str) else x for x in row])
        out.append(model.write_wkb(v) if isinstance(v, Geometry) else v)
    return out


@pytest.mark.parametrize("name", C.PAIRED)
def test_pairs(name):
    rng = random.Random(name)
    for a in ("polygon", "line", "point", "mixed"):
        for b in ("polygon", "line", "point", "mixed"):
            one, two = shapes(rng, a), shapes(rng, b)
            got = C.run(S.SCALARS[name], (one, two), arrow._one, arrow.geometries)
            assert got.to_pylist() == by_row(S.SCALARS[name], one, two), (a, b)


@pytest.mark.parametrize("name", C.ALONE)
def test_alone(name):
    rng = random.Random(name)
    for a in ("polygon", "line") if name == "ST_PointOnSurface" else ("polygon",):
        one = shapes(rng, a, 150)
        assert C.run(S.SCALARS[name], (one,), arrow._one, arrow.geometries).to_pylist() == by_row(S.SCALARS[name], one)


def test_patterns_and_srids():
    rng = random.Random(4)
    a, b = shapes(rng, "polygon"), shapes(rng, "polygon")
    f = S.SCALARS["ST_Relate"]
    for p in ("T********", "FF*FF****", "2*1***2*2"):
        want = [None if x is None or y is None else "true" if f.call(model.read_wkt(x), model.read_wkt(y), p) else "false" for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        assert arrow.run(f, (a, b, pa.array([p] * len(a)))).to_pylist() == want
    with pytest.raises(ValueError, match="nine characters"):
        arrow.run(f, (a, b, pa.array(["T"] * len(a))))
    wkb = lambda c, srid: pa.array([None if x is None else model.write_wkb(model.with_srid(model.read_wkt(x), srid)) for x in c.to_pylist()])
    assert arrow.run(S.SCALARS["ST_Overlaps"], (wkb(a, 5), wkb(b, 5))).to_pylist() == by_row(S.SCALARS["ST_Overlaps"], a, b)
    with pytest.raises(ValueError, match="cannot mix"):
        arrow.run(S.SCALARS["ST_Overlaps"], (wkb(a, 5), wkb(b, 6)))


def test_large_and_nearly_equal_rows_go_one_by_one():
    t = 2 * np.pi * np.arange(2 * many.MOST) / (2 * many.MOST)
    large = np.stack([np.cos(t), np.sin(t)], 1)
    near = np.array([[0, 0], [3, 0], [3, 3], [0, 3 + 1e-14], [0, 0]])
    a = pa.array([model.write_wkt(Geometry(POLYGON, [np.vstack([large, large[:1]])])), model.write_wkt(Geometry(POLYGON, [near]))])
    b = pa.array(["POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((0 3,1 3,1 5,0 5,0 3))"])
    for name in ("ST_Relate", "ST_Intersection", "ST_Touches"):
        assert arrow.run(S.SCALARS[name], (a, b)).to_pylist() == by_row(S.SCALARS[name], a, b)


def test_convex_buffers():
    rng = np.random.default_rng(3)
    rings = [shape.hull_of(rng.uniform(0, 10, (k % 7 + 3, 2)))[:: 1 if k % 2 else -1] for k in range(25)]
    rings += [np.array(r, float) for r in ([[1, 1], [4, 1], [4, 3], [1, 3], [1, 1]], [[0, 0], [4, 0], [1, 1], [0, 4], [0, 0]], [[0, 0], [2, 0], [4, 0], [4, 4], [0, 0]])]
    d = rng.uniform(0.1, 3, len(rings))
    found = many.convex_buffers(np.concatenate(rings), np.cumsum([0, *map(len, rings)]), np.arange(len(rings) + 1), d)
    assert sum(f is not None for f in found) > 20 and found[-1] is None and found[-2] is None
    for r, f, far in zip(rings, found, d.tolist(), strict=True):
        if f is not None:
            ((want,),) = plane.buffer(Geometry(POLYGON, [r]), far).data
            assert want.shape == f.shape and np.abs(want - f).max() < 1e-12
    a = pa.array([model.write_wkt(Geometry(POLYGON, [r])) for r in rings])
    got = arrow.run(S.SCALARS["ST_Buffer"], (a, pa.array(-d)))
    assert got.to_pylist() == [model.write_wkb(plane.buffer(Geometry(POLYGON, [r]), -far)) for r, far in zip(rings, d.tolist(), strict=True)]


def test_queries_use_all_cores(spark, tmp_path):
    """A small table is one file and was one task."""
    from terrafold.plans import queries as Q

    spark.range(200).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert Q.QUERIES["st_voronoilines"](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
