"""Kernels against JTS (which ships with Spark; a test oracle only) and against algebraic laws."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrafold.geom import cluster, geodesic, model, plane, shape
from terrafold.geom.model import read_wkb, read_wkt, write_wkb, write_wkt

GRID = 6


def star(rng: random.Random, n: int, scale: int = GRID) -> list[tuple[int, int]]:
    """A simple ring on grid points, by sorting corners around their middle."""
    while True:
        pts = list({(rng.randint(0, scale), rng.randint(0, scale)) for _ in range(n)})
        cx, cy = sum(p[0] for p in pts) / len(pts), sum(p[1] for p in pts) / len(pts)
        if len(pts) > 2 and (cx, cy) not in pts:
            pts.sort(key=lambda p: (np.arctan2(p[1] - cy, p[0] - cx), (p[0] - cx) ** 2 + (p[1] - cy) ** 2))
            ring = [*pts, pts[0]]
            g = model.Geometry(model.POLYGON, [np.array(ring, float)])
            if shape.invalid_reason(g) is None:
                return ring


def coords(ps) -> str:
    return ",".join(f"{x} {y}" for x, y in ps)


def sample(rng: random.Random) -> str:
    kind = rng.randrange(7)
    dot = lambda: (rng.randint(0, GRID), rng.randint(0, GRID))
    if kind == 0:
        return f"POINT({coords([dot()])})"
    if kind == 1:
        return "MULTIPOINT(" + ",".join(f"({x} {y})" for x, y in {dot() for _ in range(4)}) + ")"
    if kind == 2:
        while len(set(ps := [dot() for _ in range(rng.randint(2, 5))])) < 2:
            pass
        return f"LINESTRING({coords(ps)})"
    if kind == 3:
        return "MULTILINESTRING(" + ",".join(f"({coords(p)})" for p in [[(a, b), (a + 1, b + rng.randint(0, 2)), (rng.randint(0, GRID), b + 3)] for a, b in [dot(), dot()]]) + ")"
    if kind == 4:
        return f"POLYGON((0 0,{GRID} 0,{GRID} {GRID},0 {GRID},0 0),(1 1,{rng.randint(2, 5)} 1,2 {rng.randint(2, 5)},1 1))"
    if kind == 5:
        return f"MULTIPOLYGON((({coords(star(rng, 5))})),(({coords([(x + 10, y) for x, y in star(rng, 5)])})))"
    return f"POLYGON(({coords(star(rng, rng.randint(3, 7)))}))"


@pytest.fixture(scope="module")
def jts(spark):
    jvm = spark.sparkContext._jvm.org.locationtech.jts
    reader = jvm.io.WKTReader()
    return jvm, reader.read


def test_relate_equals_jts(jts):
    jvm, read = jts
    rng = random.Random(11)
    for _ in range(500):
        a, b = sample(rng), sample(rng)
        assert plane.relate(read_wkt(a), read_wkt(b)) == jvm.operation.relateng.RelateNG.relate(read(a), read(b)).toString(), (a, b)


def test_overlay_and_measures_equal_jts(jts):
    _, read = jts
    rng = random.Random(12)
    for _ in range(120):
        a, b = (f"POLYGON(({coords(star(rng, rng.randint(3, 8), 20))}))" for _ in range(2))
        g, h, x, y = read_wkt(a), read_wkt(b), read(a), read(b)
        for how, other in (("union", x.union(y)), ("intersection", x.intersection(y)), ("difference", x.difference(y)), ("symdifference", x.symDifference(y))):
            found = plane.overlay(g, h, how)
            assert shape.area(found) == pytest.approx(other.getArea(), abs=1e-9), (how, a, b)
            assert shape.invalid_reason(found) is None, (how, a, b)
        for d in (0.7, 3.0, -0.4):
            assert shape.area(plane.buffer(g, d)) == pytest.approx(x.buffer(d, 16).getArea(), rel=1e-2, abs=1e-2)
        assert shape.area(shape.convex_hull(g)) == pytest.approx(x.convexHull().getArea())
        c = x.getCentroid()
        assert shape.centroid(g) == pytest.approx([c.getX(), c.getY()])
        assert shape.distance(g, h) == pytest.approx(x.distance(y), abs=1e-12)
        assert plane.locate(g, shape.inner_point(g)[None])[0] == 1


def test_simple_and_valid_equal_jts(jts):
    _, read = jts
    rng = random.Random(13)
    for _ in range(150):
        n = rng.randint(3, 6)
        ps = [(rng.randint(0, 4), rng.randint(0, 4)) for _ in range(n)]
        if len(set(ps)) > 1 and all(p != q for p, q in zip(ps, ps[1:])):  # noqa: B905
            assert shape.is_simple(read_wkt(w := f"LINESTRING({coords(ps)})")) == read(w).isSimple(), w
        if len(set(ps)) > 2:
            w = f"POLYGON(({coords([*ps, ps[0]])}))"
            assert (shape.invalid_reason(read_wkt(w)) is None) == read(w).isValid(), w
            fixed = plane.make_valid(read_wkt(w))
            assert shape.invalid_reason(fixed) is None, w
        w = sample(rng)
        assert read(w).isSimple() == shape.is_simple(read_wkt(w)), w


def test_union_of_many(jts):
    _, read = jts
    rng = random.Random(14)
    texts = [f"POLYGON(({coords(star(rng, 5, 30))}))" for _ in range(60)]
    whole = read(texts[0])
    for t in texts[1:]:
        whole = whole.union(read(t))
    found = plane.union_all([read_wkt(t) for t in texts])
    assert shape.area(model.Geometry(model.MULTIPOLYGON, found)) == pytest.approx(whole.getArea())


def test_delaunay_and_voronoi():
    rng = np.random.default_rng(3)
    for pts in (rng.random((80, 2)), rng.integers(0, 6, (60, 2)).astype(float)):
        g = model.Geometry(model.MULTIPOINT, list(pts))
        p = np.unique(pts, axis=0)
        triangles = shape.triangulate(p)
        assert sum(shape.ring_area(p[list(t)]) for t in triangles) == pytest.approx(shape.area(shape.convex_hull(g)))
        assert all(not shape._in_circle(*p[list(t)], p[k]) for t in triangles for k in range(len(p)) if k not in t)
        cells = shape.voronoi_cells(g)
        lo, hi = p.min(0), p.max(0)
        assert len(cells) == len(p) and sum(map(shape.ring_area, cells)) == pytest.approx(float(np.prod(2 * (hi - lo))))
    assert shape.delaunay(read_wkt("MULTIPOINT(0 0,1 1)")) is None
    assert shape.triangulate(np.array([[0, 0], [1, 1], [2, 2]])) == []


def test_geodesics():
    assert geodesic.inverse(0, 0, 179.5, 0.5)[0] == pytest.approx(19936288.578965, abs=1e-3)
    assert geodesic.inverse(0, 0, 180, 0)[0] == pytest.approx(20003931.4586, abs=1e-3)
    rng = random.Random(1)
    for _ in range(200):
        lon, lat, az, s = rng.uniform(-180, 180), rng.uniform(-85, 85), rng.uniform(0, 6.28), rng.uniform(1, 1.5e7)
        x, y, _ = geodesic.direct(lon, lat, az, s)
        d, back = geodesic.inverse(lon, lat, x, y)
        assert d == pytest.approx(s, abs=1e-3) and back == pytest.approx(az, abs=1e-6)


def test_clusters():
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    assert [len(set(cluster.kmeans(p, 3)[k : k + 40])) for k in (0, 40, 80)] == [1, 1, 1]
    label = cluster.dbscan(np.vstack([p, [[100, 100]]]), 0.5, 3)
    assert label[-1] == -1 and len(set(label[:-1])) == 3
    q = rng.random((150, 2))
    near = np.hypot(*(q[:, None] - q[None]).transpose(2, 0, 1)) <= 0.06
    core = near.sum(1) >= 4
    found = cluster.dbscan(q, 0.06, 4)
    for i in np.flatnonzero(core):
        assert (found[np.flatnonzero(near[i] & core)] == found[i]).all()
    assert ((found >= 0) == (near & core[None]).any(1)).all()
    for k in (0, 121):
        with pytest.raises(ValueError):
            cluster.kmeans(p, k)


numbers = st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: x + 0.0)
runs = st.lists(st.tuples(numbers, numbers), min_size=2, max_size=6)


@settings(max_examples=60, deadline=None)
@given(runs, st.integers(0, 99999), st.booleans(), st.booleans())
def test_encodings_round_trip(ps, srid, z, m):
    a = np.hstack([np.array(ps, float), np.ones((len(ps), z + m))])
    for g in (model.Geometry(model.LINE, a, z, m, srid), model.Geometry(model.POINT, a[0], z, m, srid), model.Geometry(model.MULTIPOINT, list(a), z, m, srid), model.Geometry(model.COLLECTION, [model.Geometry(model.LINE, a, z, m, srid)] * 2, z, m, srid)):
        again = read_wkb(write_wkb(g))
        assert (again.kind, again.z, again.m, again.srid) == (g.kind, z, m, srid) and write_wkb(again) == write_wkb(g)
        assert write_wkt(read_wkt(write_wkt(g))) == write_wkt(g)
    flat = model.Geometry(model.LINE, a[:, :2])
    assert (model.read_geojson(model.write_geojson(flat)).data == flat.data).all()


def test_edge_index_equals_winding():
    t = np.linspace(0, 2 * np.pi, 400)
    comb = [(x, 0 if k % 2 else 10) for k, x in enumerate(range(60))]
    rings = [np.stack([np.cos(t), np.sin(t)], 1), np.array([*comb, (59, -5), (0, -5), comb[0]], float)]
    rng = np.random.default_rng(2)
    for r in rings:
        r[-1] = r[0]
        e = plane.Edges([r])
        p = np.vstack([rng.uniform(r.min(0) - 1, r.max(0) + 1, (500, 2)), r, (r[:-1] + r[1:]) / 2])
        found = e.locate(p)
        assert (found[500 : 500 + len(r)] == 0).all()
        for q, f in zip(p[:500], found, strict=False):
            if f:
                angle = np.diff(np.unwrap(np.arctan2(r[:, 1] - q[1], r[:, 0] - q[0]))).sum()
                assert (abs(angle) > np.pi) == (f == 1)
    assert e.locate(np.array([[np.nan, 0.0]]))[0] == -1
