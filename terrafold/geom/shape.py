"""Measures, linear referencing, simplification, hulls, validity and tessellation of single geometries."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from .model import COLLECTION, LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geometry, gather
from .plane import Edges, areal, combine, dimension, intersects, locate, orient, segments_of, signed_area, turn


def closed(r: np.ndarray) -> np.ndarray:
    return r if len(r) and (r[0, :2] == r[-1, :2]).all() else np.vstack([r, r[:1]])


def ring_area(r: np.ndarray) -> float:
    return abs(signed_area(closed(r))) if len(r) > 2 else 0.0


def area(g: Geometry) -> float:
    return sum(ring_area(s.data[0]) - sum(map(ring_area, s.data[1:])) for s in g.singles() if s.kind == POLYGON and s.data)


def run_length(r: np.ndarray) -> float:
    d = np.diff(r[:, :2], axis=0)
    return float(np.hypot(d[:, 0], d[:, 1]).sum())


def length(g: Geometry) -> float:
    return sum(run_length(s.data) for s in g.singles() if s.kind == LINE)


def perimeter(g: Geometry) -> float:
    return sum(run_length(r) for s in g.singles() if s.kind == POLYGON for r in s.data)


# ---- distances

def _linework(g: Geometry) -> np.ndarray:
    """All segments; points are segments of no length."""
    runs = []
    for s in g.singles():
        if s.kind == POINT:
            if s.data is not None:
                runs.append(np.hstack([s.data[:2], s.data[:2]]).reshape(1, 4))
        else:
            for r in [s.data] if s.kind == LINE else s.data:
                r = r[:, :2]
                runs.append(np.hstack([r[:-1], r[1:]]) if len(r) > 1 else np.hstack([r, r]))
    return np.concatenate(runs) if runs else np.empty((0, 4))


def _to_segments(p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point the nearest place on any segment: distance, x and y."""
    best, where = np.full(len(p), np.inf), np.zeros((len(p), 2))
    step = max(1, 2_000_000 // max(1, len(s)))
    a, d = s[:, :2], s[:, 2:] - s[:, :2]
    n = (d * d).sum(1)
    for at in range(0, len(p), step):
        q = p[at : at + step]
        t = ((q[:, None] - a[None]) * d[None]).sum(2) / np.where(n > 0, n, 1)[None]
        foot = a[None] + np.clip(t, 0, 1)[:, :, None] * d[None]
        gap = np.hypot(*(q[:, None] - foot).transpose(2, 0, 1))
        k = gap.argmin(1)
        rows = np.arange(len(q))
        best[at : at + step], where[at : at + step] = gap[rows, k], foot[rows, k]
    return best, where[:, 0], where[:, 1]


def nearest(a: Geometry, b: Geometry) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Distance and a nearest pair of places, the first on a."""
    sa, sb = _linework(a), _linework(b)
    if not len(sa) or not len(sb):
        return None
    if a.kind == b.kind == POINT:
        return float(np.hypot(*(a.data[:2] - b.data[:2]))), a.data[:2], b.data[:2]
    # A place of one inside the other's area is common to both.
    for x, y in ((b, a), (a, b)):
        if dimension(y) == 2:
            c = x.coords()
            inside = np.flatnonzero(locate(y, c) >= 0)
            if len(inside):
                return 0.0, c[inside[0]], c[inside[0]]
    pa, pb = np.unique(np.vstack([sa[:, :2], sa[:, 2:]]), axis=0), np.unique(np.vstack([sb[:, :2], sb[:, 2:]]), axis=0)
    d1, x1, y1 = _to_segments(pa, sb)
    d2, x2, y2 = _to_segments(pb, sa)
    if dimension(a) and dimension(b) and min(d1.min(), d2.min()) > 0 and (meet := _crossing(sa, sb)) is not None:
        return 0.0, meet, meet
    i, j = int(d1.argmin()), int(d2.argmin())
    if d1[i] <= d2[j]:
        return float(d1[i]), pa[i], np.array([x1[i], y1[i]])
    return float(d2[j]), np.array([x2[j], y2[j]]), pb[j]


def _crossing(s: np.ndarray, t: np.ndarray) -> np.ndarray | None:
    """A place where a segment of one properly crosses one of the other."""
    for k in range(len(s)):
        a, b = s[k, :2], s[k, 2:]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        near = t[(np.minimum(t[:, :2], t[:, 2:]) <= hi).all(1) & (np.maximum(t[:, :2], t[:, 2:]) >= lo).all(1)]
        if not len(near):
            continue
        c, d = near[:, :2], near[:, 2:]
        hit = (orient(a[0], a[1], b[0], b[1], c[:, 0], c[:, 1]) * orient(a[0], a[1], b[0], b[1], d[:, 0], d[:, 1]) <= 0) & (
            orient(c[:, 0], c[:, 1], d[:, 0], d[:, 1], a[0], a[1]) * orient(c[:, 0], c[:, 1], d[:, 0], d[:, 1], b[0], b[1]) <= 0)
        if hit.any():
            i = int(hit.argmax())
            r, q = b - a, d[i] - c[i]
            den = r[0] * q[1] - r[1] * q[0]
            if den:
                return a + r * (((c[i, 0] - a[0]) * q[1] - (c[i, 1] - a[1]) * q[0]) / den)
    return None


def distance(a: Geometry, b: Geometry) -> float | None:
    found = nearest(a, b)
    return None if found is None else found[0]


def _vertex_gaps(a: Geometry, b: Geometry):
    pa, pb = a.coords(), b.coords()
    for at in range(0, len(pa), step := max(1, 2_000_000 // max(1, len(pb)))):
        yield np.hypot(*(pa[at : at + step, None] - pb[None]).transpose(2, 0, 1))


def max_distance(a: Geometry, b: Geometry) -> float:
    if a.empty() or b.empty():
        return math.nan
    return max(float(d.max()) for d in _vertex_gaps(a, b))


def hausdorff(a: Geometry, b: Geometry) -> float | None:
    if a.empty() or b.empty():
        return None
    return max(max(float(d.min(1).max()) for d in _vertex_gaps(x, y)) for x, y in ((a, b), (b, a)))


def frechet(a: Geometry, b: Geometry) -> float | None:
    """Discrete Frechet distance of two lines."""
    if a.kind != LINE or b.kind != LINE or a.empty() or b.empty():
        return None
    p, q = a.data[:, :2], b.data[:, :2]
    row = None
    for x in p:
        d = np.hypot(*(q - x).T)
        new = np.empty(len(q))
        for j in range(len(q)):
            best = -np.inf if row is None and j == 0 else min(([row[j]] if row is not None else []) + ([new[j - 1]] if j else []) + ([row[j - 1]] if row is not None and j else []))
            new[j] = max(best, d[j])
        row = new
    return float(row[-1])


# ---- linear referencing

def locate_along(g: Geometry, p: np.ndarray) -> float | None:
    if g.kind != LINE or g.empty():
        return None
    c = g.data[:, :2]
    s, size = np.hstack([c[:-1], c[1:]]), np.hypot(*np.diff(c, axis=0).T)
    total = size.sum()
    if not total:
        return 0.0
    d = s[:, 2:] - s[:, :2]
    n = (d * d).sum(1)
    t = np.clip(((p - s[:, :2]) * d).sum(1) / np.where(n > 0, n, 1), 0, 1)
    gap = np.hypot(*(p - (s[:, :2] + t[:, None] * d)).T)
    k = int(gap.argmin())
    return float(min(1.0, (size[:k].sum() + t[k] * size[k]) / total))


def interpolate(g: Geometry, f: float) -> Geometry | None:
    if g.kind != LINE or g.empty() or not 0 <= f <= 1:
        return None
    c = g.data[:, :2]
    size = np.hypot(*np.diff(c, axis=0).T)
    want = f * size.sum()
    at = np.concatenate([[0], np.cumsum(size)])
    k = min(int(np.searchsorted(at, want, side="right")) - 1, len(size) - 1)
    t = (want - at[k]) / size[k] if size[k] else 0.0
    return g.flat(POINT, c[-1].copy() if f == 1 else c[k] + t * (c[k + 1] - c[k]))


# ---- changes of shape

def by_run(g: Geometry, f) -> Geometry:
    """f(run, ring?) over lineal and areal runs; points stay."""
    def walk(kind, d):
        if kind in (POINT, MULTIPOINT):
            return d
        if kind == LINE:
            return f(d, False)
        if kind == POLYGON:
            return [f(r, True) for r in d]
        return [walk(kind - 3, x) for x in d]

    if g.kind == COLLECTION:
        return g.flat(COLLECTION, [by_run(x, f) for x in g.data])
    return g.flat(g.kind, walk(g.kind, g.data))


def simplify(g: Geometry, tol: float) -> Geometry:
    """Ramer-Douglas-Peucker."""
    def run(r, ring):
        if len(r) < 3:
            return r
        keep = np.zeros(len(r), bool)
        keep[[0, -1]] = True
        stack = [(0, len(r) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            d, _, _ = _to_segments(r[a + 1 : b], np.hstack([r[a], r[b]]).reshape(1, 4))
            k = int(d.argmax())
            if d[k] > tol:
                keep[a + 1 + k] = True
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return r if ring and keep.sum() < 4 else r[keep]

    return by_run(g, run) if g.kind in (LINE, POLYGON, MULTILINE, MULTIPOLYGON) and tol >= 0 else g


def simplify_vw(g: Geometry, tol: float) -> Geometry:
    """Visvalingam-Whyatt: vertices whose triangle with their neighbours has an area of at most ``tol`` go, smallest first."""
    import heapq

    def run(r, ring):
        n = len(r)
        if n < 3:
            return r
        before, after, alive = np.arange(-1, n - 1), np.arange(1, n + 1), np.ones(n, bool)

        def size(i):
            a, b, c = r[before[i]], r[i], r[after[i]]
            return abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2

        now = {i: size(i) for i in range(1, n - 1)}
        heap = [(v, i) for i, v in now.items()]
        heapq.heapify(heap)
        left = n
        while heap:
            v, i = heapq.heappop(heap)
            if not alive[i] or now[i] != v:
                continue
            if v > tol or left <= (4 if ring else 2):
                break
            alive[i] = False
            left -= 1
            a, c = before[i], after[i]
            after[a], before[c] = c, a
            for j in (a, c):
                if 0 < j < n - 1:
                    now[j] = max(size(j), v)
                    heapq.heappush(heap, (now[j], j))
        return r[alive]

    return by_run(g, run) if g.kind in (LINE, POLYGON, MULTILINE, MULTIPOLYGON) and tol > 0 else g


def segmentize(g: Geometry, most: float) -> Geometry | None:
    if not most > 0:
        return None

    def run(r, ring):
        if len(r) < 2:
            return r
        n = np.maximum(1, np.ceil(np.hypot(*np.diff(r, axis=0).T) / most)).astype(int)
        out = [r[k] + (r[k + 1] - r[k]) * (np.arange(m)[:, None] / m) for k, m in enumerate(n)]
        return np.vstack([*out, r[-1:]])

    return by_run(g, run)


def chaikin(g: Geometry, n: float) -> Geometry | None:
    k = math.floor(n + 0.5) if math.isfinite(n) else -1
    if not 0 <= k <= 8:
        return None

    def run(r, ring):
        for _ in range(k):
            if len(r) < 3:
                return r
            a, b = r[:-1], r[1:]
            cut = np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], 1).reshape(-1, 2)
            r = np.vstack([cut, cut[:1]]) if ring else np.vstack([r[:1], cut[1:-1], r[-1:]])
        return r

    return by_run(g, run)


def drop_repeats(g: Geometry) -> Geometry:
    def run(r, ring):
        return r[np.concatenate([[True], (np.diff(r, axis=0) != 0).any(1)])] if len(r) else r

    out = by_run(g.plane(), run)
    if out.kind == MULTIPOINT:
        seen, kept = set(), []
        for d in out.data:
            key = None if d is None else tuple(d)
            if key not in seen:
                seen.add(key)
                kept.append(d)
        out = g.flat(MULTIPOINT, kept)
    return out


def wound(g: Geometry, ccw: bool) -> Geometry:
    def polygon(d):
        return [r if len(r) < 3 or (signed_area(closed(r)) > 0) == ((k == 0) == ccw) else r[::-1] for k, r in enumerate(d)]

    if g.kind == POLYGON:
        return g.flat(POLYGON, polygon(g.data))
    if g.kind == MULTIPOLYGON:
        return g.flat(MULTIPOLYGON, [polygon(d) for d in g.data])
    return g


def boundary(g: Geometry) -> Geometry:
    if areal(g):
        return g.flat(MULTILINE, [r for s in g.singles() for r in s.data])
    if g.kind in (LINE, MULTILINE):
        odd: dict[tuple, int] = {}
        for s in g.singles():
            if len(s.data) and (s.data[0] != s.data[-1]).any():
                for e in (s.data[0], s.data[-1]):
                    odd[tuple(e)] = odd.get(tuple(e), 0) + 1
        return g.flat(MULTIPOINT, [np.array(e) for e, n in odd.items() if n % 2])
    return g.flat(MULTIPOINT, [])


def hull_of(p: np.ndarray) -> np.ndarray:
    """Counter-clockwise convex hull, closed (of one or two places: those)."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return np.vstack([p, p[:1]]) if len(p) else p

    def half(q):
        out: list[np.ndarray] = []
        for c in q:
            while len(out) > 1 and turn(*out[-2], *out[-1], *c) <= 0:
                out.pop()
            out.append(c)
        return out

    lower, upper = half(p), half(p[::-1])
    return np.array([*lower[:-1], *upper[:-1], lower[0]])


def convex_hull(g: Geometry) -> Geometry:
    h = hull_of(g.coords())
    return g.flat(POLYGON, [h] if len(h) else [])


def oriented_box(g: Geometry) -> Geometry | None:
    h = hull_of(g.coords())
    if not len(h):
        return None
    if len(h) < 4:
        return g.flat(POLYGON, [np.vstack([h[:-1], h[:-1][::-1], h[:1]])])
    best = None
    for way in np.diff(h, axis=0):
        u = way / np.hypot(*way)
        v = np.array([-u[1], u[0]])
        a, b = h @ u, h @ v
        size = (a.max() - a.min()) * (b.max() - b.min())
        if best is None or size < best[0]:
            best = size, [x * u + y * v for x, y in ((a.min(), b.min()), (a.max(), b.min()), (a.max(), b.max()), (a.min(), b.max()), (a.min(), b.min()))]
    return g.flat(POLYGON, [np.array(best[1])])


def centroid(g: Geometry) -> np.ndarray | None:
    own = [s for s in g.singles() if not s.empty()]
    if not own:
        return None
    origin = own[0].coords()[0]
    if any(s.kind == POLYGON for s in own):
        total, at = 0.0, np.zeros(2)
        for s in own:
            if s.kind == POLYGON:
                for k, r in enumerate(s.data):
                    p = closed(r[:, :2]) - origin
                    c = p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]
                    sign = (1 if c.sum() >= 0 else -1) * (1 if k == 0 else -1)
                    total += sign * c.sum() / 2
                    at += sign * ((p[:-1] + p[1:]) * c[:, None]).sum(0) / 6
        if total:
            return origin + at / total
    runs = [s.data[:, :2] for s in own if s.kind == LINE] + [closed(r[:, :2]) for s in own if s.kind == POLYGON for r in s.data]
    total, at = 0.0, np.zeros(2)
    for r in runs:
        size = np.hypot(*np.diff(r, axis=0).T)
        total += size.sum()
        at += ((r[:-1] + r[1:]) / 2 * size[:, None]).sum(0)
    if total:
        return at / total
    return np.mean([c for s in own if dimension(s) == max(map(dimension, own)) for c in s.coords()], axis=0)


def inner_point(g: Geometry) -> np.ndarray | None:
    """A place in the interior: on a level through the middle of the widest polygon, a line's vertex nearest the centroid, or a point."""
    own = [s for s in g.singles() if not s.empty()]
    if not own:
        return None
    if polygons := [s for s in own if s.kind == POLYGON]:
        best = (-1.0, polygons[0].data[0][0, :2])
        for s in polygons:
            ys = np.unique(np.concatenate([r[:, 1] for r in s.data]))
            box = s.box()
            middle = (box[1] + box[3]) / 2
            above, below = ys[ys > middle], ys[ys <= middle]
            y = (above[0] + below[-1]) / 2 if len(above) and len(below) else middle
            seg = segments_of(s.data, close=True)
            cross = seg[(seg[:, 1] <= y) != (seg[:, 3] <= y)]
            xs = np.sort(cross[:, 0] + (y - cross[:, 1]) * (cross[:, 2] - cross[:, 0]) / (cross[:, 3] - cross[:, 1]))
            for a, b in zip(xs[::2], xs[1::2], strict=False):
                if b - a > best[0]:
                    best = b - a, np.array([(a + b) / 2, y])
        return best[1]
    middle = centroid(g)
    lines = [s.data[:, :2] for s in own if s.kind == LINE]
    if lines:
        c = np.concatenate([r[1:-1] for r in lines if len(r) > 2] or lines)
    else:
        c = np.concatenate([s.coords() for s in own])
    return c[int(np.hypot(*(c - middle).T).argmin())]


# ---- simplicity and validity

def simple_run(r: np.ndarray) -> bool:
    r = r[np.concatenate([[True], (np.diff(r, axis=0) != 0).any(1)])] if len(r) else r
    n = len(r) - 1
    if n < 1:
        return True
    round_ = (r[0] == r[-1]).all()
    s = np.hstack([r[:-1], r[1:]])
    for i in range(n):
        for j in range(i + 1, n):
            if (np.maximum(s[i, :2], s[i, 2:]) < np.minimum(s[j, :2], s[j, 2:])).any() or (np.maximum(s[j, :2], s[j, 2:]) < np.minimum(s[i, :2], s[i, 2:])).any():
                continue
            a, b, c, d = s[i, :2], s[i, 2:], s[j, :2], s[j, 2:]
            o = [turn(*x) for x in ((*a, *b, *c), (*a, *b, *d), (*c, *d, *a), (*c, *d, *b))]
            if o[0] * o[1] > 0 or o[2] * o[3] > 0:
                continue
            neighbours = j == i + 1 or (round_ and i == 0 and j == n - 1)
            if not neighbours:
                return False
            if o == [0, 0, 0, 0]:  # in line: neighbours may only share their common vertex
                shared, p, q = (b, a, d) if j == i + 1 else (a, b, c)
                if n == 2 and round_ or ((p - shared) * (q - shared)).sum() > 0:
                    return False
            elif n == 2 and round_:
                return False
    return True


def is_simple(g: Geometry) -> bool:
    if g.kind == COLLECTION:
        return all(map(is_simple, g.data))
    if g.kind == MULTIPOINT:
        own = [tuple(d[:2]) for d in g.data if d is not None]
        return len(set(own)) == len(own)
    if g.kind in (POINT, POLYGON, MULTIPOLYGON):
        return True
    runs = [s.data[:, :2] for s in g.singles()]
    if not all(map(simple_run, runs)):
        return False
    from .plane import relate

    for i, a in enumerate(runs):
        for b in runs[i + 1 :]:
            if len(a) > 1 and len(b) > 1:
                m = relate(g.flat(LINE, a), g.flat(LINE, b))
                if m[0] != "F" or m[1] != "F" or m[3] != "F":
                    return False
    return True


def invalid_reason(g: Geometry) -> str | None:
    """What makes a geometry invalid, or None."""
    from .plane import Nodes

    for s in g.singles():
        c = s.coords()
        if not np.isfinite(c).all():
            return "Invalid Coordinate"
        if s.kind == LINE and len(c) and len(np.unique(c, axis=0)) < 2:
            return "Too few points in geometry component"
        if s.kind != POLYGON:
            continue
        for r in s.data:
            if len(r) and len(np.unique(r[:, :2], axis=0)) < 3:
                return "Too few points in geometry component"
            if not simple_run(closed(r[:, :2])):
                return "Self-intersection"
        rings = [closed(r[:, :2]) for r in s.data if len(r)]
        for k, hole in enumerate(rings[1:], 1):
            if (Edges([rings[0]]).locate(np.vstack([hole[:-1], (hole[:-1] + hole[1:]) / 2])) < 0).any():
                return "Hole lies outside shell"
            for other in rings[1:k]:
                from .plane import matches, relate

                m = relate(g.flat(POLYGON, [hole]), g.flat(POLYGON, [other]))
                if matches(m, "T********") or m[4] == "1":
                    return "Holes are nested or overlap"
        for ring in rings[1:]:
            n = Nodes([segments_of([rings[0]]), segments_of([ring])])
            if ((n.count[0] > 0) & (n.count[1] > 0)).any() or ((n.count > 1).any()):
                return "Self-intersection"
        if len(rings) > 1 and len(combine([segments_of(rings)], "odd", lambda a: a)) > 1:
            return "Interior is disconnected"
    if g.kind == MULTIPOLYGON:
        from .plane import relate

        own = list(g.singles())
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                m = relate(a, b)
                if m[0] != "F" or m[4] == "1":
                    return "Nested or overlapping polygons"
    if g.kind == COLLECTION:
        return next((r for r in map(invalid_reason, g.data) if r), None)
    return None


# ---- tessellation

def _in_circle(a, b, c, d) -> bool:
    """Whether d is inside the circle of the counter-clockwise triangle a, b, c."""
    m = [(p[0] - d[0], p[1] - d[1]) for p in (a, b, c)]
    q = [x * x + y * y for x, y in m]
    t = [q[0] * (m[1][0] * m[2][1] - m[2][0] * m[1][1]), q[1] * (m[2][0] * m[0][1] - m[0][0] * m[2][1]), q[2] * (m[0][0] * m[1][1] - m[1][0] * m[0][1])]
    det = sum(t)
    if abs(det) > 1e-12 * sum(q[i] * (abs(m[(i + 1) % 3][0] * m[(i + 2) % 3][1]) + abs(m[(i + 2) % 3][0] * m[(i + 1) % 3][1])) for i in range(3)):
        return det > 0
    number = int if all(float(v).is_integer() for p in (a, b, c, d) for v in p) else Fraction
    m = [(number(p[0]) - number(d[0]), number(p[1]) - number(d[1])) for p in (a, b, c)]
    q = [x * x + y * y for x, y in m]
    return sum(q[i] * (m[(i + 1) % 3][0] * m[(i + 2) % 3][1] - m[(i + 2) % 3][0] * m[(i + 1) % 3][1]) for i in range(3)) > 0


def triangulate(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles (counter-clockwise, point numbers): points join in order of x, then edges flip until every circle is empty."""
    p = np.asarray(p, float)
    n = len(p)
    pts = [tuple(x) for x in p.tolist()]
    at = lambda i, j, k: turn(*pts[i], *pts[j], *pts[k])
    k = 2
    while k < n and at(0, 1, k) == 0:
        k += 1
    if n < 3 or k == n:
        return []
    across: dict[tuple[int, int], int] = {}  # directed edge -> third corner of the triangle to its left

    def add(a, b, c):
        across[a, b], across[b, c], across[c, a] = c, a, b

    rim: list[int]
    if at(0, 1, k) > 0:
        for i in range(k - 1):
            add(i, i + 1, k)
        rim = [*range(k), k]
    else:
        for i in range(k - 1):
            add(i + 1, i, k)
        rim = [k, *range(k - 1, -1, -1)]
    for v in range(k + 1, n):
        m = len(rim)
        seen = [at(rim[i], rim[(i + 1) % m], v) < 0 for i in range(m)]
        start = next(i for i in range(m) if seen[i] and not seen[i - 1])
        i, visible = start, []
        while seen[i % m] and len(visible) < m:
            visible.append((rim[i % m], rim[(i + 1) % m]))
            i += 1
        for a, b in visible:
            add(b, a, v)
        first = visible[0][0]
        gone = {b for _, b in visible[:-1]}
        rest = [x for x in rim if x not in gone]
        place = rest.index(first)
        rim = [*rest[: place + 1], v, *rest[place + 1 :]]
    stack = [e for e in across if e[0] < e[1] and (e[1], e[0]) in across]
    while stack:
        a, b = stack.pop()
        if (a, b) not in across or (b, a) not in across:
            continue
        c, d = across[a, b], across[b, a]
        if _in_circle(pts[a], pts[b], pts[c], pts[d]):
            for e in ((a, b), (b, a)):
                del across[e]
            add(c, d, b)
            add(d, c, a)
            stack += [tuple(sorted(e)) for e in ((a, c), (c, b), (b, d), (d, a))]
    return sorted({tuple(t[(j := t.index(min(t))) :] + t[:j]) for (a, b), c in across.items() for t in [[a, b, c]]})


def delaunay(g: Geometry) -> Geometry | None:
    p = np.unique(g.coords(), axis=0)
    if len(p) < 3:
        return None
    return gather([g.flat(POLYGON, [p[[*t, t[0]]]]) for t in triangulate(p)], g.srid)


def voronoi_cells(g: Geometry) -> list[np.ndarray]:
    """Closed rings of the cells, clipped to the extent grown by half its size each way."""
    p = np.unique(g.coords(), axis=0)
    if len(p) < 2:
        return []
    lo, hi = p.min(0), p.max(0)
    pad = np.where(hi > lo, hi - lo, (hi - lo).max()) / 2
    frame = np.array([lo - pad, [hi[0] + pad[0], lo[1] - pad[1]], hi + pad, [lo[0] - pad[0], hi[1] + pad[1]]])
    near: list[set[int]] = [set() for _ in p]
    triangles = triangulate(p)
    for t in triangles:
        for i in t:
            near[i] |= set(t) - {i}
    if not triangles:  # all in line
        for i in range(len(p) - 1):
            near[i].add(i + 1)
            near[i + 1].add(i)
    cells = []
    at = p.tolist()
    for i, own in enumerate(near):
        cell = [tuple(c) for c in frame.tolist()]
        (px, py) = at[i]
        for j in sorted(own):
            qx, qy = at[j]
            mx, my, wx, wy = (px + qx) / 2, (py + qy) / 2, qx - px, qy - py
            side = [(x - mx) * wx + (y - my) * wy for x, y in cell]
            out = []
            for k in range(len(cell)):
                a, sa = cell[k], side[k]
                b, sb = cell[(k + 1) % len(cell)], side[(k + 1) % len(cell)]
                if sa <= 0:
                    out.append(a)
                if (sa < 0 < sb) or (sb < 0 < sa):
                    t = sa / (sa - sb)
                    out.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
            cell = out
            if len(cell) < 3:
                break
        if len(cell) > 2:
            cells.append(np.array([*cell, cell[0]]))
    return cells


def voronoi_lines(g: Geometry) -> Geometry | None:
    cells = voronoi_cells(g)
    if not cells:
        return None
    seen: dict[tuple, np.ndarray] = {}
    size = max(float(np.abs(np.concatenate(cells)).max()), 1e-300)
    for c in cells:
        ends = [tuple(e) for e in (np.round(c / size, 10) + 0.0).tolist()]
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a != b:
                seen.setdefault((a, b) if a < b else (b, a), c[k : k + 2])
    return g.flat(MULTILINE, list(seen.values()))


def concave_hull(g: Geometry, share: float) -> Geometry | None:
    """The convex hull, dug in where its edges are long: an edge is replaced by two through a nearby inner point if it is longer
    than ``concavity`` times the new ones reach; share 1 digs hardest among 1 / share."""
    if g.kind in (POINT, COLLECTION):
        return None
    concavity = 1 / min(max(share, 1e-6), 1.0)
    p = np.unique(g.coords(), axis=0)
    ring = hull_of(p)
    if len(ring) < 4:
        return g.flat(POLYGON, [ring] if len(ring) else [])
    used = {tuple(x) for x in ring}
    inner = [x for x in p if tuple(x) not in used]
    edges = [(ring[k], ring[k + 1]) for k in range(len(ring) - 1)]
    k = 0
    while k < len(edges) and inner:
        a, b = edges[k]
        size = float(np.hypot(*(b - a)))
        q = np.array(inner)
        d, _, _ = _to_segments(q, np.hstack([a, b]).reshape(1, 4))
        for i in np.argsort(d, kind="stable")[:8]:
            c = q[i]
            reach = min(np.hypot(*(c - a)), np.hypot(*(c - b)))
            if reach <= 0 or size / reach <= concavity:
                continue
            rest = [e for j, e in enumerate(edges) if j != k]
            s = np.array([np.hstack(e) for e in rest])
            if all(not _meets(np.hstack([x, c]), s, x) for x in (a, b)) and not Edges([np.array([a, b, c, a])]).locate(np.delete(q, i, 0)).max(initial=-1) >= 0:
                edges[k : k + 1] = [(a, c), (c, b)]
                inner = [x for j, x in enumerate(inner) if j != i]
                break
        else:
            k += 1
    return g.flat(POLYGON, [np.array([e[0] for e in edges] + [edges[0][0]])])


def _meets(seg: np.ndarray, s: np.ndarray, common: np.ndarray) -> bool:
    """Whether a segment meets any of others that don't start or end at ``common``."""
    other = s[~((s[:, :2] == common).all(1) | (s[:, 2:] == common).all(1))]
    a, b, c, d = seg[:2], seg[2:], other[:, :2], other[:, 2:]
    return bool(((orient(a[0], a[1], b[0], b[1], c[:, 0], c[:, 1]) * orient(a[0], a[1], b[0], b[1], d[:, 0], d[:, 1]) <= 0) & (orient(c[:, 0], c[:, 1], d[:, 0], d[:, 1], a[0], a[1]) * orient(c[:, 0], c[:, 1], d[:, 0], d[:, 1], b[0], b[1]) <= 0)).any())


__all__ = ["intersects"]
