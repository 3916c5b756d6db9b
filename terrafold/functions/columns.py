"""Predicates, overlay, validity and inner points of whole columns, by the arrangements of ``geom.many``.

``run`` gives None for what has to go row by row (constants, mixed SRIDs, kinds that a function treats by themselves); rows that the
arrangements leave undecided go through the row-wise function in here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..geom import many, model
from ..geom.model import LINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geometry
from ..geom.plane import OVERLAY
from . import scalar as S
from . import vector

PREDICATES = S.PREDICATES
OVERLAYS = {"ST_Union": "union", "ST_Intersection": "intersection", "ST_Difference": "difference", "ST_SymDifference": "symdifference"}
PAIRED = (*PREDICATES, "ST_Relate", *OVERLAYS)
ALONE = ("ST_MakeValid", "ST_IsValid", "ST_IsValidReason", "ST_PointOnSurface")


@dataclass
class Given:
    """An argument: its shapes, nulls and SRID, which rows are areas, whether all are of one plain kind, and its geometries as far as they are read."""

    shapes: many.Shapes
    null: np.ndarray
    srid: int
    areal: np.ndarray
    plain: bool
    read: Callable[[int], Geometry]


def _srid(a: pa.Array) -> int | None:
    """The one SRID of a column of plain (E)WKB or WKT, or None."""
    if pa.types.is_string(a.type):
        return 0
    own = vector._layout(a)
    found = np.unique(own.word(own.starts + 5)) if own.srid else np.zeros(1)
    return int(found[0]) if len(found) == 1 else None


def _given(a: pa.Array, name: str, number: int, decode: Callable, all_of: Callable) -> Given | None:
    f = vector.flat(a)
    if f is not None and (srid := _srid(a)) is not None and (own := many.of_flat(f.kind, f.xy, f.runs, f.rows, vector._bounds(f))) is not None:
        kind = "wkt" if pa.types.is_string(a.type) else "wkb"
        return Given(own, f.null, srid, np.full(len(a), f.kind == POLYGON), True, lambda k: decode(a[k].as_py(), kind))
    gs = all_of(a, name, number)
    srids = {g.srid for g in gs if g is not None}
    if len(srids) > 1:
        return None
    nothing = Geometry(MULTIPOINT, [])
    areal = np.array([g is not None and g.kind in (POLYGON, MULTIPOLYGON) for g in gs], bool)
    return Given(many.of_geometries([nothing if g is None else g for g in gs]), np.array([g is None for g in gs], bool), srids.pop() if srids else 0, areal, False, lambda k: gs[k])


def _allowed(name: str, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """As ``scalar.boxes_allow``."""
    inside = lambda i, o: (o[:, :2] <= i[:, :2]).all(1) & (i[:, 2:] <= o[:, 2:]).all(1)
    if name in ("ST_Contains", "ST_ContainsProperly", "ST_Covers"):
        return inside(q, p)
    if name in ("ST_Within", "ST_CoveredBy"):
        return inside(p, q)
    if name == "ST_Equals":
        return inside(p, q) & inside(q, p)
    return (p[:, :2] <= q[:, 2:]).all(1) & (q[:, :2] <= p[:, 2:]).all(1)


def _holds(name: str, m: np.ndarray, da: np.ndarray, db: np.ndarray) -> np.ndarray:
    """The predicate from the matrices and both dimensions, as in ``scalar``."""
    if name == "ST_Crosses":
        outer = np.where(da < db, m[:, 2], m[:, 6])
        return np.where((da == 1) & (db == 1), m[:, 0] == 0, (da != db) & (m[:, 0] >= 0) & (outer >= 0))
    if name == "ST_Overlaps":
        return (da == db) & (m[:, 0] >= 0) & ((da != 1) | (m[:, 0] == 1)) & (m[:, 2] >= 0) & (m[:, 6] >= 0)
    out = np.zeros(len(m), bool)
    for p in S.PATTERNS["ST_Intersects" if name == "ST_Disjoint" else name]:
        out |= many.matches(m, p)
    return ~out if name == "ST_Disjoint" else out


def _predicate(f: S.Scalar, a: Given, b: Given, null: np.ndarray) -> pa.Array:
    out = np.full(len(null), f.name == "ST_Disjoint")
    rows = np.flatnonzero(_allowed(f.name, a.shapes.box, b.shapes.box) & ~null)
    one, two = a.shapes.take(rows), b.shapes.take(rows)
    if a.plain and b.plain and len(rows) and abs(one.dim[0] - two.dim[0]) == 2:
        area, dots = (one, two) if one.dim[0] == 2 else (two, one)
        out[rows] = S.of_point(f.name, many.locate(len(rows), area.rings, area.ring_row, dots.points, dots.point_row), area is one)
        return pa.array(out, pa.bool_(), mask=null)
    m, sure = many.relate(one, two)
    out[rows] = _holds(f.name, m, one.dim, two.dim)
    sure &= np.abs(one.dim - two.dim) < 2  # points are in an area if they are in any of its parts, which may overlap
    for k in rows[~sure].tolist():
        out[k] = f.call(a.read(k), b.read(k))
    return pa.array(out, pa.bool_(), mask=null)


def _relate(f: S.Scalar, a: Given, b: Given, null: np.ndarray, pattern: str | None) -> pa.Array:
    rows = np.flatnonzero(~null)
    m, sure = many.relate(a.shapes.take(rows), b.shapes.take(rows))
    if pattern is None:
        said = np.array(list("F012"))[m + 1].view("U9")[:, 0] if len(m) else np.empty(0, "U9")
    else:
        said = np.where(many.matches(m, pattern), "true", "false")
    out = np.full(len(null), None, object)
    out[rows] = said
    for k in rows[~sure].tolist():
        v = f.call(a.read(k), b.read(k), pattern)
        out[k] = v if pattern is None else "true" if v else "false"
    return pa.array(out, pa.string())


def _areas(found: list, null: np.ndarray, srid: int, each: Callable[[int], Geometry | None]) -> pa.Array:
    """EWKB of polygons by row; undecided ones (None) by ``each``."""
    out: list[bytes | None] = []
    for k, (polygons, gone) in enumerate(zip(found, null.tolist(), strict=True)):
        g = None if gone else each(k) if polygons is None else Geometry(MULTIPOLYGON, polygons, srid=srid)
        out.append(None if g is None else model.write_wkb(g))
    return pa.array(out, pa.binary())


def _inner_points(f: vector.Flat) -> np.ndarray:
    """``shape.inner_point`` of each row that is not null, for closed rings or lines."""
    starts = f.runs[f.rows[:-1][~f.null]]
    n, sizes = len(starts), np.diff(np.append(starts, len(f.xy)))
    row = np.repeat(np.arange(n), sizes)
    last = np.zeros(len(f.xy), bool)
    last[f.runs[1:] - 1] = True
    at = np.flatnonzero(~last)
    s, s_row = np.hstack([f.xy[at], f.xy[at + 1]]), row[at]
    out = f.xy[starts].copy()
    if f.kind == LINE:
        size = np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1])
        total = np.bincount(s_row, size, n)
        mean = np.stack([np.bincount(row, f.xy[:, k], n) / sizes for k in (0, 1)], 1)
        along = np.stack([np.bincount(s_row, (s[:, k] + s[:, k + 2]) / 2 * size, n) for k in (0, 1)], 1)
        middle = np.where(total[:, None] > 0, along / np.where(total > 0, total, 1)[:, None], mean)
        first = np.zeros(len(f.xy), bool)
        first[starts] = True
        of = np.flatnonzero(~(first | last) | (sizes[row] <= 2))
        order = np.lexsort((np.hypot(*(f.xy[of] - middle[row[of]]).T), row[of]))
        out = f.xy[of[order[np.searchsorted(row[of][order], np.arange(n))]]]
        return out
    y = f.xy[:, 1]
    middle = (np.minimum.reduceat(y, starts) + np.maximum.reduceat(y, starts)) / 2
    above = np.minimum.reduceat(np.where(y > middle[row], y, np.inf), starts)
    below = np.maximum.reduceat(np.where(y <= middle[row], y, -np.inf), starts)
    level = np.where(np.isfinite(above) & np.isfinite(below), (above + below) / 2, middle)
    own = level[s_row]
    k = np.flatnonzero((s[:, 1] <= own) != (s[:, 3] <= own))
    own, s, s_row = own[k], s[k], s_row[k]
    x = s[:, 0] + (own - s[:, 1]) * (s[:, 2] - s[:, 0]) / (s[:, 3] - s[:, 1])
    order = np.lexsort((x, s_row))
    x, s_row = x[order], s_row[order]
    place = np.arange(len(x)) - np.searchsorted(s_row, s_row)
    k = np.flatnonzero((place[:-1] % 2 == 0) & (s_row[:-1] == s_row[1:])) if len(x) else np.empty(0, np.int64)
    order = k[np.lexsort((k, x[k] - x[k + 1], s_row[k]))]  # the widest of a row first
    rows, first = np.unique(s_row[order], return_index=True)
    best = order[first]
    out[rows] = np.stack([(x[best] + x[best + 1]) / 2, level[rows]], 1)
    return out


def _alone(f: S.Scalar, a: pa.Array, decode: Callable) -> pa.Array | None:
    flat = vector.flat(a)
    if flat is None or flat.kind == POINT or flat.kind == LINE and f.name != "ST_PointOnSurface" or (srid := _srid(a)) is None:
        return None
    read = lambda k: decode(a[k].as_py(), "wkt" if pa.types.is_string(a.type) else "wkb")
    if f.name in ("ST_IsValid", "ST_IsValidReason"):
        found = many.invalid_reasons(flat.xy, flat.runs, flat.rows)
        if found is None:
            return None
        reasons, sure = found
        out = [(r is None) if f.name == "ST_IsValid" else r or "Valid Geometry" for r in reasons.tolist()]
        for k in np.flatnonzero(~sure & ~flat.null).tolist():
            out[k] = f.call(read(k))
        return pa.array([None if gone else v for v, gone in zip(out, flat.null.tolist(), strict=True)], pa.bool_() if f.name == "ST_IsValid" else pa.string())
    shapes = many.of_flat(flat.kind, flat.xy, flat.runs, flat.rows, vector._bounds(flat))
    if shapes is None:
        return None
    if f.name == "ST_MakeValid":
        return _areas(many.combine(shapes.n, [(shapes.rings, shapes.ring_row)], "odd", lambda x: x), flat.null, srid, lambda k: f.call(read(k)))
    where = iter(_inner_points(flat))
    return pa.array([None if gone else model.write_wkb(Geometry(POINT, next(where), srid=srid)) for gone in flat.null.tolist()], pa.binary())


def _buffers(f: S.Scalar, args: tuple[pa.Array, ...], decode: Callable) -> pa.Array | None:
    a, d = args
    flat = vector.flat(a)
    if flat is None or flat.kind != POLYGON or not pa.types.is_floating(d.type) or (srid := _srid(a)) is None:
        return None
    far = d.to_numpy(zero_copy_only=False).astype(float)
    found = many.convex_buffers(flat.xy, flat.runs, flat.rows, np.where(np.isnan(far), 0.0, far))
    kind = "wkt" if pa.types.is_string(a.type) else "wkb"
    return _areas([None if r is None else [[r]] for r in found], flat.null | np.asarray(d.is_null()), srid, lambda k: f.call(decode(a[k].as_py(), kind), float(far[k])))


def run(f: S.Scalar, args: tuple[pa.Array, ...], decode: Callable, all_of: Callable) -> pa.Array | None:
    """The function over a whole batch, or None."""
    if f.name in ALONE:
        return _alone(f, args[0], decode)
    if f.name == "ST_Buffer":
        return _buffers(f, args, decode)
    pattern = None
    if len(args) == 3:
        patterns = set(args[2].to_pylist())
        pattern = patterns.pop()
        if patterns or pattern is None or len(pattern) != 9:
            return None
    a = _given(args[0], f.name, 1, decode, all_of)
    b = None if a is None else _given(args[1], f.name, 2, decode, all_of)
    if b is None or a.srid != b.srid:
        return None
    null = a.null | b.null
    if f.name in PREDICATES:
        return _predicate(f, a, b, null)
    if f.name == "ST_Relate":
        return _relate(f, a, b, null, pattern)
    null |= ~(a.areal & b.areal)
    found = many.combine(len(null), [(a.shapes.rings, a.shapes.ring_row), (b.shapes.rings, b.shapes.ring_row)], "odd", OVERLAY[OVERLAYS[f.name]])
    return _areas(found, null, a.srid, lambda k: f.call(a.read(k), b.read(k)))
