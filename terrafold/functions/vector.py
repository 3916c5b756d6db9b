"""Measures, bounds and reprojection of whole columns at once, for columns of one plain kind: 2D points, lines or polygons.

``flat`` takes an Arrow column apart without a Python object per row: WKT by Arrow's string functions, little-endian WKB and
EWKB by offsets. It gives None for anything else (mixed kinds, z or m, empty parts, odd spacing, NaN), which then goes row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..geom import crs
from ..geom.model import LINE, NAMES, POINT, POLYGON

_OPEN = {POINT: ("POINT(", ")"), LINE: ("LINESTRING(", ")"), POLYGON: ("POLYGON((", "))")}


@dataclass
class Flat:
    kind: int
    xy: np.ndarray
    runs: np.ndarray  # first coordinate of each run (a line, or a ring), and the end
    rows: np.ndarray  # first run of each row, and the end
    null: np.ndarray


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.diff(np.asarray(lists.offsets))


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _from_text(a: pa.Array) -> Flat | None:
    null = np.asarray(a.is_null())
    some = a.drop_null()
    if not len(some):
        return None
    first = some[0].as_py()
    for kind, (head, tail) in _OPEN.items():
        if first.startswith(head):
            break
    else:
        return None
    inner = r"[-+0-9.eE ,]+" + (r"(\),\([-+0-9.eE ,]+)*" if kind == POLYGON else "")
    if not pc.all(pc.match_substring_regex(some, f"^{head.replace('(', '[(]')}{inner}{tail.replace(')', '[)]')}$")).as_py():
        return None
    body = pc.utf8_slice_codeunits(some, len(head), -len(tail))
    rings = pc.split_pattern(body, "),(") if kind == POLYGON else None
    texts = rings.flatten() if rings is not None else body
    dots = pc.split_pattern(texts, ",")
    numbers = pc.split_pattern(dots.flatten(), " ")
    if not (_sizes(numbers) == 2).all():
        return None
    try:
        xy = np.asarray(pc.cast(numbers.flatten(), pa.float64())).reshape(-1, 2)
    except pa.ArrowInvalid:
        return None
    per_row = np.zeros(len(a), np.int64)
    per_row[~null] = _sizes(rings) if rings is not None else 1
    return Flat(kind, xy, _ends(_sizes(dots)), _ends(per_row), null)


@dataclass
class Layout:
    """Where the coordinates of a column of (E)WKB of one kind stand in its bytes."""

    raw: np.ndarray
    starts: np.ndarray  # first byte of each value that is not null
    offsets: np.ndarray
    kind: int
    srid: bool  # whether the values carry one
    many: np.ndarray  # coordinates of each value
    bytes: np.ndarray  # places of all coordinates' bytes
    null: np.ndarray

    def word(self, at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.raw[at[:, None] + np.arange(4)]).view("<u4")[:, 0].astype(np.int64)

    @property
    def xy(self) -> np.ndarray:
        return np.ascontiguousarray(self.raw[self.bytes]).view("<f8").reshape(-1, 2)


def _layout(a: pa.Array) -> Layout | None:
    null = np.asarray(a.is_null())
    some = a.drop_null()
    if not len(some) or some.type != pa.binary():
        return None
    offsets = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1].astype(np.int64)
    own = Layout(np.frombuffer(some.buffers()[2], np.uint8), offsets[:-1], offsets, 0, False, offsets[:-1], offsets[:-1], null)
    raw, starts, word = own.raw, own.starts, own.word
    if np.diff(offsets).min() < 21:
        return None
    code = word(starts + 1)
    if not (raw[starts] == 1).all() or not (code == code[0]).all() or code[0] & ~0x20000007 or (code[0] & 7) not in _OPEN:
        return None
    own.kind, own.srid = int(code[0] & 7), bool(code[0] & 0x20000000)
    body = starts + (9 if own.srid else 5)
    if own.kind == POLYGON:
        if not (word(body) == 1).all():
            return None
        body = body + 4
    many = np.ones(len(body), np.int64)
    if own.kind != POINT:
        many, body = word(body), body + 4
    if not (body + 16 * many == offsets[1:]).all() or not many.all():
        return None
    ends = _ends(16 * many)
    own.many, own.bytes = many, np.repeat(body - ends[:-1], 16 * many) + np.arange(ends[-1])
    return own


def _from_wkb(a: pa.Array) -> Flat | None:
    own = _layout(a)
    return None if own is None else Flat(own.kind, own.xy, _ends(own.many), _ends((~own.null).astype(np.int64)), own.null)


def reprojected(a: pa.Array, target: int) -> pa.Array | None:
    """EWKB in another reference system, all coordinates of the column at once; None unless all values are of one plain kind and one SRID."""
    own = _layout(a)
    if own is None or not own.srid:
        return None
    srids, xy = np.unique(own.word(own.starts + 5)), own.xy
    if len(srids) > 1 or not srids[0] or np.isnan(xy).any():
        return None
    moved = np.array(crs.transform(xy, int(srids[0]), target))
    if own.kind != POINT:  # closed stays closed: equal inputs may differ in the last bit, by their place in an array
        ends = _ends(own.many)
        closed = (xy[ends[:-1]] == xy[ends[1:] - 1]).all(1)
        moved[ends[1:][closed] - 1] = moved[ends[:-1][closed]]
    out = own.raw.copy()
    out[own.bytes] = moved.view(np.uint8).ravel()
    out[own.starts[:, None] + np.arange(5, 9)] = np.frombuffer(np.uint32(target).tobytes(), np.uint8)
    return _spread(pa.Array.from_buffers(pa.binary(), len(own.starts), [None, pa.py_buffer(own.offsets.astype(np.int32)), pa.py_buffer(out)]), own.null)


def reprojected_points(xy: np.ndarray, null: np.ndarray, source: int, target: int) -> pa.Array | None:
    """The same for coordinates of points."""
    xy = xy[~null]
    if not source or not len(xy) or np.isnan(xy).any():
        return None
    out = np.zeros(len(xy), [("order", "u1"), ("code", "<u4"), ("srid", "<u4"), ("xy", "<f8", 2)])
    out["order"], out["code"], out["srid"], out["xy"] = 1, 0x20000001, target, crs.transform(xy, source, target)
    return _spread(pa.Array.from_buffers(pa.binary(), len(xy), [None, pa.py_buffer(np.arange(len(xy) + 1, dtype=np.int32) * out.itemsize), pa.py_buffer(out.tobytes())]), null)


def _spread(some: pa.Array, null: np.ndarray) -> pa.Array:
    """Nulls put back in."""
    return some.take(pa.array(np.where(null, 0, np.cumsum(~null) - 1), mask=null)) if null.any() else some


def flat(a: pa.Array) -> Flat | None:
    found = _from_text(a) if pa.types.is_string(a.type) else _from_wkb(a) if pa.types.is_binary(a.type) else None
    return None if found is None or np.isnan(found.xy).any() else found


def _per_row(f: Flat, x: np.ndarray) -> np.ndarray:
    ends = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
    return ends[f.rows[1:]] - ends[f.rows[:-1]]


def _lengths(f: Flat) -> np.ndarray:
    d = np.diff(f.xy, axis=0)
    d[f.runs[1:-1] - 1] = 0  # from one run to the next
    return np.hypot(d[:, 0], d[:, 1])


def _first_of_row(f: Flat) -> np.ndarray:
    first = np.zeros(len(f.runs) - 1, bool)
    first[f.rows[:-1][~f.null]] = True
    return first


def _area(f: Flat) -> np.ndarray:
    if f.kind != POLYGON:
        return np.zeros(len(f.null))
    xy = f.xy - np.repeat(f.xy[f.runs[:-1]], np.diff(f.runs), axis=0)  # relative to each ring's start
    steps = xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1]
    steps[f.runs[1:-1] - 1] = 0
    rings = np.abs(np.add.reduceat(np.append(steps, 0.0), f.runs[:-1])) / 2
    first = _first_of_row(f)
    out = np.zeros(len(f.null))
    np.add.at(out, np.repeat(np.arange(len(f.null)), np.diff(f.rows)), np.where(first, rings, -rings))
    return out


def _summed(f: Flat) -> np.ndarray:
    out = np.zeros(len(f.null))
    runs = np.add.reduceat(np.append(_lengths(f), 0.0), f.runs[:-1])
    np.add.at(out, np.repeat(np.arange(len(f.null)), np.diff(f.rows)), runs)
    return out


def _bounds(f: Flat) -> np.ndarray:
    """(rows, 4) of xmin, ymin, xmax, ymax; nulls are NaN."""
    out = np.full((len(f.null), 4), np.nan)
    starts = f.runs[f.rows[:-1][~f.null]]
    out[~f.null, :2], out[~f.null, 2:] = np.minimum.reduceat(f.xy, starts), np.maximum.reduceat(f.xy, starts)
    return out


def _count(f: Flat) -> np.ndarray:
    return _per_row(f, np.diff(f.runs))


def _column(x: np.ndarray, f: Flat, kind: pa.DataType) -> pa.Array:
    return pa.array(x, kind, mask=f.null)


MEASURES = {
    "ST_Area": lambda f: _column(_area(f), f, pa.float64()),
    "ST_Length": lambda f: _column(_summed(f) if f.kind == LINE else np.zeros(len(f.null)), f, pa.float64()),
    "ST_Perimeter": lambda f: _column(_summed(f) if f.kind == POLYGON else np.zeros(len(f.null)), f, pa.float64()),
    "ST_XMin": lambda f: _column(_bounds(f)[:, 0], f, pa.float64()),
    "ST_YMin": lambda f: _column(_bounds(f)[:, 1], f, pa.float64()),
    "ST_XMax": lambda f: _column(_bounds(f)[:, 2], f, pa.float64()),
    "ST_YMax": lambda f: _column(_bounds(f)[:, 3], f, pa.float64()),
    "ST_NPoints": lambda f: _column(_count(f).astype(np.int32), f, pa.int32()),
    "ST_GeometryType": lambda f: pa.array(np.where(f.null, None, "ST_" + NAMES[f.kind]), pa.string()),
    "ST_Dimension": lambda f: _column(np.full(len(f.null), f.kind - 1, np.int32), f, pa.int32()),
    "ST_IsEmpty": lambda f: _column(np.zeros(len(f.null), bool), f, pa.bool_()),
    "ST_NumGeometries": lambda f: _column(np.ones(len(f.null), np.int32), f, pa.int32()),
}


def measure(name: str, a: pa.Array) -> pa.Array | None:
    """The function over the whole column, or None where it has to go row by row."""
    if name not in MEASURES or len(a) < 2:
        return None
    f = flat(a)
    return None if f is None else MEASURES[name](f)
