"""Arrow batches in and out of the scalar functions.

A batch is dispatched once on its arguments' Arrow types: binary is WKB or EWKB, string is WKT, a struct with x and
y is a point, one with xmin is a box. Decoded values are kept per worker, keyed by their bytes, so a constant is
decoded (and its edge index built) once, not once a row. Points against one constant area are located
as a whole batch.
"""

from __future__ import annotations

from collections import OrderedDict
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..geom import model, plane
from ..geom.model import POINT, Geometry
from . import scalar as S
from . import columns as C
from . import vector

BOX = pa.struct([("xmin", pa.float64()), ("ymin", pa.float64()), ("xmax", pa.float64()), ("ymax", pa.float64()), ("srid", pa.int32())])
ARROW = {"d": pa.float64(), "i": pa.int32(), "t": pa.string(), "o": pa.bool_(), "b": pa.binary(), "g": pa.binary(), "x": BOX, "l": pa.list_(pa.binary())}
SPARK = {"d": "double", "i": "int", "t": "string", "o": "boolean", "b": "binary", "g": "binary", "x": "struct<xmin:double,ymin:double,xmax:double,ymax:double,srid:int>", "l": "array<binary>"}

_kept: OrderedDict[Any, Geometry] = OrderedDict()
_KEEP, _KEEP_BYTES = 512, 1 << 20


def _decode(raw: Any, read) -> Geometry:
    if len(raw) > _KEEP_BYTES or len(raw) < 64:  # small ones are quicker to read than to look up
        return read(raw)
    g = _kept.get(raw)
    if g is None:
        g = _kept[raw] = read(raw)
        if len(_kept) > _KEEP:
            _kept.popitem(last=False)
    return g


def _one(v: Any, kind: str) -> Geometry | None:
    if v is None:
        return None
    if kind == "wkb":
        return _decode(v, model.read_wkb)
    if kind == "wkt":
        return _decode(v, model.read_wkt)
    srid = v.get("srid") or 0
    if kind == "point":
        if v["x"] is None or v["y"] is None:
            return None
        z, m = v.get("z"), v.get("m")
        return Geometry(POINT, np.array([v["x"], v["y"], *([z] if z is not None else []), *([m] if m is not None else [])], float), z is not None, m is not None, srid)
    if v["xmin"] is None:
        return None
    return model.rectangle(v["xmin"], v["ymin"], v["xmax"], v["ymax"], srid)


def kind_of(t: pa.DataType, name: str, number: int) -> str:
    if pa.types.is_binary(t) or pa.types.is_large_binary(t):
        return "wkb"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "wkt"
    if pa.types.is_struct(t):
        fields = {f.name for f in t}
        if {"x", "y"} <= fields:
            return "point"
        if {"xmin", "ymin", "xmax", "ymax"} <= fields:
            return "box"
    raise TypeError(f"{name}: argument {number} is not a geometry but {t}")


def geometries(a: pa.Array, name: str = "a geometry function", number: int = 1) -> list[Geometry | None]:
    if pa.types.is_null(a.type):
        return [None] * len(a)
    kind = kind_of(a.type, name, number)
    if isinstance(a, Same):
        return [_one(a.value, kind)] * len(a)
    if kind in ("wkb", "wkt") and len(a) > 1:
        coded = a.dictionary_encode()
        if len(coded.dictionary) * 2 <= len(a):  # repeated values are decoded once
            own = [_one(v, kind) for v in coded.dictionary.to_pylist()]
            return [None if i is None else own[i] for i in coded.indices.to_pylist()]
    return [_one(v, kind) for v in a.to_pylist()]


def points(a: pa.Array | Same) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Coordinates (n, 2), null mask and SRID if a column holds plain points of one SRID, else None."""
    if isinstance(a, Same):
        return None
    if pa.types.is_struct(a.type) and {"x", "y"} <= {f.name for f in a.type}:
        x, y = pc.struct_field(a, "x"), pc.struct_field(a, "y")
        srids = pc.unique(pc.fill_null(pc.struct_field(a, "srid"), 0)).to_pylist() if "srid" in {f.name for f in a.type} else [0]
        null = np.asarray(pc.or_(a.is_null(), pc.or_(x.is_null(), y.is_null())))
        xy = np.column_stack([np.asarray(pc.fill_null(x, 0.0)), np.asarray(pc.fill_null(y, 0.0))])
        return (xy, null, srids[0] or 0) if len(srids) == 1 else None
    if pa.types.is_binary(a.type) and a.null_count == 0 and len(a) and pc.all(pc.equal(pc.binary_length(a), 21)).as_py():
        raw = np.frombuffer(a.buffers()[2], np.uint8, 21 * len(a), np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset)[0]).reshape(-1, 21)
        if (raw[:, :5] == np.array([1, 1, 0, 0, 0], np.uint8)).all():
            xy = np.ascontiguousarray(raw[:, 5:]).view("<f8").reshape(-1, 2)
            return xy, np.isnan(xy).all(1), 0
    return None


class Same:
    """A constant argument: one value for every row."""

    def __init__(self, value: Any, n: int):
        self.value, self.n = value, n
        self.type = pa.scalar(value).type

    def __len__(self) -> int:
        return self.n

    def to_pylist(self) -> list:
        return [self.value] * self.n


def run_with(f: S.Scalar, args: list, constant: set[int]) -> pa.Array:
    """One batch in which some arguments are plain Python values."""
    n = next(len(a) for k, a in enumerate(args) if k not in constant)
    return run(f, tuple(Same(a, n) if k in constant else a for k, a in enumerate(args)))


def _constant(a: pa.Array | Same) -> Any:
    """The one value of a column of equal short values or of a constant, else None."""
    if isinstance(a, Same):
        return a.value if isinstance(a.value, (str, bytes)) else None
    if len(a) == 0 or a.null_count or not (pa.types.is_binary(a.type) or pa.types.is_string(a.type)):
        return None
    if a.nbytes > 4096 * len(a):  # comparing long values costs more than it saves
        return a[0].as_py() if len(a) == 1 else None
    first = a[0]
    return first.as_py() if len(a) == 1 or (a[len(a) - 1] == first and len(pc.unique(a)) == 1) else None


def _located(name: str, args: tuple[pa.Array, ...]) -> pa.Array | None:
    """Points against one constant area, all at once."""
    for k in (0, 1):
        raw = _constant(args[k])
        if raw is None or (own := points(args[1 - k])) is None:
            continue
        g = _one(raw, "wkb" if isinstance(raw, bytes) else "wkt")
        if not plane.areal(g) or g.srid != own[2]:
            continue
        return pa.array(S.of_point(name, plane.locate(g, own[0]), k == 0), pa.bool_(), mask=own[1])
    return None


def _reprojected(args: tuple[pa.Array | Same, ...]) -> pa.Array | None:
    """A column of plain points, lines or polygons of one SRID in another reference system, all at once."""
    targets = [args[1].value] if isinstance(args[1], Same) else pc.unique(args[1]).to_pylist()
    if isinstance(args[0], Same) or len(targets) > 1 or targets[0] is None:
        return None
    a, target = args[0], int(targets[0])
    if pa.types.is_struct(a.type):
        flat = all(pc.struct_field(a, k.name).null_count == len(a) for k in a.type if k.name in ("z", "m"))
        own = points(a) if flat else None
        return None if own is None else vector.reprojected_points(*own, target)
    return vector.reprojected(a, target) if pa.types.is_binary(a.type) else None


def run(f: S.Scalar, args: tuple[pa.Array, ...]) -> pa.Array:
    """One batch of a scalar function."""
    if not f.least <= len(args) <= len(f.args):
        raise TypeError(f"{f.name} expected {f.least} arguments" + (f" to {len(f.args)}" if f.least < len(f.args) else "") + f", got {len(args)}")
    n = max((len(a) for a in args), default=0)
    if f.name in S.PREDICATES and n > 1 and (quick := _located(f.name, args)) is not None:
        return quick
    if f.name == "ST_Transform" and n > 1 and (quick := _reprojected(args)) is not None:
        return quick
    if f.name in ("ST_X", "ST_Y") and pa.types.is_struct(args[0].type) and (own := points(args[0])) is not None:
        return pa.array(np.ascontiguousarray(own[0][:, int(f.name == "ST_Y")]), pa.float64(), mask=own[1])
    if len(args) == 1 and isinstance(args[0], pa.Array) and (quick := vector.measure(f.name, args[0])) is not None:
        return quick
    if f.name in (*C.PAIRED, *C.ALONE, "ST_Buffer") and n > 1 and all(isinstance(a, pa.Array) and len(a) == n for a in args[:2]) and not any(pa.types.is_null(a.type) for a in args) and (quick := C.run(f, args, _one, geometries)) is not None:
        return quick
    columns = []
    for k, (a, letter) in enumerate(zip(args, f.args, strict=False)):
        if letter in "gp":
            columns.append(geometries(a, f.name, k + 1))
        elif letter in "dije" and not (pa.types.is_string(a.type) or pa.types.is_binary(a.type)):
            columns.append([None if v is None else float(v) if letter in "de" else int(v) for v in a.to_pylist()])
        elif letter == "s" and (pa.types.is_string(a.type) or pa.types.is_null(a.type)) or letter == "b" and (pa.types.is_binary(a.type) or pa.types.is_null(a.type)):
            columns.append(a.to_pylist())
        else:
            raise TypeError(f"{f.name}: argument {k + 1} cannot be {a.type}")
    needed = [k for k, letter in enumerate(f.args[: len(args)]) if letter not in "pje"]
    out: list[Any] = []
    for row in zip(*columns, strict=True):
        if any(row[k] is None for k in needed):
            out.append(None)
            continue
        if f.same_srid and row[0].srid != row[1].srid:
            raise ValueError(f"{f.name} cannot mix coordinate reference systems: {row[0].srid} and {row[1].srid}")
        v = f.call(*row)
        if f.result == "g":
            v = None if v is None else model.write_wkb(v)
        elif f.result == "x" and v is not None:
            v = dict(zip(("xmin", "ymin", "xmax", "ymax", "srid"), v, strict=True))
        elif f.result == "t" and isinstance(v, bool):  # the pattern form of ST_Relate
            v = "true" if v else "false"
        elif f.result == "d" and v is not None:
            v = float(v)
        elif f.result == "o" and v is not None:
            v = bool(v)
        out.append(v)
    return pa.array(out, ARROW[f.result])
