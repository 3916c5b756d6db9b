"""Geometries in memory and their encodings: WKB, EWKB, WKT, GeoJSON, geohash.

A geometry is a kind (1 point to 7 collection, as in WKB), its data, whether it has z and m, and an SRID. Data is
a coordinate array for a point (or None if empty) and a line, a list of ring arrays for a polygon, and lists of the
same for the multi kinds; a collection lists geometries. Measures come after z in a coordinate.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from typing import Any

import numpy as np

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINE: "MultiLineString", MULTIPOLYGON: "MultiPolygon", COLLECTION: "GeometryCollection"}


class Geometry:
    __slots__ = ("kind", "data", "z", "m", "srid", "_box", "_edges")

    def __init__(self, kind: int, data: Any, z: bool = False, m: bool = False, srid: int = 0):
        self.kind, self.data, self.z, self.m, self.srid, self._box, self._edges = kind, data, z, m, srid, None, None

    @property
    def width(self) -> int:
        return 2 + self.z + self.m

    def like(self, kind: int, data: Any) -> Geometry:
        """Another geometry with this one's dimensions and SRID."""
        return Geometry(kind, data, self.z, self.m, self.srid)

    def flat(self, kind: int, data: Any) -> Geometry:
        """A two-dimensional geometry with this one's SRID."""
        return Geometry(kind, data, srid=self.srid)

    def singles(self) -> Iterator[Geometry]:
        """Points, lines and polygons at any depth."""
        if self.kind == COLLECTION:
            for g in self.data:
                yield from g.singles()
        elif self.kind >= MULTIPOINT:
            for d in self.data:
                yield self.like(self.kind - 3, d)
        else:
            yield self

    def parts(self) -> list[Geometry]:
        """Parts, one level deep."""
        if self.kind == COLLECTION:
            return list(self.data)
        return list(self.singles())

    def arrays(self) -> list[np.ndarray]:
        """All coordinate runs, each of shape (n, width)."""
        out: list[np.ndarray] = []
        for g in self.singles():
            if g.kind == POINT:
                out += [g.data.reshape(1, -1)] if g.data is not None else []
            elif g.kind == LINE:
                out.append(g.data)
            else:
                out += g.data
        return out

    def coords(self) -> np.ndarray:
        """All coordinates, x and y only."""
        runs = [a[:, :2] for a in self.arrays() if len(a)]
        return np.concatenate(runs) if runs else np.empty((0, 2))

    def n_points(self) -> int:
        return sum(len(a) for a in self.arrays())

    def empty(self) -> bool:
        return self.n_points() == 0

    def box(self) -> tuple[float, float, float, float] | None:
        if self._box is None:
            c = self.coords()
            c = c[~np.isnan(c).any(axis=1)]
            self._box = (*c.min(0).tolist(), *c.max(0).tolist()) if len(c) else ()
        return self._box or None

    def mapped(self, f) -> Geometry:
        """Every coordinate run passed through ``f``."""
        if self.kind == COLLECTION:
            return self.like(COLLECTION, [g.mapped(f) for g in self.data])

        def walk(kind: int, d: Any) -> Any:
            if kind == POINT:
                return None if d is None else f(d.reshape(1, -1))[0]
            if kind == LINE:
                return f(d)
            if kind == POLYGON:
                return [f(r) for r in d]
            return [walk(kind - 3, x) for x in d]

        return self.like(self.kind, walk(self.kind, self.data))

    def plane(self) -> Geometry:
        """x and y only."""
        if not (self.z or self.m):
            return self
        g = self.mapped(lambda a: a[:, :2])

        def clear(x: Geometry) -> None:
            x.z = x.m = False
            if x.kind == COLLECTION:
                for y in x.data:
                    clear(y)

        clear(g)
        return g


def point(x: float, y: float, srid: int = 0) -> Geometry:
    return Geometry(POINT, np.array([x, y], float), srid=srid)


def line(coords: Any, srid: int = 0) -> Geometry:
    return Geometry(LINE, np.asarray(coords, float).reshape(-1, 2), srid=srid)


def rectangle(x0: float, y0: float, x1: float, y1: float, srid: int = 0) -> Geometry:
    return Geometry(POLYGON, [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], float)], srid=srid)


def gather(parts: list[Geometry], srid: int = 0) -> Geometry:
    """A collection; one part alone is that part."""
    return parts[0] if len(parts) == 1 else Geometry(COLLECTION, parts, srid=srid)


# ---- WKB and EWKB

_SRID, _M, _Z = 0x20000000, 0x40000000, 0x80000000


def read_wkb(raw: bytes, keep_srid: bool = True) -> Geometry:
    g, at = _read(bytes(raw), 0, 0)
    if not keep_srid:
        _stamp(g, 0)
    return g


def _stamp(g: Geometry, srid: int) -> Geometry:
    g.srid = srid
    if g.kind == COLLECTION:
        for x in g.data:
            _stamp(x, srid)
    return g


def with_srid(g: Geometry, srid: int) -> Geometry:
    out = Geometry(g.kind, g.data, g.z, g.m, srid)
    if g.kind == COLLECTION:
        out.data = [with_srid(x, srid) for x in g.data]
    return out


def _read(raw: bytes, at: int, srid: int) -> tuple[Geometry, int]:
    e = "<" if raw[at] == 1 else ">"
    (code,) = struct.unpack_from(e + "I", raw, at + 1)
    at += 5
    z, m = bool(code & _Z), bool(code & _M)
    if code & _SRID:
        (srid,) = struct.unpack_from(e + "I", raw, at)
        at += 4
    code &= 0x0FFFFFFF
    iso, kind = divmod(code, 1000)
    z, m = z or iso in (1, 3), m or iso in (2, 3)
    if not 1 <= kind <= 7 or iso > 3:
        raise ValueError(f"unknown WKB geometry type {code}")
    width = 2 + z + m

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(e + "I", raw, at)
        at += 4
        return n

    def run(n: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(raw, e + "f8", n * width, at).reshape(n, width)
        at += 8 * n * width
        return a if e == "<" else a.astype("<f8")

    data: Any
    if kind == POINT:
        data = run(1)[0]
        data = None if np.isnan(data[:2]).all() else data
    elif kind == LINE:
        data = run(count())
    elif kind == POLYGON:
        data = [run(count()) for _ in range(count())]
    else:
        data = []
        for _ in range(count()):
            g, at = _read(raw, at, srid)
            data.append(g if kind == COLLECTION else g.data)
    return Geometry(kind, data, z, m, srid), at


def write_wkb(g: Geometry, srid: bool = True) -> bytes:
    out: list[bytes] = []
    _write(g, g.srid if srid else 0, out)
    return b"".join(out)


def _write(g: Geometry, srid: int, out: list[bytes]) -> None:
    flags = (_Z if g.z and srid else 0) | (_M if g.m and srid else 0)
    code = g.kind | flags if srid else g.kind + 1000 * (g.z + 2 * g.m)
    out.append(struct.pack("<BI", 1, code | (_SRID if srid else 0)))
    if srid:
        out.append(struct.pack("<I", srid & 0xFFFFFFFF))

    def run(a: np.ndarray) -> bytes:
        return np.ascontiguousarray(a, "<f8").tobytes()

    if g.kind == POINT:
        out.append(run(g.data) if g.data is not None else run(np.full(g.width, np.nan)))
    elif g.kind == LINE:
        out += [struct.pack("<I", len(g.data)), run(g.data)]
    elif g.kind == POLYGON:
        out.append(struct.pack("<I", len(g.data)))
        for r in g.data:
            out += [struct.pack("<I", len(r)), run(r)]
    else:
        out.append(struct.pack("<I", len(g.data)))
        for d in g.data:
            _write(d if g.kind == COLLECTION else Geometry(g.kind - 3, d, g.z, g.m), 0, out)


# ---- WKT

_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_TAGS = {n.upper(): k for k, n in NAMES.items()}


def read_wkt(text: str) -> Geometry:
    srid, body = 0, text.strip()
    if found := re.match(r"SRID\s*=\s*(\d+)\s*;", body, re.I):
        srid, body = int(found[1]), body[found.end() :]
    tokens, at = [], 0
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            if body[at:].strip():
                raise ValueError(f"cannot read WKT: {text[:80]}")
            break
        tokens.append(m[1])
        at = m.end()
    g, end = _wkt(tokens, 0)
    if end != len(tokens):
        raise ValueError(f"cannot read WKT: {text[:80]}")
    return _stamp(g, srid)


def _wkt(t: list[str], at: int) -> tuple[Geometry, int]:
    try:
        tag = t[at].upper()
        at += 1
        dims = ""
        if tag not in _TAGS and tag.rstrip("ZM") in _TAGS:
            tag, dims = tag.rstrip("ZM"), tag[len(tag.rstrip("ZM")) :]
        kind = _TAGS[tag]
        if t[at].upper() in ("Z", "M", "ZM"):
            dims = t[at].upper()
            at += 1
        width = [0]

        def coord(at: int) -> tuple[list[float], int]:
            c = []
            while t[at] not in ",()":
                c.append(float(t[at]))
                at += 1
            width[0] = width[0] or len(c)
            if len(c) != width[0] or not 2 <= len(c) <= 4:
                raise ValueError
            return c, at

        def listed(at: int, item) -> tuple[list, int]:
            if t[at].upper() == "EMPTY":
                return [], at + 1
            assert t[at] == "("
            out = []
            while True:
                x, at = item(at + 1)
                out.append(x)
                if t[at] == ")":
                    return out, at + 1
                assert t[at] == ","

        def run(at: int) -> tuple[np.ndarray, int]:
            cs, at = listed(at, coord)
            return np.array(cs, float).reshape(len(cs), -1) if cs else np.empty((0, 2 + len(dims))), at

        def rings(at: int) -> tuple[list, int]:
            return listed(at, run)

        def dot(at: int) -> tuple[Any, int]:
            if t[at] == "(":
                c, at = listed(at, coord)
                return (np.array(c[0], float) if c else None), at
            if t[at].upper() == "EMPTY":
                return None, at + 1
            c, at = coord(at)
            return np.array(c, float), at

        data: Any
        if kind == POINT:
            data, at = dot(at)
        elif kind == LINE:
            data, at = run(at)
        elif kind == POLYGON:
            data, at = rings(at)
        elif kind == COLLECTION:
            data, at = listed(at, lambda a: _wkt(t, a))
        else:
            data, at = listed(at, {MULTIPOINT: dot, MULTILINE: run, MULTIPOLYGON: rings}[kind])
    except (IndexError, KeyError, AssertionError, ValueError) as e:
        raise ValueError(f"cannot read WKT near {' '.join(t[:12])}") from e
    n = width[0]
    z, m = "Z" in dims or (not dims and n >= 3), "M" in dims or (not dims and n == 4)
    if kind == COLLECTION and data:
        z, m = data[0].z, data[0].m
    return Geometry(kind, data, z, m), at


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(float(x))


def write_wkt(g: Geometry) -> str:
    dims = (" Z" if g.z else " M" if g.m else "") if not (g.z and g.m) else " ZM"
    tag = NAMES[g.kind].upper() + dims

    def coord(c: np.ndarray) -> str:
        return " ".join(map(number, c.tolist()))

    def run(a: np.ndarray) -> str:
        return "(" + ",".join(coord(c) for c in a) + ")"

    def rings(d: list) -> str:
        return "(" + ",".join(run(r) for r in d) + ")"

    if g.kind == POINT:
        return f"{tag} EMPTY" if g.data is None else f"{tag}({coord(g.data)})"
    if not len(g.data):
        return f"{tag} EMPTY"
    if g.kind == COLLECTION:
        return tag + "(" + ",".join(map(write_wkt, g.data)) + ")"
    item = {LINE: None, POLYGON: run, MULTIPOINT: lambda d: "EMPTY" if d is None else f"({coord(d)})", MULTILINE: run, MULTIPOLYGON: rings}[g.kind]
    return tag + (run(g.data) if g.kind == LINE else "(" + ",".join(map(item, g.data)) + ")")


# ---- GeoJSON

def read_geojson(text: str) -> Geometry:
    try:
        return _from_json(json.loads(text))
    except (KeyError, TypeError, AttributeError, ValueError) as e:
        raise ValueError(f"cannot read GeoJSON: {text[:80]}") from e


def _from_json(o: dict) -> Geometry:
    if o["type"] == "Feature":
        return _from_json(o["geometry"])
    if o["type"] == "FeatureCollection":
        return Geometry(COLLECTION, [_from_json(f) for f in o["features"]])
    kind = _TAGS[o["type"].upper()]
    if kind == COLLECTION:
        return Geometry(COLLECTION, [_from_json(x) for x in o["geometries"]])
    z = [False]

    def walk(k: int, d: Any) -> Any:
        if k == POINT:
            z[0] |= len(d) > 2
            return np.array(d[:3], float) if d else None
        if k == LINE:
            z[0] |= any(len(c) > 2 for c in d)
            return np.array([c[:3] for c in d], float).reshape(len(d), -1) if d else np.empty((0, 2))
        return [walk(LINE if k == POLYGON else k - 3, x) for x in d]

    data = walk(kind, o["coordinates"])
    return Geometry(kind, data, z[0])


def write_geojson(g: Geometry) -> str:
    def walk(k: int, d: Any) -> Any:
        if k == POINT:
            return [] if d is None else [int(v) if v == int(v) and abs(v) < 1e15 else v for v in d[:2].tolist()]
        if k == LINE:
            return [walk(POINT, c) for c in d]
        return [walk(LINE if k == POLYGON else k - 3, x) for x in d]

    def obj(x: Geometry) -> dict:
        if x.kind == COLLECTION:
            return {"type": NAMES[x.kind], "geometries": [obj(y) for y in x.data]}
        return {"type": NAMES[x.kind], "coordinates": walk(x.kind, x.data)}

    return json.dumps(obj(g), separators=(",", ":"))


# ---- geohash

_LETTERS = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed alphabet


def write_geohash(x: float, y: float, size: int) -> str | None:
    if not (-180 <= x <= 180 and -90 <= y <= 90):
        return None
    box, bits = [[-180.0, 180.0], [-90.0, 90.0]], 0
    for k in range(5 * size):
        r, v = box[k % 2], (x, y)[k % 2]
        mid = (r[0] + r[1]) / 2
        high = v >= mid
        bits = bits << 1 | high
        r[0 if high else 1] = mid
    return "".join(_LETTERS[bits >> 5 * (size - 1 - i) & 31] for i in range(size))


def read_geohash(text: str) -> tuple[float, float] | None:
    box = [[-180.0, 180.0], [-90.0, 90.0]]
    if not text:
        return None
    k = 0
    for c in text:
        v = _LETTERS.find(c)
        if v < 0:
            return None
        for b in range(4, -1, -1):
            r = box[k % 2]
            r[0 if v >> b & 1 else 1] = (r[0] + r[1]) / 2
            k += 1
    return sum(box[0]) / 2, sum(box[1]) / 2
