"""Native forms of the functions by the types of their arguments.

``lowered(name, args)`` gives a Column of built-in functions for a call whose arguments are point structs, box structs and
numbers, or None where there is none. Values that a native form passes on to another may be of a different type from what the function
gives (a moved point is a struct there and not EWKB), so ``sql.planned`` uses such forms only inside others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import native

#: Predicates that hold only where the boxes meet, so that a constant's box rules rows out.
MEETING = ("ST_Intersects", "ST_Contains", "ST_ContainsProperly", "ST_Within", "ST_Covers", "ST_CoveredBy", "ST_Touches", "ST_Crosses", "ST_Overlaps", "ST_Equals", "ST_BBoxIntersects", "ST_DWithin")


@dataclass(frozen=True)
class Typed:
    """A value of a kind: point, box, or a built-in type."""

    kind: str
    value: Column


def there(g: Typed) -> Column:
    """Whether a geometry is not null."""
    v = g.value
    return v["x"].isNotNull() & v["y"].isNotNull() if g.kind == "point" else v["xmin"].isNotNull()


def srid(g: Typed) -> Column:
    return F.coalesce(g.value["srid"], F.lit(0))


def bounds(g: Typed) -> dict[str, Column]:
    v = g.value
    if g.kind == "point":
        return {"xmin": v["x"], "ymin": v["y"], "xmax": v["x"], "ymax": v["y"]}
    return {"xmin": F.least(v["xmin"], v["xmax"]), "ymin": F.least(v["ymin"], v["ymax"]), "xmax": F.greatest(v["xmin"], v["xmax"]), "ymax": F.greatest(v["ymin"], v["ymax"])}


def _given(g: Typed, value: Column) -> Column:
    return F.when(there(g), value)


def _box(g: Typed, by: Column | None = None) -> Column:
    own = bounds(g)
    grow = F.lit(0.0) if by is None else by.cast("double")
    fields = [(own[n] - grow if n.endswith("min") else own[n] + grow).alias(n) if by is not None else own[n].alias(n) for n in own]
    sure = there(g) if by is None else there(g) & by.isNotNull()
    return F.when(sure, F.struct(*fields, srid(g).alias("srid")))


def _alike(a: Typed, b: Typed, value: Column, name: str) -> Column:
    """A value of two geometries; different SRIDs are an error, as they are row by row."""
    wrong = F.raise_error(F.concat(F.lit(f"{name} cannot mix coordinate reference systems: "), srid(a).cast("string"), F.lit(" and "), srid(b).cast("string")))
    return F.when(there(a) & there(b), F.when(srid(a) == srid(b), value).otherwise(wrong))


def _moved(g: Typed, move: Callable[[Column, Column], tuple[Column, Column]], *by: Column) -> Typed:
    v = g.value
    known = there(g)
    for c in by:
        known &= c.isNotNull()
    if g.kind == "point":
        x, y = move(v["x"], v["y"])
        return Typed("point", F.when(known, F.struct(x.alias("x"), y.alias("y"), v["z"].alias("z"), v["m"].alias("m"), v["srid"].alias("srid"))))
    (x1, y1), (x2, y2) = move(v["xmin"], v["ymin"]), move(v["xmax"], v["ymax"])
    return Typed("box", F.when(known, F.struct(x1.alias("xmin"), y1.alias("ymin"), x2.alias("xmax"), y2.alias("ymax"), v["srid"].alias("srid"))))


def meet(a: Typed, b: Typed) -> Column:
    """Whether two boxes meet."""
    p, q = bounds(a), bounds(b)
    return (p["xmin"] <= q["xmax"]) & (q["xmin"] <= p["xmax"]) & (p["ymin"] <= q["ymax"]) & (q["ymin"] <= p["ymax"])


def _inside(point: Typed, box: Typed, rim: bool) -> Column:
    x, y, o = point.value["x"], point.value["y"], bounds(box)
    if rim:
        return (o["xmin"] <= x) & (x <= o["xmax"]) & (o["ymin"] <= y) & (y <= o["ymax"])
    return (o["xmin"] < x) & (x < o["xmax"]) & (o["ymin"] < y) & (y < o["ymax"])


def _predicate(name: str, a: Typed, b: Typed) -> Column | None:
    kinds = (a.kind, b.kind)
    value = None
    if name == "ST_BBoxIntersects":
        value = meet(a, b)
    elif kinds == ("point", "point"):
        same = (a.value["x"] == b.value["x"]) & (a.value["y"] == b.value["y"])
        value = {"ST_Intersects": same, "ST_Disjoint": ~same, "ST_Equals": same}.get(name)
    elif kinds in (("point", "box"), ("box", "point")):
        p, q = (a, b) if a.kind == "point" else (b, a)
        area_first = a.kind == "box"
        if name in ("ST_Intersects", "ST_Disjoint"):
            value = _inside(p, q, True) if name == "ST_Intersects" else ~_inside(p, q, True)
        elif name in (("ST_Covers",) if area_first else ("ST_CoveredBy",)):
            value = _inside(p, q, True)
        elif name in (("ST_Contains", "ST_ContainsProperly") if area_first else ("ST_Within",)):
            value = _inside(p, q, False)
        elif name == "ST_Touches":
            value = _inside(p, q, True) & ~_inside(p, q, False)
    elif kinds == ("box", "box") and name in ("ST_Intersects", "ST_Disjoint"):
        value = meet(a, b) if name == "ST_Intersects" else ~meet(a, b)
    return None if value is None else _alike(a, b, value, name)


def _measure(name: str, g: Typed) -> Typed | None:
    v, own, box = g.value, bounds(g), g.kind == "box"
    wide, high = own["xmax"] - own["xmin"], own["ymax"] - own["ymin"]
    nothing = F.lit(None).cast("double")
    forms: dict[str, tuple[str, Column]] = {
        "ST_X": ("double", nothing if box else v["x"]), "ST_Y": ("double", nothing if box else v["y"]),
        "ST_Z": ("double", nothing if box else v["z"]), "ST_M": ("double", nothing if box else v["m"]),
        "ST_XMin": ("double", own["xmin"]), "ST_YMin": ("double", own["ymin"]), "ST_XMax": ("double", own["xmax"]), "ST_YMax": ("double", own["ymax"]),
        "ST_Area": ("double", wide * high if box else F.lit(0.0)), "ST_Perimeter": ("double", wide + high + wide + high if box else F.lit(0.0)), "ST_Length": ("double", F.lit(0.0)),
        "ST_SRID": ("int", srid(g)), "ST_GeometryType": ("string", F.lit("ST_Polygon" if box else "ST_Point")), "ST_Dimension": ("int", F.lit(2 if box else 0)),
        "ST_NPoints": ("int", F.lit(5 if box else 1)), "ST_NumGeometries": ("int", F.lit(1)), "ST_IsEmpty": ("boolean", F.lit(False)),
    }
    if name not in forms:
        return None
    kind, value = forms[name]
    return Typed(kind, _given(g, value))


def lowered(name: str, args: list[Typed]) -> Typed | None:
    """The native form of a call, or None. Numbers are of kind double or int."""
    if not args or args[0].kind not in ("point", "box"):
        return None
    g, rest = args[0], args[1:]
    if not rest:
        if name == "ST_Envelope":
            return Typed("box", _box(g))
        if name == "ST_FlipCoordinates":
            return _moved(g, lambda x, y: (y, x))
        return _measure(name, g)
    if rest[0].kind in ("point", "box") and len(rest) == 1:
        other = rest[0]
        if name == "ST_Distance" and g.kind == other.kind == "point":
            return Typed("double", _alike(g, other, native.point_distance(g.value, other.value), name))
        found = _predicate(name, g, other)
        return None if found is None else Typed("boolean", found)
    if rest[0].kind in ("point", "box") and len(rest) == 2 and name == "ST_DWithin" and g.kind == rest[0].kind == "point":
        near = native.point_distance(g.value, rest[0].value) <= rest[1].value
        return Typed("boolean", F.when(rest[1].value.isNotNull(), _alike(g, rest[0], near, name)))
    numbers = [a.value.cast("double") for a in rest]
    if any(a.kind not in ("double", "int") for a in rest):
        return None
    if name == "ST_Expand" and len(numbers) == 1:
        return Typed("box", _box(g, numbers[0]))
    if name == "ST_Translate" and len(numbers) == 2:
        return _moved(g, lambda x, y: (x + numbers[0], y + numbers[1]), *numbers)
    if name == "ST_Scale" and len(numbers) == 2:
        return _moved(g, lambda x, y: (x * numbers[0], y * numbers[1]), *numbers)
    if name == "ST_Affine" and len(numbers) == 6 and g.kind == "point":
        a, b, d, e, dx, dy = numbers
        return _moved(g, lambda x, y: (a * x + b * y + dx, d * x + e * y + dy), *numbers)
    return None


def may_meet(g: Typed, box: tuple[float, float, float, float]) -> Column:
    """A range condition on a struct's fields that holds wherever it can meet a constant's box; Parquet's statistics can test it."""
    v, (x1, y1, x2, y2) = g.value, box
    if g.kind == "point":
        return (v["x"] >= x1) & (v["x"] <= x2) & (v["y"] >= y1) & (v["y"] <= y2)
    low = lambda a, limit: (v[f"{a}min"] <= limit) | (v[f"{a}max"] <= limit)
    high = lambda a, limit: (v[f"{a}min"] >= limit) | (v[f"{a}max"] >= limit)
    return low("x", x2) & high("x", x1) & low("y", y2) & high("y", y1)
