"""Column forms that stay in Catalyst: points and boxes as structs, and what can be read off them without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def st_point(x: Column, y: Column, z: Column | None = None, srid: int = 0) -> Column:
    """Point struct; null where an ordinate is null."""
    fields = [x.cast("double").alias("x"), y.cast("double").alias("y"), (F.lit(None) if z is None else z).cast("double").alias("z"), F.lit(None).cast("double").alias("m"), F.lit(srid).alias("srid")]
    missing = x.isNull() | y.isNull() | (F.lit(False) if z is None else z.isNull())
    return F.when(~missing, F.struct(*fields))


def st_make_envelope(x1: Column, y1: Column, x2: Column, y2: Column, srid: int = 0) -> Column:
    """Box struct, ordinates as given."""
    own = [c.cast("double").alias(n) for c, n in ((x1, "xmin"), (y1, "ymin"), (x2, "xmax"), (y2, "ymax"))]
    return F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), F.struct(*own, F.lit(srid).alias("srid")))


def point_box(p: Column) -> Column:
    """The box of a point struct."""
    return st_make_envelope(p["x"], p["y"], p["x"], p["y"])


def box_ordered(b: Column) -> Column:
    """A box with its lower ordinates first, whatever the order that they were given in."""
    one = [F.least(b["xmin"], b["xmax"]), F.least(b["ymin"], b["ymax"]), F.greatest(b["xmin"], b["xmax"]), F.greatest(b["ymin"], b["ymax"])]
    fields = [c.alias(n) for c, n in zip(one, ("xmin", "ymin", "xmax", "ymax"), strict=True)]
    return F.when(b["xmin"].isNotNull() & b["ymin"].isNotNull() & b["xmax"].isNotNull() & b["ymax"].isNotNull(), F.struct(*fields, b["srid"].alias("srid")))


def box_area(b: Column) -> Column:
    return (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"])


def box_perimeter(b: Column) -> Column:
    return 2 * ((b["xmax"] - b["xmin"]) + (b["ymax"] - b["ymin"]))


def box_expand(b: Column, d: Column) -> Column:
    return st_make_envelope(b["xmin"] - d, b["ymin"] - d, b["xmax"] + d, b["ymax"] + d)


def boxes_intersect(a: Column, b: Column) -> Column:
    """Touching counts."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def box_contains(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmin"]) & (b["xmax"] <= a["xmax"]) & (a["ymin"] <= b["ymin"]) & (b["ymax"] <= a["ymax"])


def point_distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def point_distance_sphere(p: Column, q: Column) -> Column:
    """Haversine metres between longitude/latitude points."""
    from ..geom.geodesic import MEAN_RADIUS

    a, b = F.radians(p["y"]), F.radians(q["y"])
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(q["x"] - p["x"]) / 2), 2)
    return 2 * MEAN_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
