"""Spatial aggregates as Column expressions that stand beside any built-in aggregate."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import scalar as S
from ..functions.registry import scalar_udf
from ..geom import model
from .join import free_names, quoted
from .tables import same


def st_extent(geom: Column | None = None, box: Column | None = None) -> Column:
    """Box around a group. With a box struct column it is four native min and max, combined before the shuffle; a geometry
    column is first reduced to its box row by row. Null if there is no position."""
    b = box if box is not None else scalar_udf("ST_Envelope")(geom)
    found = F.struct(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"), F.max(b["srid"]).alias("srid"))
    return F.when(F.min(b["xmin"]).isNotNull(), found)


def _finish(how) -> object:
    def batch(lists: pa.Array) -> pa.Array:
        out = []
        for row in lists:
            gs = [g for g in arrow.geometries(row.values, "an aggregate") if g is not None] if row.is_valid and len(row.values) else []
            g = how(gs)
            out.append(None if g is None else model.write_wkb(g))
        return pa.array(out, pa.binary())

    return F.arrow_udf(batch, "binary")


def st_collect(geom: Column) -> Column:
    """Collection of a group's geometries, nulls left out (one alone is itself; none: null)."""
    return _finish(S.collect)(F.collect_list(geom))


def st_mem_union(geom: Column) -> Column:
    """Union of a group's areal geometries as a multipolygon; others are left out."""
    return _finish(S.union)(F.collect_list(geom))


def spread_bits(v: Column) -> Column:
    """The lower 16 bits of a number with a zero between each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = F.shiftleft(v, shift).bitwiseOR(v).bitwiseAND(F.lit(mask).cast("long"))
    return v


def union_by(df: DataFrame, keys: list[str], geom: str, out: str = "geom", fan: int = 64) -> DataFrame:
    """``st_mem_union`` per key for groups of any size: neighbours are united first, then what is left of ever larger squares.

    Rows lie along a space-filling curve over the table's extent. The first level unites about ``fan`` rows of a square (a square
    with more, in parts); each level above unites four squares of the one below. Inner borders go at the first level at
    which both sides are in one square, so what is shuffled falls from level to level, and the last tasks get outlines.
    """
    box, z, part, union = free_names(["box", "z", "part", "union"], df)
    b = F.col(box)
    rows = df.select(*[F.col(quoted(k)) for k in keys], F.col(quoted(geom)).alias(union)).withColumn(box, scalar_udf("ST_Envelope")(F.col(union)))
    x1, y1, x2, y2, n = rows.agg(F.min(b["xmin"]), F.min(b["ymin"]), F.max(b["xmax"]), F.max(b["ymax"]), F.count(b)).first()
    groups = [F.col(quoted(k)) for k in keys]
    if not n:
        return rows.groupBy(*groups).agg(F.lit(None).cast("binary").alias(out))
    depth = next(d for d in range(17) if n <= fan * 4**d or d == 16)
    step = lambda low, high: max(high - low, 1e-300) / 65536
    place = lambda v, low, high: F.least(F.greatest(F.floor((v - F.lit(low)) / F.lit(step(low, high))), F.lit(0)), F.lit(65535))
    code = spread_bits(place((b["xmin"] + b["xmax"]) / 2, x1, x2)).bitwiseOR(F.shiftleft(spread_bits(place((b["ymin"] + b["ymax"]) / 2, y1, y2)), 1))
    rows = rows.withColumn(z, F.shiftright(F.coalesce(code, F.lit(0)), 2 * (16 - depth)))
    crowded = rows.groupBy(*groups, z).agg(F.count(F.lit(1)).alias(part)).filter(F.col(part) > fan).select(*groups, z, F.ceil(F.col(part) / fan).alias(part))
    names = free_names([f"k{i}" for i in range(len(keys) + 1)], rows, crowded)
    many = crowded.toDF(*names, part)
    on = same([*groups, F.col(z)], [F.col(c) for c in names])
    level = rows.join(many, on, "left").select(*groups, union, z, F.pmod(F.xxhash64(union), F.coalesce(part, F.lit(1))).alias(part))
    level = level.groupBy(*groups, z, part).agg(st_mem_union(F.col(union)).alias(union)).drop(part)
    for _ in range(depth):
        level = level.groupBy(*groups, z).agg(st_mem_union(F.col(union)).alias(union)).withColumn(z, F.shiftright(z, 2))
    return level.groupBy(*groups).agg(st_mem_union(F.col(union)).alias(out))
