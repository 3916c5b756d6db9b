"""Registration of all functions for Spark SQL, and their Column form.

``register_all(spark)`` makes every ST_ name callable in SQL; calling it again replaces them. Points and boxes are
native SQL functions, inlined by Catalyst; the other scalars are Arrow UDFs; ST_Extent, ST_Collect and ST_MemUnion
are grouped-aggregate Arrow UDFs (plain Spark refuses them beside built-in aggregates in one SELECT; ``spatial_sql`` and
operators.aggregates have forms that can). ST_ClusterKMeans(g, k) and ST_ClusterDBSCAN(g, eps, min_points) are window
functions of ``spatial_sql`` only: by itself Spark would call them once a row.

``call(name, *args)`` is the Column form. A Python string or bytes given for a geometry is a constant: it travels
with the function and not with every row. Arguments that the function fixes must be Python values there.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..geom import model
from . import arrow
from . import scalar as S

POINT = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, m: DOUBLE, srid: INT>"
BOX = "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE, srid: INT>"
_POINT_SQL = f"(x DOUBLE, y DOUBLE, z DOUBLE DEFAULT NULL) RETURNS {POINT} RETURN CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE named_struct('x', x, 'y', y, 'z', z, 'm', CAST(NULL AS DOUBLE), 'srid', 0) END"
_BOX_SQL = f"(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS {BOX} RETURN CASE WHEN x1 IS NULL OR y1 IS NULL OR x2 IS NULL OR y2 IS NULL THEN NULL ELSE named_struct('xmin', x1, 'ymin', y1, 'xmax', x2, 'ymax', y2, 'srid', 0) END"
NATIVE = {"ST_Point": _POINT_SQL, "ST_MakePoint": _POINT_SQL, "ST_PointZ": _POINT_SQL, "ST_MakeEnvelope": _BOX_SQL, "ST_MakeBox2D": _BOX_SQL}


@lru_cache(None)
def scalar_udf(name: str):
    f = S.SCALARS[name]

    def batch(*args: pa.Array) -> pa.Array:
        return arrow.run(f, args)

    batch.__name__ = name.lower()
    return F.arrow_udf(batch, arrow.SPARK[f.result])


def _extent(a: pa.Array):
    boxes = [(g.box(), g.srid) for g in arrow.geometries(a, "ST_Extent") if g is not None and g.box()]
    if not boxes:
        return None
    b, srid = [x for x, _ in boxes], boxes[0][1]
    return {"xmin": min(x[0] for x in b), "ymin": min(x[1] for x in b), "xmax": max(x[2] for x in b), "ymax": max(x[3] for x in b), "srid": srid}


def _gathered(a: pa.Array, name: str, how) -> bytes | None:
    found = how([g for g in arrow.geometries(a, name) if g is not None])
    return None if found is None else model.write_wkb(found)


def _window_only(g: pa.Array, *_: pa.Array) -> int:
    raise ValueError("cluster functions run as OVER (...) windows of spatial_sql")


def aggregate_udfs() -> dict[str, Any]:
    from pyspark.sql.pandas.functions import ArrowUDFType

    grouped = ArrowUDFType.GROUPED_AGG
    return {
        "ST_Extent": F.arrow_udf(lambda a: _extent(a), arrow.SPARK["x"], grouped),
        "ST_Collect": F.arrow_udf(lambda a: _gathered(a, "ST_Collect", S.collect), "binary", grouped),
        "ST_MemUnion": F.arrow_udf(lambda a: _gathered(a, "ST_MemUnion", S.union), "binary", grouped),
        "ST_ClusterKMeans": F.arrow_udf(lambda g, k: _window_only(g, k), "int", grouped),
        "ST_ClusterDBSCAN": F.arrow_udf(lambda g, eps, least: _window_only(g, eps, least), "int", grouped),
    }


def register_all(spark: SparkSession) -> list[str]:
    """Registers every function for SQL and returns their names."""
    for name in S.SCALARS:
        spark.udf.register(name, scalar_udf(name))
    for name, body in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    grouped = aggregate_udfs()
    for name, f in grouped.items():
        spark.udf.register(name, f)
    return sorted([*S.SCALARS, *NATIVE, *grouped])


def call(name: str, *args: Column | str | bytes | float | int | None) -> Column:
    """A scalar function over columns and constants. Column names are given as F.col(...); plain strings are constants."""
    f = S.SCALARS[name]
    constant: dict[int, Any] = {}
    columns: list[Column] = []
    for k, a in enumerate(args):
        if isinstance(a, Column):
            if k in f.fixed:
                raise TypeError(f"{name}: argument {k + 1} must be a constant")
            columns.append(a)
        else:
            constant[k] = bytes(a) if isinstance(a, bytearray) else a
    if not columns:
        return scalar_udf(name)(*[F.lit(constant[k]) for k in range(len(args))])
    if not constant:
        return scalar_udf(name)(*columns)
    n = len(args)

    def batch(*given: pa.Array) -> pa.Array:
        rest = iter(given)
        return arrow.run_with(f, [constant[k] if k in constant else next(rest) for k in range(n)], set(constant))

    batch.__name__ = name.lower()
    return F.arrow_udf(batch, arrow.SPARK[f.result])(*columns)
