"""Reading and writing geometry with Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import scalar_udf

_READ = {"wkt": "ST_GeomFromText", "wkb": "ST_GeomFromWKB", "ewkb": "ST_GeomFromEWKB", "geojson": "ST_GeomFromGeoJSON", "geohash": "ST_PointFromGeoHash"}
_WRITE = {"wkt": "ST_AsText", "wkb": "ST_AsBinary", "ewkb": "ST_AsEWKB", "geojson": "ST_AsGeoJSON"}


def decoded(column: Column, encoding: str, srid: int = 0) -> Column:
    """EWKB from a column in one of the encodings wkt, wkb, ewkb, geojson and geohash."""
    g = scalar_udf(_READ[encoding])(column)
    return scalar_udf("ST_SetSRID")(g, F.lit(srid)) if srid else g


def encoded(column: Column, encoding: str) -> Column:
    return scalar_udf(_WRITE[encoding])(column)


def read_geojson_lines(spark: SparkSession, path: str, properties: str, geom: str = "geom") -> DataFrame:
    """GeoJSON features, one a line: the properties (a DDL schema) as columns and the geometry as EWKB."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json(F.get_json_object("value", "$.properties"), properties).alias("p"), decoded(F.get_json_object("value", "$.geometry"), "geojson").alias(geom)).select("p.*", geom)


def write_geojson_lines(df: DataFrame, path: str, geom: str = "geom") -> None:
    """The inverse: one feature a line."""
    rest = F.to_json(F.struct(*[c for c in df.columns if c != geom]))
    head, middle, end = (F.lit(s) for s in ('{"type":"Feature","properties":', ',"geometry":', "}"))
    df.select(F.concat(head, rest, middle, F.coalesce(encoded(F.col(geom), "geojson"), F.lit("null")), end).alias("value")).write.text(path)
