"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terrafold import operators as O
from terrafold.functions import call, native, register_all
from terrafold.geom import model
from terrafold.plans import queries as Q
from terrafold.sql import spatial_sql

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def ring(n: int) -> bytes:
    """A round polygon of n corners in the middle of the points' square."""
    t = 2 * np.pi * np.arange(n + 1) / n
    c = np.stack([500 + 400 * np.cos(t), 500 + 400 * np.sin(t)], 1)
    c[-1] = c[0]
    return model.write_wkb(model.Geometry(model.POLYGON, [c]))


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    register_all(spark)
    big = ring(5000)
    # A file a core, as a table on a cluster has many: the tables given are one file each, which a single task would read.
    tables = tempfile.mkdtemp(prefix="terrafold-bench-")
    for name in ("part", "orders"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(int(CPUS)).write.parquet(f"{tables}/{name}.parquet")

    def points():
        return Q.dots(spark, tables)

    def join_bench(n: int):
        b = spark.range(n).select(F.col("id").alias("b"), native.st_make_envelope((F.col("id") * 53) % 1000, (F.col("id") * 97) % 1000, (F.col("id") * 53) % 1000 + 5, (F.col("id") * 97) % 1000 + 5).alias("box"))
        p = spark.range(n).select(F.col("id").alias("p"), native.st_point((F.col("id") * 37) % 1000, (F.col("id") * 91) % 1000).alias("pt"))
        return O.spatial_join(b, p, "ST_Intersects", "box", "pt")

    runs = {
        "within_5000": lambda: points().filter(call("ST_Within", F.col("pt"), big)),
        "contains_5000": lambda: points().filter(call("ST_Contains", big, F.col("pt"))),
        "intersects_16": lambda: points().filter(call("ST_Intersects", F.col("pt"), ring(16))),
        "touches_constant": lambda: points().filter(call("ST_Touches", F.col("pt"), big)),
        "extent": lambda: points().agg(O.st_extent(box=native.point_box(F.col("pt")))),
        "st_x": lambda: spatial_sql(spark, "SELECT sum(ST_X(pt)) FROM bench_points"),
        "sql_within_5000": lambda: spatial_sql(spark, "SELECT * FROM bench_points WHERE ST_Within(pt, :area)", area=model.write_wkt(model.read_wkb(big))),
        "sql_join": lambda: Q.sql_join(spark, tables),
        "join_2000": lambda: join_bench(2000),
        "join_20000": lambda: join_bench(20000),
        "join_boxes_points": lambda: Q.join_contains(spark, tables),
        "relate_pairs": lambda: Q.QUERIES["st_relate"](spark, tables),
        "overlay_pairs": lambda: Q.QUERIES["st_intersection"](spark, tables),
        "area_column": lambda: Q.parts(spark, tables).selectExpr(f"ST_Area({Q.FRAME}) AS r"),
    }
    points().createOrReplaceTempView("bench_points")
    points().count()
    took = {}
    for name, run in runs.items():
        best = None
        for _ in range(2):
            t = time.time()
            run().write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - t)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
