"""Tables between the steps of an operator, in the folder that driver and executors share, and work on them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Written tables cut a plan's lineage: a lost executor loses none of them. They are deleted by ``drop``, the rest when Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="terrafold-tables-")
        self.root = f"{root.rstrip('/')}/terrafold-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for n in names or [""]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop()
        except Exception:  # the JVM may be gone by now
            pass


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of lists of columns."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out &= a.eqNullSafe(b)
    return out


def numbered(df: DataFrame, order: list[str], tables: Tables, out: str, name: str = "numbered") -> DataFrame:
    """Rows with their number from 0 in the order of these columns: a sort by ranges, numbers within its parts, and the sizes of the parts before."""
    rows = tables.write(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(map(tuple, rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()))  # a row a part of the sort
    before = list(accumulate((n for _, n in sizes), initial=0))
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before[:-1], strict=True)], "part long, before long")
    return rows.join(F.broadcast(starts), part == F.col("part")).withColumn(out, F.col("before") + place).drop("at", "part", "before")


def components(edges: DataFrame, tables: Tables, rounds: int = 60) -> DataFrame:
    """(u, v) edges of longs -> (u, root): every node but the smallest of its component, with that node.

    Every round links what a node sees to the smallest of it, first the larger ones, then the smaller ones; it is settled when each component is a star.
    """
    now = tables.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links0")
    seen = None
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tables.write(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = tables.write(small.distinct(), f"links{k}")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        tables.drop(f"links{k - 1}", f"large{k}")
        if mark == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
