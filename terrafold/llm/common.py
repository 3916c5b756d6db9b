"""What the corpus operators share: scratch tables in the shared folder, free column names, size checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table up to this many bytes may be broadcast; every caller has another way beyond it.
BROADCAST_BYTES = 16 << 20


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="terrafold-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


class Scratch:
    """Tables that cut a plan's lineage, written to the shared folder so that a lost executor loses none of them.

    ``write`` stores a DataFrame and returns it read back; ``drop`` deletes tables that no later plan reads.
    What a returned DataFrame still reads stays until the session's Python process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/terrafold-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(compression="zstd", **options).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete_path(self.spark, self.root)
        except Exception:  # the JVM may be gone by now
            pass


def small_side(left: DataFrame, right: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Null-safe semi or anti join with keys of a written table: broadcast if they are few (their size is measured), else shuffled."""
    on = [on] if isinstance(on, str) else on
    a, b = left.alias("a"), right.alias("b")
    if right.count() * 32 * len(on) <= BROADCAST_BYTES:
        b = F.broadcast(b)
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"a.{ident(c)}").eqNullSafe(F.col(f"b.{ident(c)}"))
    return a.join(b, same, how).select(*[F.col(f"a.{ident(c)}") for c in left.columns])


def free_name(df: DataFrame, base: str, *more: DataFrame) -> str:
    """A column name that no given DataFrame has (Spark compares without case)."""
    taken = {c.lower() for d in (df, *more) for c in d.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(ident(name))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
