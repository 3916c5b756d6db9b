"""Token-count rollups kept by deltas.

Changes are rows (action, doc_id, source, lang, tokenizer, n_tokens, old_tokens): an ``insert`` adds a document
and its tokens, a ``delete`` takes both away, a ``revise`` adds the difference between the new and the old
count. A batch of changes becomes one small table of signed sums by (source, lang, tokenizer) in a folder of its own.
It counts from the moment that a marker file of the batch's name, which says where the table is, has appeared. A marker is written
whole under another name and then renamed, and the rename is refused if the name is taken (in one step on HDFS; a store
without such renames needs one writer). So of several writers of one batch one wins, a batch that is sent again changes nothing, and a
writer that dies at any point leaves either a whole marker or none: the batch can be sent again. What no marker names is never read. Totals are the sum of all marked deltas; ``compact`` takes the list of them once, folds exactly
these into one table, and publishes it with the list by a marker in the same way. A batch that lands meanwhile stays a delta.

The sums are combined on the map side, so a hot source sends one row per task. Nothing is collected.

Defined results: null source, lang or tokenizer are groups of their own; null counts are 0; an unknown action
raises; totals leave out groups with no documents and no tokens; an empty batch commits as an empty delta.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import col, delete_path

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer: str, name: str, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of every whole text; null and empty texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            sizes = pa.array([len(enc.encode(x.as_py())) // 4 for x in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sizes], names=["doc_id", "source", "lang", "n_tokens"])

    slim = docs.select(col("doc_id").cast("long").alias("doc_id"), col("source").cast("string").alias("source"), col("lang").cast("string").alias("lang"), col(text).alias("text"))
    return slim.mapInArrow(count, "doc_id long, source string, lang string, n_tokens long").select("doc_id", "source", "lang", F.lit(name).alias("tokenizer"), "n_tokens")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by group."""
    bad = F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce(F.col("action"), F.lit("null"))))
    sign = F.when(F.col("action") == "insert", 1).when(F.col("action") == "delete", -1).when(F.col("action") == "revise", 0).otherwise(bad.cast("int"))
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    moved = F.when(F.col("action") == "insert", new).when(F.col("action") == "delete", -new).otherwise(new - old)
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(moved).cast("long").alias("n_tokens"))


class Rollup:
    """Rollups below ``root``: data/<id> tables, commits/<batch> and bases/<number> markers that name them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _mark(self, kind: str, name: str, what: str) -> bool:
        """Publishes a marker; False if one of that name came first."""
        draft, where = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/{kind}/{name}")
        out = self._fs.create(draft, False)
        out.writeUTF(what)
        out.close()
        self._fs.mkdirs(where.getParent())
        try:
            self._rename(draft, where)
        except Py4JJavaError:
            self._fs.delete(draft, False)
            if self._fs.exists(where):
                return False
            raise
        return True

    def _rename(self, draft, where) -> None:
        """Fails if ``where`` exists."""
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        plain = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        hadoop.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(draft, where, plain)

    def _marked(self, kind: str) -> dict[str, str]:
        """Name -> what it names, of all markers of a kind."""
        where, found = self._path(f"{self.root}/{kind}"), {}
        for s in self._fs.listStatus(where) if self._fs.exists(where) else []:
            own = self._fs.open(s.getPath())
            found[s.getPath().getName()] = own.readUTF()
            own.close()
        return found

    def _write(self, df: DataFrame, what: str = "") -> str:
        """Writes a table that no marker names yet."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}{what}")
        return name

    def _state(self) -> tuple[str | None, str | None, dict[str, str]]:
        """The last base's number and folder, and the deltas that it doesn't hold. Markers are read before the base's list."""
        commits, bases = self._marked("commits"), self._marked("bases")
        last = max(bases, default=None)
        if last is None:
            return None, None, commits
        folded = {r.batch for r in self.spark.read.parquet(f"{self.root}/{bases[last]}/batches").collect()}  # a row per batch
        return last, bases[last], {b: at for b, at in commits.items() if b not in folded}

    def committed(self) -> list[str]:
        """Ids of all batches that count."""
        return sorted(self._marked("commits"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """True if the batch was new; one that was committed before changes nothing."""
        if batch in self._marked("commits"):
            return False
        name = self._write(deltas(changes))
        if self._mark("commits", batch, name):
            return True
        delete_path(self.spark, f"{self.root}/{name}")
        return False

    def _sum(self, base: str | None, more: dict[str, str]) -> DataFrame:
        paths = ([f"{self.root}/{base}/totals"] if base else []) + [f"{self.root}/{more[b]}" for b in sorted(more)]
        found = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        summed = found.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        return self._sum(*self._state()[1:])

    def compact(self) -> None:
        """Folds all deltas into a new base. Deltas go at the next compaction only, so that readers of the old state finish."""
        number, base, more = self._state()
        name = self._write(self._sum(base, more), "/totals")
        old = [r.batch for r in self.spark.read.parquet(f"{self.root}/{base}/batches").collect()] if base else []
        self.spark.createDataFrame([(b,) for b in sorted([*old, *more])], "batch string").write.parquet(f"{self.root}/{name}/batches")
        if not self._mark("bases", f"{int(number or 0) + 1:012d}", name):
            delete_path(self.spark, f"{self.root}/{name}")
            raise RuntimeError("another compaction came first")
        commits = self._marked("commits")
        for b in old:
            delete_path(self.spark, f"{self.root}/{commits[b]}")
