"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame. All but the last keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, linedup, packing, simhash
from . import toxicity as machine
from .queries import _vocabulary
from .common import col, tables


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return machine.keep_clean(docs, tables(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text. Documents stay, if need be with an empty text."""
    out = linedup.clean(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, similarity 0.8) one row stays: that with the smallest id, null ids last.

    Null and empty texts are copies of each other; rows that share an id but not a text are documents of their own.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; rows without an id are judged by their text alike."""
    return decontam.keep_clean(docs, tables(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 4096 ids."""
    return packing.pack(docs, _vocabulary("word_bpe_49k.json"))
