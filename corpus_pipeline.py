"""The corpus pipeline: four filters over documents, then packing. Each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import stages
from terrafold.llm.common import Scratch

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup),
    ("simhash_near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("packing", stages.pack),
]

#: The stages learn a classifier, take fingerprints and count BPE tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each on what its predecessor kept."""
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
