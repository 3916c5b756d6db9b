"""The queries op1 to op13 and the corpus pipeline, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, idstore, infill, linedup, packing, phrases, quality, resample, rollups, secrets, simhash, toxicity
from .common import Scratch, tables


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.rate(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of near duplicates of every document."""
    return simhash.near_duplicates(tables(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids; a row per piece."""
    return packing.pack(tables(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version, kept by batches: load, the same load again, a second version, a
    revision of all its counts (the end id is counted from then on), the first version deleted and inserted again."""
    scratch = Scratch(spark)
    docs = tables(spark, sf_dir, "documents")
    counted = scratch.write(rollups.count_tokens(docs, _vocabulary("byte_bpe_50k.json"), "byte_bpe_50k.1"), "counted")
    none = F.lit(None).cast("long")
    load = counted.select(F.lit("insert").alias("action"), "*", none.alias("old_tokens"))
    second = counted.withColumn("tokenizer", F.lit("byte_bpe_50k.2"))
    rollup = rollups.Rollup(spark, scratch.path("rollup"))
    rollup.commit("load", load)
    rollup.commit("load", load)
    rollup.commit("load-2", second.select(F.lit("insert").alias("action"), "*", none.alias("old_tokens")))
    rollup.commit("revise-2", second.select(F.lit("revise").alias("action"), "doc_id", "source", "lang", "tokenizer", (F.col("n_tokens") + 1).alias("n_tokens"), F.col("n_tokens").alias("old_tokens")))
    rollup.commit("retire-1", load.withColumn("action", F.lit("delete")))
    rollup.commit("restore-1", load)
    return rollup.totals()


def op5_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to a content-addressed store and verified from its files."""
    path = Scratch(spark).path("store")
    idstore.write(tables(spark, sf_dir, "documents"), path, _vocabulary("byte_bpe_50k.json"))
    return idstore.digest(spark, path)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a ten-word window of a benchmark item."""
    return decontam.decontaminate(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark")).drop("hit_starts", "hit_ends")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and cross-document line frequency of every document."""
    return quality.rate(tables(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every whole text; a row per document."""
    return secrets.scan(tables(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate on their source."""
    docs = tables(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linedup.clean(docs, n_lines="n_lines", n_dropped="n_dropped")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that start anywhere else."""
    return phrases.remove_repeats(tables(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as it is or cut into prefix, middle and suffix, with what is rebuilt from the output."""
    return infill.digests(infill.fill_in_middle(tables(spark, sf_dir, "documents")))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is full of control strings, formatted and read back."""
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = tables(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.digests(chat.format_chats(turns))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight toward the benchmark's distribution, and the rank of a quarter of the longer ones."""
    return resample.resample(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


ALL = (op1_toxicity, op2_simhash_near_dedup, op3_best_fit_packing, op4_token_counts, op5_id_store, op6_benchmark_decontamination, op7_quality_rules, op8_secret_scan, op9_line_dedup, op10_substring_dedup, op11_fill_in_middle, op12_chat_format, op13_importance_resampling)
QUERIES = {f.__name__: f for f in ALL}
ORACLES = {"op6_benchmark_decontamination": decontam.ORACLE_SQL, "op7_quality_rules": quality.ORACLE_SQL, "op9_line_dedup": linedup.ORACLE_SQL, "op10_substring_dedup": phrases.ORACLE_SQL, "op11_fill_in_middle": infill.ORACLE_SQL, "op12_chat_format": chat.ORACLE_SQL}
