"""Damage of the id store that only its manifest and summary show."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from terrafold.llm import idstore

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def store(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ids") / "store")
    idstore.write(docs, path, P.path("byte_bpe_50k.json"), shard_docs=7)
    return path


def test_shards_are_bounded(spark, store, docs):
    manifest = spark.read.parquet(f"{store}/manifest").sort("shard").collect()
    assert len(manifest) > 8 and max(r.n_docs for r in manifest) == 7 and sum(r.n_docs for r in manifest) == docs.count()
    assert [r.start for r in manifest] == [sum(x.n_tokens for x in manifest[:k]) for k in range(len(manifest))]
    found = sorted(idstore.digest(spark, store).collect(), key=lambda r: r.start)
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:k]) for k in range(len(found))]
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0))


DAMAGES = {
    "a recipe lost": {"recipes": lambda d: d.filter("NOT doc_id <=> 5")},
    "a recipe twice": {"recipes": lambda d: d.unionByName(d.filter("doc_id = 5"))},
    "a start moved": {"recipes": lambda d: d.withColumn("local_start", F.col("local_start") + F.when(F.col("doc_id") == 5, 1).otherwise(0))},
    "shard roots": {"manifest": lambda d: d.withColumn("root", F.sha2("root", 256).cast("binary"))},
    "shard counts": {"manifest": lambda d: d.withColumn("n_docs", F.col("n_docs") + 1)},
    "shard tokens": {"manifest": lambda d: d.withColumn("n_tokens", F.col("n_tokens") + 1)},
    "shard starts": {"manifest": lambda d: d.withColumn("start", F.col("start") + 1)},
    "a shard lost": {"manifest": lambda d: d.filter("start > 0")},
    "a shard lost from both": {t: (lambda d: d.filter(F.col("shard") < (1 << 32))) for t in ("manifest", "recipes")},
}


@pytest.mark.parametrize("name", DAMAGES)
def test_damage_shows(spark, store, tmp_path, name):
    hurt = str(tmp_path / "hurt")
    shutil.copytree(store, hurt)
    for table, damage in DAMAGES[name].items():
        shutil.rmtree(os.path.join(hurt, table))
        damage(spark.read.parquet(os.path.join(store, table))).write.parquet(os.path.join(hurt, table))
    with pytest.raises(Exception, match="does not verify"):
        idstore.digest(spark, hurt).count()
