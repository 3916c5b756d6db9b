"""The pipeline and the registered queries on the smallest tables."""

import os

import pytest

import corpus_pipeline
from terrafold.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_keep_columns_and_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names, name
        assert 0.5 * n < docs.count() <= n, name
        n = docs.count()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == n


def test_entry_registers_every_operator(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())


def test_line_dedup_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(queries.ORACLES["op9_line_dedup"])
    found = queries.QUERIES["op9_line_dedup"](spark, SF).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want.fetchall()))
