"""Token-count rollups: signed changes, repeated and competing batches, compaction."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrafold.llm import queries, rollups
from terrafold.llm.common import Scratch

from .test_operators import P, ids


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


@pytest.fixture(scope="module")
def counted(spark, docs):
    return Scratch(spark).write(rollups.count_tokens(docs, P.path("byte_bpe_50k.json"), "v1"), "counted")


@pytest.fixture(scope="module")
def full(rows):
    want = Counter()
    for _, t, lang, source, _ in rows:
        want[source, lang, "v1", "docs"] += 1
        want[source, lang, "v1", "tokens"] += len(ids("byte_bpe_50k.json", t))
    return {k[:3]: (want[(*k[:3], "docs")], want[(*k[:3], "tokens")]) for k in want}


def insert(counted):
    return counted.select(F.lit("insert").alias("action"), "*", F.lit(None).cast("long").alias("old_tokens"))


def test_rollups(spark, counted, full):
    r = rollups.Rollup(spark, Scratch(spark).path("rollup"))
    assert totals(r) == {}
    load = insert(counted)
    assert r.commit("a", load) and not r.commit("a", load)
    assert totals(r) == full
    double = {k: (n, 2 * t) for k, (n, t) in full.items()}
    revise = counted.select(F.lit("revise").alias("action"), "doc_id", "source", "lang", "tokenizer", (F.col("n_tokens") * 2).alias("n_tokens"), F.col("n_tokens").alias("old_tokens"))
    r.commit("b", revise)
    assert totals(r) == double
    r.compact()
    assert totals(r) == double and not r.commit("b", revise)
    r.compact()
    assert totals(r) == double
    r.commit("c", counted.select(F.lit("delete").alias("action"), "doc_id", "source", "lang", "tokenizer", (F.col("n_tokens") * 2).alias("n_tokens"), F.lit(None).cast("long").alias("old_tokens")))
    assert totals(r) == {}
    assert r.commit("d", load.limit(0)) and totals(r) == {}
    with pytest.raises(Exception, match="unknown action"):
        r.commit("e", load.withColumn("action", F.lit("upsert")))
    assert r.committed() == ["a", "b", "c", "d"]


def test_a_batch_that_lands_during_compaction(spark, counted, full):
    r = rollups.Rollup(spark, Scratch(spark).path("rollup"))
    r.commit("a", insert(counted))
    plain, done = r._sum, []

    def late(*state):
        if not done:
            done.append(rollups.Rollup(spark, r.root).commit("b", insert(counted)))
        return plain(*state)

    r._sum = late  # lands between the list and the sum
    r.compact()
    assert done == [True]
    double = {k: (2 * n, 2 * t) for k, (n, t) in full.items()}
    assert totals(rollups.Rollup(spark, r.root)) == double
    rollups.Rollup(spark, r.root).compact()
    assert totals(rollups.Rollup(spark, r.root)) == double and r.committed() == ["a", "b"]


def test_two_writers(spark, counted, full):
    one, two = (rollups.Rollup(spark, Scratch(spark).path("rollup")) for _ in range(2))
    two.root = one.root
    plain = two._write

    def slow(df, what=""):
        name = plain(df, what)
        assert one.commit("a", insert(counted))  # after the second writer looked, before it marks
        return name

    two._write = slow
    assert not two.commit("a", insert(counted).withColumn("n_tokens", F.lit(7)))
    assert totals(one) == full
    # two compactions of one state
    two._write = plain
    state = two._state()
    one.compact()
    two._state = lambda: state
    with pytest.raises(RuntimeError, match="came first"):
        two.compact()
    assert totals(one) == full


def test_writer_that_dies(spark, counted, full, monkeypatch):
    """Wherever a writer dies, the batch can be sent again, and counts once."""
    root = Scratch(spark).path("rollup")

    class Killed(BaseException):
        pass

    def die(*_):
        raise Killed

    for step in ("_rename", "_mark"):  # its table and draft are written; its table is
        with monkeypatch.context() as m, pytest.raises(Killed):
            m.setattr(rollups.Rollup, step, die)
            rollups.Rollup(spark, root).commit("a", insert(counted))
        assert rollups.Rollup(spark, root).committed() == [] and totals(rollups.Rollup(spark, root)) == {}
    r = rollups.Rollup(spark, root)
    assert r.commit("a", insert(counted)) and not r.commit("a", insert(counted)) and totals(r) == full


def test_second_marker_is_refused(spark, counted, full):
    r = rollups.Rollup(spark, Scratch(spark).path("rollup"))
    assert r.commit("a", insert(counted))
    assert not r._mark("commits", "a", "data/elsewhere")  # a writer that looked before the other's marker was there
    assert totals(r) == full and not list(r._fs.listStatus(r._path(f"{r.root}/drafts")))


def test_query_and_clashing_names(spark, empty, odd, docs, rows, tmp_path):
    for n, d in (("docs", docs), ("empty", empty), ("odd", odd)):
        d.write.parquet(str(tmp_path / n / "documents.parquet"))
    found = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in queries.op4_token_counts(spark, str(tmp_path / "docs")).collect()}
    want = Counter()
    for _, t, lang, source, _ in rows:
        for k in (1, 2):
            want[source, lang, f"byte_bpe_50k.{k}", 0] += 1
            want[source, lang, f"byte_bpe_50k.{k}", 1] += len(ids("byte_bpe_50k.json", t)) + k - 1
    assert found == {k[:3]: (want[(*k[:3], 0)], want[(*k[:3], 1)]) for k in want}
    assert queries.op4_token_counts(spark, str(tmp_path / "empty")).count() == 0
    assert queries.op4_token_counts(spark, str(tmp_path / "odd")).count() == 2
