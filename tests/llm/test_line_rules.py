"""The line rules of op7 and op9 at their production parameters."""

import os

import pytest

from terrafold.llm import linedup, quality, queries

from .conftest import DOCS

SF = "/root/testdata/sf0.01"


def body(i: int, n: int = 60) -> str:
    return " ".join(f"w{i}x{k}" for k in range(n))


def page(i: int, text: str, host: str = "big") -> tuple:
    return (i, text, "en", host, len(text))


@pytest.fixture(scope="module")
def big(spark):
    """A host of 600 pages: boilerplate in 60 texts (one page is header, line, footer), and 40 copies of one text."""
    rows = [page(i, f"Home page\n{body(i)}\nAll rights") for i in range(59)] + [page(59, "Home page\nown line\nAll rights")]
    rows += [page(i, f"copy one\n{body(-1)}") for i in range(60, 100)] + [page(i, body(i)) for i in range(100, 600)]
    return spark.createDataFrame(rows, DOCS)


def test_quality_finds_boilerplate(big):
    found = {r.doc_id: r for r in quality.rate(big).collect()}
    assert all(found[i].n_removed_words == (4 if i < 60 else 0) for i in found)
    assert all(found[i].kept for i in range(60, 600))


def test_every_page_loses_boilerplate(big):
    found = {r.doc_id: r for r in linedup.clean(big, n_lines="n_lines", n_dropped="n_dropped").collect()}
    assert found[59].text == "own line" and found[0].text == body(0)
    assert all(r.n_dropped == (2 if i < 60 else 0) for i, r in found.items())


def test_small_hosts_lose_boilerplate(spark):
    """A host of 10 pages: a line of three texts goes, one of two texts or of three copies stays."""
    rows = [page(i, f"menu\n{'pair' if i < 2 else 'x'}\n{body(i)}", "small") for i in range(3)]
    rows += [page(i, f"copy\n{body(-1)}", "small") for i in range(3, 6)] + [page(i, body(i), "small") for i in range(6, 10)]
    docs = spark.createDataFrame(rows, DOCS)
    removed = {r.doc_id: r.n_removed_words for r in quality.rate(docs).collect()}
    dropped = {r.doc_id: r.n_dropped for r in linedup.clean(docs, n_dropped="n_dropped").collect()}
    assert removed == dropped == {i: int(i < 3) for i in range(10)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_line_dedup_equals_sql_where_lines_go(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(queries.ORACLES["op9_line_dedup"])
    found = queries.QUERIES["op9_line_dedup"](spark, SF).select(*want.columns).collect()
    assert sum(r.n_dropped for r in found) > 100
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want.fetchall()))
