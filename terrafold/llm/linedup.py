"""Line dedup by site-relative frequency (DataFrame functions only).

A line is boilerplate on a host if it stands on at least ``min_pages`` of its pages and on more than
``max_ratio`` of them. Every page loses its boilerplate lines, whatever share of its lines that is; every other line stays, in
order. ``clean`` is the rule in production: pages with the same text count as one (``by_text``), so copies alone make no line
boilerplate. ``MIN_PAGES`` only says what makes a line repeated: on a host of up to 300 pages three different texts are above
the ratio in any case.

Plan: each page gives one row per different line, as a 64-bit hash, to a map-side combined count per
(host, hash), so a line on a third of all pages costs a row per task; with ``by_text``, copies are merged per
(host, hash, text) before that. At most
(lines per page) / max_ratio lines of a host can pass, so the hashes to drop are kept as one short array a
host, joined to the pages by host: broadcast below a checked size, else a join that Spark splits where a
host is large. Page texts are never exploded and, in the broadcast case, never shuffled.

Defined results: a null text stays null and has no lines; an empty text has one empty line; blank lines are
never dropped; a null host is a host of its own; repeated rows are pages of their own; other columns pass
through unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, col, free_name

#: Production parameters.
MAX_RATIO = 0.01
#: What makes a line repeated at all; the ratio decides on every host of 300 pages or more.
MIN_PAGES = 3


def _norm(line):
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, by_text: bool = False) -> DataFrame:
    """(host, line_hash, n_pages, total) of the lines that exceed the ratio on their host."""
    hashes = F.array_distinct(F.transform(F.filter(F.transform(F.split(col(text), "\n", -1), _norm), lambda x: x != ""), lambda x: F.xxhash64(x)))
    slim = pages.select(col(host).alias("host"), F.xxhash64(col(text)).alias("own"), hashes.alias("hashes"))
    lines = slim.select("host", "own", F.explode("hashes").alias("line_hash"))
    counts = (lines.distinct() if by_text else lines).groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    totals = pages.groupBy(col(host).alias("host")).agg(F.count(F.lit(1)).alias("total"))
    c, t = counts.alias("c"), totals.alias("t")
    return c.join(t, F.col("c.host").eqNullSafe(F.col("t.host"))).filter(F.col("n_pages") > F.lit(max_ratio) * F.col("total")).select("c.host", "line_hash", "n_pages", "total")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, by_text: bool = False, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``; names given for n_lines and n_dropped add those counts."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    found = boilerplate_lines(pages, host, text, max_ratio, min_pages, by_text).groupBy("host").agg(F.collect_set("line_hash").alias("drop"))
    found = scratch.write(found, "drop")
    size = found.agg(F.sum(F.size("drop") * 8 + 64)).first()[0] or 0
    drop, key = free_name(pages, "tf_drop"), free_name(pages, "tf_host")
    right = found.select(F.col("host").alias(key), F.col("drop").alias(drop))
    if size <= BROADCAST_BYTES:
        right = F.broadcast(right)
    joined = pages.join(right, col(host).eqNullSafe(col(key)), "left")
    lines = F.split(col(text), "\n", -1)
    # The kept lines; null: the text stays as it is.
    a, b = (free_name(pages, f"tf_{x}") for x in ("lines", "kept"))
    kept = F.filter(col(a), lambda x: ~F.array_contains(col(drop), F.xxhash64(_norm(x))) | (_norm(x) == ""))
    joined = joined.withColumn(a, lines).withColumn(b, F.when(col(drop).isNotNull(), kept))
    out = [F.when(col(b).isNull(), col(text)).otherwise(F.array_join(b, "\n")).alias(c) if c == text else col(c) for c in pages.columns]
    if n_lines:
        out.append(F.coalesce(F.when(col(text).isNotNull(), F.size(a)), F.lit(0)).cast("long").alias(n_lines))
    if n_dropped:
        out.append(F.when(col(b).isNull(), 0).otherwise(F.size(a) - F.size(b)).cast("long").alias(n_dropped))
    return joined.select(*out)


def clean(pages: DataFrame, **names: str) -> DataFrame:
    """``drop_boilerplate`` as op9 and the pipeline use it."""
    return drop_boilerplate(pages, by_text=True, **names)


ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, source, own, pos, line, trim(line, concat(' ', chr(9), chr(13))) AS norm FROM (
  SELECT doc_id, source, md5(text) AS own, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
c AS (SELECT source, norm, count(DISTINCT own) AS n FROM l WHERE norm <> '' GROUP BY source, norm),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT c.source, c.norm FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * total),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(b.norm) AS n_dropped, string_agg(CASE WHEN b.norm IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS kept
  FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.norm = b.norm GROUP BY l.doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
  coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
