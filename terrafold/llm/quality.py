"""Quality rules with cross-document line frequency.

One pass over whole texts takes the base measures and, per document, the hashes of its normalised lines (lower
case, single spaces) with their words. A line is above the limits of its host if at least ``MIN_DOCS`` different
texts hold it and their number is more than ``MAX_RATIO`` of the host's documents: a text counts once a host, however
often it is copied, so copies alone put no line above the limits. Such lines are removed; a document of whose words less than
``MIN_LEFT`` are left is depleted and rejected.

Copies of a text are merged per (host, line, text) and the counts per (host, line) combined on the map side; the few lines above the limits (at most lines per document / MAX_RATIO of a host) meet the
documents' lines in a join on host and hash that Spark splits where it is skewed.

Defined results: a null text has no words and fails; a null source is a host of its own; repeated rows are one
text and each get a row; blank lines are no lines; other columns play no part; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col

#: What makes a line repeated at all; the ratio decides on every host of 300 documents or more.
MIN_DOCS = 3
#: The ratio above which op9 calls a line boilerplate.
MAX_RATIO = 0.01
MIN_LEFT = 0.5
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes]) -> int:
    """Words in runs of three that stand twice or more in the text, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    base = len(seen)
    code = ids[:n] * base + ids[1 : n + 1]
    if base >= 1 << 20:
        code = np.unique(code, return_inverse=True)[1]
    code = code * base + ids[2:]
    _, place, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice, hit = counts[place] > 1, np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + n] |= twice
    return int(hit.sum())


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """Per document: doc_id, host, the base measures, base_failed, lines (hash, words) and the text's hash (null: no text)."""
    from xxhash import xxh64_intdigest

    line = pa.struct([("h", pa.int64()), ("w", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("lines", pa.list_(line)), ("own", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, site, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = x.as_py() or ""
                raw = text.encode()
                words = raw.split()
                n, again = len(words), repeated_words(words)
                lines, dup, seen = {}, 0, set()
                for own in raw.split(b"\n"):
                    if parts := own.split():
                        dup += own in seen
                        seen.add(own)
                        h = xxh64_intdigest(b" ".join(parts).lower(), 42)
                        lines[h] = lines.get(h, 0) + len(parts)
                signed = lambda h: h - (1 << 64) if h >> 63 else h
                hashed = [{"h": signed(h), "w": w} for h, w in lines.items()]
                rows.append((doc, site, n, len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), dup, again, n < 50 or 100 * again > 50 * n, hashed, signed(xxh64_intdigest(raw, 42)) if x.is_valid else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    slim = docs.select(col(key).cast("long").alias("doc_id"), col(host).cast("string").alias("host"), col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<struct<h:long,w:int>>, own long")


def rate(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", min_docs: int = MIN_DOCS, max_ratio: float = MAX_RATIO, min_left: float = MIN_LEFT) -> DataFrame:
    """Per document: doc_id, the base measures, base_failed, n_removed_words and kept."""
    scratch = Scratch(docs.sparkSession)
    # A row's number is only ever read from the written table, where it is fixed.
    rows = scratch.write(measures(docs, text, key, host).withColumn("row", F.monotonically_increasing_id()), "measures")
    lines = rows.select("row", "host", "own", F.explode("lines").alias("l")).select("row", "host", "own", "l.h", "l.w")
    often = lines.select("host", "h", "own").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).alias("o")
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total")).alias("t")
    above = often.join(totals, F.col("o.host").eqNullSafe(F.col("t.host"))).filter(F.col("n") > F.lit(max_ratio) * F.col("total")).select("o.host", "h")
    above = scratch.write(above, "above").alias("a")
    x = lines.alias("l")
    gone = x.join(above, (F.col("l.h") == F.col("a.h")) & F.col("l.host").eqNullSafe(F.col("a.host"))).groupBy("row").agg(F.sum("w").alias("gone"))
    n_gone = F.coalesce("gone", F.lit(0)).cast("long")
    out = rows.join(gone, "row", "left")
    left = F.col("n_words") - n_gone
    kept = ~F.col("base_failed") & (left >= F.lit(min_left) * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", n_gone.alias("n_removed_words"), kept.alias("kept"))


#: The same rows in DuckDB. Lines and word runs are compared as text, not by hash.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
p AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM e),
g AS (SELECT r, i, n, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS run FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, run) > 1 AND run IS NOT NULL AS twice FROM g),
hit AS (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM again),
repeated AS (SELECT r, count(*) FILTER (hit) AS n_repeat_words FROM hit GROUP BY r),
l AS (SELECT r, source, md5(t) AS own, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS parts FROM (SELECT r, source, t, unnest(ls) AS line FROM e)),
m AS (SELECT r, source, own, line, translate(array_to_string(parts, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, len(parts) AS w FROM l WHERE len(parts) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM m GROUP BY r),
often AS (SELECT source, norm, count(DISTINCT own) AS n FROM m GROUP BY source, norm),
total AS (SELECT source, count(*) AS total FROM d GROUP BY source),
above AS (SELECT o.source, o.norm FROM often o JOIN total t ON o.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_DOCS} AND n > {MAX_RATIO} * total),
gone AS (SELECT m.r, sum(m.w) AS gone FROM m JOIN above a ON m.source IS NOT DISTINCT FROM a.source AND m.norm = a.norm GROUP BY m.r),
f AS (SELECT e.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words
  FROM e LEFT JOIN repeated USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
h AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {MIN_LEFT} * n_words AS kept FROM h
"""
