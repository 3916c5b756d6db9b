"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

An item's windows are its runs of ``WINDOW`` words (a shorter item is one window). A window's tokens are its
shingles of three words, with their place in it. As a match must contain all of them, one token is a sufficient
prefix: the one that is rarest in the corpus. A first pass counts the items' shingles in all documents (each
task sends one row a shingle); the second joins document shingles with the windows' prefix tokens. A candidate
must fit into the document (length and position bounds), then all its words are compared.

Items of at most ``BLOCK_BYTES`` of text travel to the tasks as one block, and no document is shuffled. Larger benchmarks
stay tables, and the same steps are joins that Spark spreads (``_joined``): two passes of the documents' shingles, whatever the
benchmark's size, one to count those that items have and one to meet the prefix tokens; then the words at the candidates' places
are joined with the windows' words.

Defined results: a null text has no words; an item without words is no window; items of fewer words than a
shingle have shorter ones; repeated items (equal item_id) count once, item ids are compared as strings, a null
item_id is left out of the lists but its words are hits; repeated documents each get a row; empty tables give no
hits or no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, ident

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4 << 20

#: Bytes that aren't part of a word, after lower-casing: all ASCII but digits and letters.
_BLANK = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_BLANK).split()


class Windows:
    """The windows of one block of items, their shingles, and (with counts) their prefix tokens."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found[ids[at : at + window]] |= {item} if item is not None else set()
        self.windows = [(np.array(w, np.int64), sorted(own)) for w, own in found.items()]
        self.base = len(self.vocabulary) + 1
        self.codes = {s: np.unique(np.concatenate([self.shingles(w, s) for w, _ in self.windows if self.size(w) == s])) for s in {self.size(w) for w, _ in self.windows}}
        self.prefix: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}

    @staticmethod
    def size(ids: np.ndarray) -> int:
        return min(SHINGLE, len(ids))

    def shingles(self, ids: np.ndarray, s: int) -> np.ndarray:
        """Codes of the runs of s ids; -1 where a word is no item's."""
        n = len(ids) - s + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(s):
            code = code * self.base + ids[k : k + n]
            ok &= ids[k : k + n] >= 0
        return np.where(ok, code, -1)

    def ids(self, ws: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Sets each window's prefix: its rarest shingle (ties: the smaller code)."""
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (ids, _) in enumerate(self.windows):
            s = self.size(ids)
            codes = self.shingles(ids, s).tolist()
            place = min(range(len(codes)), key=lambda i: (counts.get((s, codes[i]), 0), codes[i], i))
            chosen[s][codes[place]].append((k, place))
        self.prefix = {s: (np.array(sorted(by), np.int64), [by[c] for c in sorted(by)]) for s, by in chosen.items()}

    def hits(self, ids: np.ndarray) -> tuple[list[int], list[int], set[str]]:
        """Starts and ends (in words) of the windows found, and their items."""
        starts, ends, items = [], [], set()
        for s, (codes, windows) in self.prefix.items():
            own = self.shingles(ids, s)
            if not len(own):
                continue
            place = np.searchsorted(codes, own)
            place[place == len(codes)] = 0
            for at in np.flatnonzero(codes[place] == own).tolist():
                for k, offset in windows[place[at]]:
                    window, names = self.windows[k]
                    first = at - offset
                    if first >= 0 and first + len(window) <= len(ids) and np.array_equal(ids[first : first + len(window)], window):
                        starts.append(first)
                        ends.append(first + len(window))
                        items.update(names)
        return starts, ends, items


def _count(docs: DataFrame, block: Windows) -> dict[tuple[int, int], int]:
    """How often the block's shingles stand in the documents; at most a row per shingle of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {s: np.zeros(len(c), np.int64) for s, c in block.codes.items()}
        for b in batches:
            for x in b.column(1):
                ids = block.ids(words(x.as_py()))
                for s, codes in block.codes.items():
                    own = block.shingles(ids, s)
                    own = own[own >= 0]
                    place = np.searchsorted(codes, own)
                    place[place == len(codes)] = 0
                    np.add.at(seen[s], place[codes[place] == own], 1)
        for s, counts in seen.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(block.codes[s][some]), pa.array(counts[some])], names=["s", "code", "n"])

    return {(r.s, r.code): r.n for r in docs.mapInArrow(run, "s int, code long, n long").groupBy("s", "code").agg(F.sum("n").alias("n")).collect()}


def _scan(docs: DataFrame, block: Windows) -> DataFrame:
    """(doc_id, text_key, n_words, starts, ends, items) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = words(text := x.as_py())
                starts, ends, items = block.hits(block.ids(ws))
                rows.append((doc, hashlib.md5((text or "").encode()).digest(), len(ws), starts, ends, sorted(items)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, text_key binary, n_words long, starts array<int>, ends array<int>, items array<string>")


def _finish(found: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hit_starts", pa.list_(pa.int32())), ("hit_ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.to_pylist():
                spans: list[list[int]] = []
                for a, e in sorted(zip(x["starts"], x["ends"], strict=True)):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([a, e])
                n, items = sum(e - a for a, e in spans), sorted(set(x["items"]))
                rows.append((x["doc_id"], x["n_words"], n, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n > 0, [a for a, _ in spans], [e for _, e in spans]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_starts array<int>, hit_ends array<int>")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_starts, hit_ends (in words)."""
    return _finish(_found(docs, items, window, text, key, item_key, item_text, block_bytes))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", **more) -> DataFrame:
    """``docs`` without the rows that hold a window of an item. Their ids and text digests (few) are joined back."""
    dirty = _found(docs, items, window, text, key, **more).filter(F.size("starts") > 0).select("doc_id", "text_key").distinct().alias("x")
    d = docs.alias("d")
    same = F.col(f"d.{ident(key)}").cast("long").eqNullSafe(F.col("x.doc_id")) & (F.unhex(F.md5(F.coalesce(F.col(f"d.{ident(text)}"), F.lit("")))) == F.col("x.text_key"))
    return d.join(dirty, same, "left_anti").select(*[F.col(f"d.{ident(c)}") for c in docs.columns])


def _found(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    slim = docs.select(col(key).cast("long").alias("doc_id"), col(text).alias("text"))
    bench = items.select(col(item_key).cast("string").alias("item"), F.coalesce(col(item_text), F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if total > block_bytes:
        return _joined(slim, bench, window)
    block = Windows([(r.item, r.text) for r in bench.sort("item", "text").collect()], window)  # bounded by block_bytes
    if block.windows:
        block.choose(_count(slim, block))
    return _scan(slim, block)


def _codes(ws: list[bytes], s: int) -> np.ndarray:
    """Hashes of the runs of s words."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(b" ".join(ws[k : k + s]), s) for k in range(len(ws) - s + 1)], np.uint64).view(np.int64)


def _joined(slim: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """What ``_scan`` gives, for items of any size. A hash only makes candidates; windows are compared by their words."""
    scratch = Scratch(slim.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = words(text.as_py())
                runs = {b" ".join(ws[at : at + window]) for at in range(max(1, len(ws) - window + 1) if ws else 0)}
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(runs), pa.string()), pa.array(list(runs), pa.binary())], names=["item", "run"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for run in b.column(0).to_pylist():
                ws = run.split()
                s = min(SHINGLE, len(ws))
                rows += [(run, len(ws), s, place, code) for place, code in enumerate(_codes(ws, s).tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["run", "size", "s", "place", "code"])

    windows = scratch.write(bench.mapInArrow(cut, "item string, run binary").distinct(), "windows")
    dealt = scratch.write(windows.select("run").distinct().mapInArrow(tokens, "run binary, size int, s int, place int, code long"), "tokens")
    sizes = [r.s for r in dealt.select("s").distinct().sort("s").collect()]  # SHINGLE of them at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [_codes(ws, s) for ws in (words(x.as_py()) for x in b.column("text")) for s in sizes]
            codes, n = np.unique(np.concatenate(own) if own else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, text in zip(b.column("doc_id"), b.column("text_key"), b.column("text"), strict=True):
                ws = words(text.as_py())
                for s in sizes:
                    codes = _codes(ws, s)
                    same = [pa.array([x.as_py()] * len(codes), x.type) for x in (doc, key)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(codes), len(ws), np.int32)), pa.array(np.arange(len(codes), dtype=np.int32)), pa.array(codes)], names=["doc_id", "text_key", "n_words", "at", "code"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, text, spots in zip(b.column("doc_id"), b.column("text_key"), b.column("text"), b.column("spots").to_pylist(), strict=True):
                ws = words(text.as_py())
                same = [pa.array([x.as_py()] * len(spots), x.type) for x in (doc, key)]
                first, last = [x["first"] for x in spots], [x["first"] + x["size"] for x in spots]
                yield pa.RecordBatch.from_arrays([*same, pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array([b" ".join(ws[a:e]) for a, e in zip(first, last, strict=True)], pa.binary())], names=["doc_id", "text_key", "first", "last", "run"])

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(words(x.as_py())) for x in b.column(2)], pa.int64())], names=["doc_id", "text_key", "n_words"])

    docs = slim.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), "text")
    often = docs.select("text").mapInArrow(count, "code long, n long").join(dealt.select("code").distinct(), "code", "left_semi").groupBy("code").agg(F.sum("n").alias("n"))
    # the rarest shingle of each window; a window with one that no document has can't be anywhere
    ranked = dealt.join(often, "code", "left").groupBy("run").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code", "place", "size")).alias("x"))
    prefix = scratch.write(ranked.filter("x.n > 0").select("x.code", "x.place", "x.size").distinct(), "prefix")
    met = docs.mapInArrow(places, "doc_id long, text_key binary, n_words int, at int, code long").join(prefix, "code").withColumn("first", F.col("at") - F.col("place"))
    spots = met.filter("first >= 0 AND first + size <= n_words").select("doc_id", "text_key", "first", "size").distinct()
    spots = spots.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "size")).alias("spots"))  # a document has at most its words times window
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
    candidates = docs.alias("d").join(spots.alias("s"), same("d", "s")).select("d.doc_id", "d.text_key", "d.text", "s.spots").mapInArrow(read, "doc_id long, text_key binary, first int, last int, run binary")
    hits = candidates.join(windows, "run").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"), F.collect_set("item").alias("items"))
    every = docs.mapInArrow(sized, "doc_id long, text_key binary, n_words long").alias("d")
    none = F.expr("CAST(array() AS array<int>)")
    return every.join(hits.alias("h"), same("d", "h"), "left").select(
        "d.doc_id", "d.text_key", "n_words", F.coalesce("h.spans.first", none).alias("starts"), F.coalesce("h.spans.last", none).alias("ends"),
        F.coalesce("h.items", F.expr("CAST(array() AS array<string>)")).alias("items"))


#: The rows of the query in DuckDB, by a plain join of all windows.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark),
s AS (SELECT item, ws, least({WINDOW}, len(ws)) AS size, unnest(generate_series(1, len(ws) - least({WINDOW}, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0),
v AS (SELECT DISTINCT item, size, array_to_string(ws[i : i + size - 1], ' ') AS run FROM s),
sizes AS (SELECT DISTINCT size FROM v),
p AS (SELECT r, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM d, sizes WHERE len(ws) >= size),
found AS (SELECT r, i, p.size, item FROM (SELECT r, i, size, array_to_string(ws[i : i + size - 1], ' ') AS run FROM p) p JOIN v ON p.size = v.size AND p.run = v.run),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS k FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN names USING (r)
"""
