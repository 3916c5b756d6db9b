"""Substring dedup: passages that repeat anywhere are found, compiled into automata and located everywhere.

A window is ``WINDOW`` = 35 consecutive words. A word goes if a window that covers it also starts somewhere
else, in the same document or another.

1. Anchors. Every document is streamed once. Of each window, the eight-word phrase with the smallest hash
   is its anchor: equal windows have equal anchors at equal places. Neighbouring windows mostly share theirs, so a
   document gives about one anchor per 15 words. Anchors are counted (combined on the map side); those that
   occur once cannot belong to a repeated window, and documents without others are done.
2. Passages. The words that the windows of a repeated anchor cover are a segment, at most 62 words. Equal segments are
   counted together, so copies cost a row each only once. Per anchor the windows of all its segments are counted by their words;
   runs of windows that recur are passages. This confirms what repeats, not where: segments carry no document.
3. Automata. The documents that are left are dealt to shards of about ``SHARD_WORDS`` words by their smallest repeated anchor, so
   that those that share passages mostly meet; an anchor that leads more is dealt to several shards. A shard gets the passages
   of all anchors that its documents hold, compiles them into an Aho-Corasick automaton over word numbers and streams its documents through it,
   every word of them: all places of all passages are covered, and their words go. A passage goes to the shards that can
   hold it and to no other, so work grows with the input; all documents through all passages would grow with its square.
   An anchor with more than ``HOT`` different segments could send many passages to many shards. Its segments are split into
   windows, counted by digest in tables that Spark can split, and the places found are sent to the documents' shards instead.

Defined results: a null or empty text has no words; fewer words than a window are all kept; a repeated row (same
id and text) is a document of its own, whose windows also start in its twin; a null doc_id is allowed; other
columns play no part; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col

WINDOW = 35
PHRASE = 8
SHARD_BYTES = 4 << 20
#: Words of the documents of a shard.
SHARD_WORDS = 1 << 19
HOT = 4096

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k, step = 1, base
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(step)
        k, step = 2 * k, step * step % 2**64
    return out


_SIZE = 1 << 20
_UP, _DOWN = _powers(_BASE, _SIZE + 1), _powers(pow(_BASE, -1, 2**64), _SIZE + 1)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB) >> np.uint64(23))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word, from running polynomial sums over blocks of text."""
    from xxhash import xxh64_intdigest

    out = np.empty(len(words), np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends, at = np.cumsum(sizes), 0
    while at < len(words):
        before = int(ends[at - 1]) if at else 0
        to = int(np.searchsorted(ends, before + _SIZE, side="right"))
        if to == at:  # a word longer than a block
            out[at] = xxh64_intdigest(words[at])
            at += 1
            continue
        raw = np.frombuffer(b"".join(words[at:to]), np.uint8)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _UP[: len(raw)], out=sums[1:])
        e = ends[at:to] - before
        s = e - sizes[at:to]
        out[at:to] = _mixed((sums[e] - sums[s]) * _DOWN[s] + sizes[at:to].astype(np.uint64))
        at = to
    return out


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each n neighbours."""
    k = 1
    while 2 * k <= n:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchored(words: list[bytes], window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash (signed), the run's first window, how many windows."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    own, power = word_hashes(words), 1
    hashes = np.zeros(len(words) - phrase + 1, np.uint64)
    for k in range(phrase):
        hashes += own[k : k + len(hashes)] * np.uint64(power)
        power = power * _BASE % 2**64
    hashes = _mixed(hashes)
    span, block, place = window - phrase + 1, 1 << 22, np.empty(n, np.int64)
    for at in range(0, n, block):
        part = hashes[at : at + block + span - 1]
        ranked = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)  # the first of equals
        place[at : at + block] = (_least(ranked, span)[: min(block, n - at)] & np.uint64((1 << 24) - 1)).astype(np.int64) + at
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return hashes[place[first]].view(np.int64), first, np.diff(first, append=n)


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    slim = docs.select(col(key).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    return slim.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text").alias("k2"), "text")


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, found = [], [], []
            for x in b.column(3):
                words = x.as_py().encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(anchored(words, window)[0])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(sha), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "n_words", "sha", "anchors"])

    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n_words long, sha string, anchors array<long>")


def _segments(texts: DataFrame, window: int, whole: bool) -> DataFrame:
    """Per repeated anchor of a row: row, first word, anchor, segment digest and (if ``whole``) words."""
    kinds = [("row", pa.int64()), ("first", pa.int32()), ("anchor", pa.int64()), ("name", pa.binary())] + [("segment", pa.binary())] * whole
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row, x, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                words = x.as_py().encode().split()
                anchors, first, many = anchored(words, window)
                for r in sorted(runs.as_py()):
                    a = int(first[r])
                    segment = b" ".join(words[a : a + int(many[r]) + window - 1])
                    found = (row, a, int(anchors[r]), hashlib.md5(segment).digest())
                    out.append((*found, segment) if whole else found)
                if len(out) >= 5000:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)

    return texts.select("row", "text", F.col("runs.run").alias("runs")).mapInArrow(run, "row long, first int, anchor long, name binary" + ", segment binary" * whole)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def confirm(segments: list[tuple[int, bytes, int]], window: int = WINDOW) -> set[tuple[int, bytes]]:
    """(anchor, segment, times) of whole anchors -> (anchor, passage): runs of windows that occur more than once.

    Texts that differ here and there cut one text into many overlapping runs. Where an anchor's runs have more words than
    its recurring windows, the windows themselves are its passages: they cover the same places, one at each.
    """
    passages: set[tuple[int, bytes]] = set()
    segments.sort(key=lambda s: s[0])
    at = 0
    while at < len(segments):
        to, group, seen = at, [], {}
        while to < len(segments) and segments[to][0] == segments[at][0]:
            words = segments[to][1].split(b" ")
            windows = [b" ".join(words[k : k + window]) for k in range(len(words) - window + 1)]
            group.append((words, windows))
            for w in windows:
                seen[w] = seen.get(w, 0) + segments[to][2]
            to += 1
        runs = {b" ".join(words[a:e]): e - a for words, windows in group for a, e in _joined([k for k, w in enumerate(windows) if seen[w] > 1], window)}
        again = [w for w, n in seen.items() if n > 1]
        passages |= {(segments[at][0], p) for p in (runs if sum(runs.values()) <= window * len(again) else again)}
        at = to
    return passages


def _joined(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Ranges of words that runs of neighbouring windows cover; ``starts`` ascend."""
    out: list[tuple[int, int]] = []
    for k in starts:
        if out and out[-1][1] == k - 1 + window:
            out[-1] = (out[-1][0], k + window)
        else:
            out.append((k, k + window))
    return out


def _passages(counted: DataFrame, n_groups: int, window: int) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("passage", pa.binary())])

    def group(t: pa.Table) -> pa.Table:
        found = sorted(confirm(list(zip(*(t.column(c).to_pylist() for c in ("anchor", "segment", "times")), strict=True)), window))
        return pa.Table.from_batches([_batch(found, schema)])

    dealt = counted.select(F.pmod(F.xxhash64("anchor"), F.lit(n_groups)).alias("group"), "anchor", "segment", "times")
    return dealt.groupBy("group").applyInArrow(group, "anchor long, passage binary")


def _by_window(counted: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """(name, starts, ends) of the repeated windows of hot anchors' segments, window by window."""
    words = F.split(F.col("segment").cast("string"), " ")
    cut = counted.select("name", "times", words.alias("w")).select("name", "times", "w", F.explode(F.sequence(F.lit(1), F.size("w") - window + 1)).alias("at"))
    cut = cut.select("name", "times", F.col("at").alias("first"), F.unhex(F.md5(F.array_join(F.slice("w", F.col("at"), F.lit(window)), " "))).alias("digest"))
    # A table of its own, so that a digest that many segments hold can be split.
    again = scratch.write(cut.groupBy("digest").agg(F.sum("times").alias("n")).filter("n > 1").select("digest"), "again")
    return cut.join(again, "digest").groupBy("name").agg(F.collect_list(F.col("first") - 1).alias("starts"))


def cover(texts: list[list[bytes]], passages: list[bytes]) -> list[np.ndarray]:
    """Per text which of its words stand in a place of a passage: all texts streamed through one automaton."""
    import ahocorasick

    number: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for p in set(passages):
        ids = tuple(number.setdefault(w, len(number) + 1) for w in p.split(b" "))
        automaton.add_word(ids, len(ids))
    out = [np.zeros(len(words), bool) for words in texts]
    if not passages:
        return out
    automaton.make_automaton()
    for words, gone in zip(texts, out, strict=True):
        for end, n in automaton.iter(tuple(number.get(w, 0) for w in words)):
            gone[end + 1 - n : end + 1] = True
    return out


def _texts(docs: DataFrame, every: DataFrame, scratch: Scratch, text: str, key: str, whole: bool, shard_words: int) -> DataFrame:
    """(doc_id, text, runs, row, shard): the rows with repeated anchors (or all, if ``whole``) with their runs."""
    twice = every.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    # Tables of their own, so that joins deal out both sides and Spark can split what a frequent key has.
    twice = scratch.write(twice, "twice")
    found = every.select("k1", "k2", "n_words", F.posexplode("anchors").alias("run", "anchor")).join(twice, "anchor")
    # Repeated rows have the same runs: each counts once per row.
    runs = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("run", "anchor")).alias("runs"), F.min("anchor").alias("lead"), F.max("n_words").alias("n"), F.count(F.lit(1)).alias("many"))
    runs = scratch.write(runs.select("k1", "k2", "runs", "lead", (F.col("n") * F.col("many") / F.size("runs")).cast("long").alias("words")), "runs")
    n_shards = max(1, -(-((every if whole else runs).agg(F.sum("n_words" if whole else "words")).first()[0] or 0) // shard_words))
    leads = scratch.write(runs.groupBy("lead").agg(F.sum("words").alias("n")).filter(F.col("n") > shard_words).select("lead", F.ceil(F.col("n") / shard_words).cast("int").alias("salts")), "leads")
    own = scratch.write(runs.join(leads, "lead", "left").select("k1", "k2", "runs", "lead", F.coalesce("salts", F.lit(1)).alias("salts")), "dealt")
    none = F.array().cast("array<struct<run:int,anchor:bigint>>")
    row = F.monotonically_increasing_id()
    found = _rows(docs, text, key).join(own, ["k1", "k2"], "left" if whole else "inner").withColumn("row", row)
    shard = F.when(F.col("lead").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("lead", F.pmod(F.xxhash64("row"), F.col("salts"))))
    return scratch.write(found.select("doc_id", "text", F.coalesce("runs", none).alias("runs"), "row", F.pmod(shard, F.lit(n_shards)).alias("shard")), "texts")


def _hints(texts: DataFrame, scratch: Scratch, window: int, shard_bytes: int, hot: int) -> DataFrame:
    """(shard, passage, row, starts): the passages that a shard's documents may hold, and hot windows' places by row."""
    counted = scratch.write(_segments(texts, window, True).groupBy("anchor", "name", "segment").agg(F.count(F.lit(1)).alias("times")), "segments")
    size = counted.agg(F.sum(F.octet_length("segment") + 32)).first()[0] or 0
    hottest = scratch.write(counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("anchor"), "hot")
    passages = scratch.write(_passages(counted.join(hottest, "anchor", "left_anti"), max(1, -(-size // shard_bytes)), window), "passages")
    needed = scratch.write(texts.select("shard", F.explode("runs.anchor").alias("anchor")).distinct(), "needed")
    hints = needed.join(passages, "anchor").select("shard", "passage", F.lit(None).cast("long").alias("row"), F.lit(None).cast("array<int>").alias("starts"))
    if hottest.head(1):
        found = scratch.write(_by_window(counted.join(hottest, "anchor", "left_semi"), scratch, window), "found")
        some = texts.select("row", F.explode("runs").alias("r")).join(hottest, F.col("r.anchor") == F.col("anchor"), "left_semi").select("row", F.col("r.run").alias("run")).groupBy("row").agg(F.collect_list("run").alias("own"))
        own = texts.join(scratch.write(some, "hot_runs"), "row").select("row", "text", F.transform("own", lambda r: F.struct(r.alias("run"))).alias("runs"))
        placed = _segments(own, window, False).join(found, "name").select("row", F.transform("starts", lambda x: x + F.col("first")).alias("starts"))
        placed = placed.join(texts.select("row", "shard"), "row")
        hints = hints.unionByName(placed.select("shard", F.lit(None).cast("binary").alias("passage"), "row", "starts"))
    scratch.drop("segments")
    return hints


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", keep_text: bool = False, shard_bytes: int = SHARD_BYTES, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, ``kept`` (its words, one space between)."""
    scratch = Scratch(docs.sparkSession)
    every = scratch.write(_anchors(_rows(docs, text, key), window), "anchors")
    texts = _texts(docs, every, scratch, text, key, keep_text, shard_words)
    hints = _hints(texts, scratch, window, shard_bytes, hot)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * keep_text)

    def stream(documents: pa.Table, known: pa.Table) -> pa.Table:
        words = [x.as_py().encode().split() for x in documents.column("text")]
        gone = cover(words, [p for p in known.column("passage").to_pylist() if p is not None])
        place = {row: k for k, row in enumerate(documents.column("row").to_pylist())}
        for row, starts in zip(known.column("row").to_pylist(), known.column("starts").to_pylist(), strict=True):
            for a in starts or ():
                gone[place[row]][a : a + window] = True
        out = []
        for doc, own, cut in zip(documents.column("doc_id").to_pylist(), words, gone, strict=True):
            kept = b" ".join(own[i] for i in np.flatnonzero(~cut).tolist())
            row = (doc, len(own), int(cut.sum()), hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode()) if keep_text else row)
        return pa.Table.from_batches([_batch(out, schema)])

    dealt = texts.select("shard", "row", "doc_id", "text").groupBy("shard")
    streamed = dealt.cogroup(hints.groupBy("shard")).applyInArrow(stream, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
    if keep_text:
        return streamed
    clean = every.join(scratch.read("runs", every.select("k1", "k2")), ["k1", "k2"], "left_anti")
    return streamed.unionByName(clean.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")))


#: The same rows in DuckDB, window by window.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, CASE WHEN i + {WINDOW - 1} <= len(ws) THEN md5(array_to_string(ws[i : i + {WINDOW - 1}], ' ')) END AS run FROM d),
c AS (SELECT r, i, w, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS again FROM p),
g AS (SELECT r, i, w, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
