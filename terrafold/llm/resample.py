"""Importance resampling toward a target distribution over hashed word runs.

Documents become a sparse matrix of documents by buckets, kept as a table of CSR blocks: document ids, where each row
starts, bucket numbers and counts. A block is what a task gets from one batch, at most ``BLOCK`` counts unless one document
has more (a document has at most one per bucket). The table holds each list as the bytes of its numbers, in as few as they need, and a
page of it a few blocks: the JVM copies them and never holds a list, a row or a page of many megabytes. The target's texts become blocks in the same way. Column sums of the two matrices give the
distributions; they are added up within each task and only sums per bucket are shuffled. The gain of a bucket is the
logarithm of their ratio, smoothed by one. A product of each block with the gains gives the documents' weights, without their texts being read
again. Only the ``buckets`` gains reach the driver and the tasks, whatever the corpus holds.

The draw without replacement takes the highest scores, weight plus a Gumbel number from the hash of the document's id. Ranks come
from a sort that Spark spreads by ranges of (score, doc_id), written with row numbers: a rank is a number within its part plus
the sizes of the parts before, one small row each. No task sees all rows.

The bytes' crc32 of a run of two words is put together from those of its words, which are taken once per different word and
batch: crc32 is linear, so the first word's is shifted by the second's length with a table.

Defined results: null texts have no features and weight 0; documents with few words have a weight and score and no rank; ties of
score go to the smaller doc_id, null ids first; repeated rows each count and each may be drawn; a null doc_id counts as the
empty text in the hash; other columns play no part; an empty table, or an empty target, is counts of zero.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col

BUCKETS, LEAST_WORDS, PER_CENT, SEED = 10_000, 20, 25, 7
#: Counts in a block, and bytes of text that are cut into words at a time.
BLOCK, STEP = 1 << 18, 1 << 18
_WORD, _REST = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[0-9A-Za-z\x80-\xff]*")
_CSR = "ids array<long>, starts array<int>, buckets array<int>, counts array<int>, features array<long>"
_CSR_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("features", pa.list_(pa.int64()))])
_PACKED = "ids array<long>, starts binary, buckets binary, counts binary, features binary"
_PACKED_ARROW = pa.schema([("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("starts", "buckets", "counts", "features")]])
#: Parquet checks a page's and a row group's size every 100 rows at first, which may be 100 blocks.
_PAGES = {"parquet.page.row.count.limit": "4", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4", "parquet.enable.dictionary": "false"}


_tables: dict[int, np.ndarray] = {}


def _shift_table(n: int) -> np.ndarray:
    """What ``n`` bytes that follow make of each of the four bytes of a crc."""
    if n not in _tables:
        if len(_tables) >= 4096:
            _tables.clear()
        zeros = bytes(n)
        bits = [np.uint32(zlib.crc32(zeros, 1 << k) ^ zlib.crc32(zeros)) for k in range(32)]
        out = np.zeros((4, 256), np.uint32)
        for j in range(32):
            out[j // 8] ^= np.where(np.arange(256) >> j % 8 & 1, bits[j], np.uint32(0))
        _tables[n] = out
    return _tables[n]


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of pairs of byte strings put together, from both crcs and the second ones' sizes."""
    lengths, at = np.unique(size, return_inverse=True)
    out = second.copy()
    if len(lengths):
        tables = np.stack([_shift_table(int(n)) for n in lengths])
        for j in range(4):
            out ^= tables[at, j, first >> np.uint32(8 * j) & np.uint32(255)]
    return out


def _steps(texts: list[bytes]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(document, words) lists of about ``STEP`` bytes; a long text comes in parts that end between words."""
    held, size = [], 0
    for doc, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + STEP - size)
            if end < len(text):  # to the end of the word
                end = _REST.match(text, end).end()
            held.append((doc, _WORD.findall(text[at:end].lower())))
            size += end - at
            at = end
            if size >= STEP:
                yield held
                held, size = [], 0
    if held:
        yield held


def counted(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) in that order, and features per document."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    features = np.zeros(len(texts), np.int64)
    last: tuple[int, bytes] | None = None
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for step in _steps([t or b"" for t in texts]):
        words = [w for _, own in step for w in own]
        docs = np.repeat([d for d, _ in step], [len(own) for _, own in step]).astype(np.int64)
        if not words:
            continue
        carried = int(last is not None and last[0] == docs[0])
        if carried:  # the run of two words over the edge of two parts
            words, docs = [last[1], *words], np.concatenate([[last[0]], docs])
        last = (int(docs[-1]), words[-1])
        coded = pa.array(words, pa.binary()).dictionary_encode()
        different = coded.dictionary.to_pylist()
        ids = np.asarray(coded.indices)
        crc = np.array([zlib.crc32(w) for w in different], np.uint32)
        spaced = np.array([zlib.crc32(b" ", int(c)) for c in crc], np.uint32)
        sizes = np.array([len(w) for w in different], np.int64)
        same = docs[1:] == docs[:-1]
        one, two = ids[:-1][same], ids[1:][same]
        pairs = joined_crc(spaced[one], crc[two], sizes[two])
        own = np.concatenate([docs[carried:] * buckets + crc[ids[carried:]] % buckets, docs[1:][same] * buckets + pairs % buckets])
        features += np.bincount(own // buckets, minlength=len(texts))
        waiting.append(np.unique(own, return_counts=True))
        if sum(len(k) for k, _ in waiting) > 4 * len(keys) + BLOCK:
            keys, sums = _merged([(keys, sums), *waiting])
            waiting = []
    keys, sums = _merged([(keys, sums), *waiting])
    return keys // buckets, keys % buckets, sums, features


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([s for _, s in parts]), len(keys)).astype(np.int64)


def _bytes(x: np.ndarray, most: int | None = None) -> bytes:
    """Numbers of zero or more, in as few bytes each as the largest (or ``most``) needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)) if most is None else most)).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    """``n`` numbers that ``_bytes`` packed."""
    return np.frombuffer(raw, f"u{len(raw) // n}" if n else np.uint8)


def blocks(docs: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, block: int = BLOCK, packed: bool = False) -> DataFrame:
    """The matrix of documents by buckets as CSR blocks; a row of ``starts`` more than there are documents. ``packed``: lists of numbers are their bytes."""
    schema = _PACKED_ARROW if packed else _CSR_ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, a = b.column(0).to_pylist(), b.column(1).cast(pa.binary()), 0
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            while a < len(ids):  # a text has no more features than bytes, so these bound the counts
                e, size = a + 1, sizes[a]
                while e < len(ids) and size + sizes[e] <= block:
                    size += sizes[e]
                    e += 1
                doc, bucket, count, features = counted(texts[a:e].to_pylist(), buckets)
                starts = np.searchsorted(doc, np.arange(e - a + 1))
                columns = [ids[a:e], starts, bucket, count, features]
                if packed:
                    columns[1:] = [_bytes(starts), _bytes(bucket, buckets), _bytes(count), _bytes(features)]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                a = e

    return docs.select(col(key).cast("long").alias("id") if key in docs.columns else F.lit(None).cast("long").alias("id"), col(text).cast("string").alias("text")).mapInArrow(run, _PACKED if packed else _CSR)


def _counts(b: pa.RecordBatch, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts of each packed block."""
    width = np.min_scalar_type(buckets).itemsize
    for at, n in zip(b.column("buckets"), b.column("counts"), strict=True):
        raw = at.as_py()
        yield _numbers(raw, len(raw) // width), _numbers(n.as_py(), len(raw) // width)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of packed blocks for the buckets that occur: added up within a task, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at, n in _counts(b, buckets):
                total += np.bincount(at, n, buckets).astype(np.int64)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own], pa.int64())], names=["bucket", "n"])

    return matrix.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(sums: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # a row a bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored thousandfold logarithm of the target's smoothed share over the source's."""
    n, many, wanted = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (many + n) / ((s + 1) * (wanted + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(seed: int, key: int | None) -> int:
    """The number that a document's id draws."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(matrix: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score) of every document: each packed block times the gains."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (at, n), ids, starts, features in zip(_counts(b, len(gain)), b.column("ids"), b.column("starts"), b.column("features"), strict=True):
                own = ids.as_py()
                starts, features = _numbers(starts.as_py(), len(own) + 1), _numbers(features.as_py(), len(own)).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(gain[at] * n.astype(np.int64))])[starts]
                weight = np.where(features > 0, (ends[1:] - ends[:-1]) // np.maximum(features, 1), 0)
                score = weight + np.array([gumbel(seed, k) for k in own], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *[pa.array(x, pa.int64()) for x in (features, weight, score)]], schema=schema)

    return matrix.mapInArrow(run, "doc_id long, n_features long, weight long, score long")


def ranked(rows: DataFrame, few: int, scratch: Scratch) -> DataFrame:
    """``rows`` with rank 1 to ``few`` by score (higher first, then the smaller doc_id); the others' rank is null."""
    order = [F.desc("score"), F.asc("doc_id")]
    # Row numbers are only ever read from the written table, where they are fixed.
    sorted_ = scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.n) for r in sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a part of the sort
    ends = list(accumulate((n for _, n in sizes), initial=0))
    offsets = [(p, e) for (p, _), e in zip(sizes, ends[:-1], strict=True)]
    parts = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + place + 1
    return sorted_.join(F.broadcast(parts), part == F.col("part")).withColumn("rank", F.when(rank <= few, rank)).drop("at", "part", "before")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null: not drawn)."""
    scratch = Scratch(docs.sparkSession)
    matrix = scratch.write(blocks(docs, text, key, buckets, block, packed=True), "matrix", **_PAGES)
    wanted = scratch.write(blocks(target, text, key, buckets, block, packed=True), "target", **_PAGES)
    gain = gains(_dense(column_sums(matrix, buckets), buckets), _dense(column_sums(wanted, buckets), buckets))
    scored = scratch.write(weights(matrix, gain, seed), "scored")
    scratch.drop("matrix", "target")
    long = F.col("n_features") >= 2 * least_words - 1  # n words have n runs of one and n - 1 of two
    n = scored.filter(long).count()
    found = ranked(scored.filter(long), per_cent * n // 100, scratch)
    return found.unionByName(scored.filter(~long).withColumn("rank", F.lit(None).cast("long")))
