"""Content-addressed store for token ids.

Files below one folder, all Parquet:

* ``chunks``: chunk_id (SHA-256 of the payload), n_ids, payload (little-endian ids, 2 bytes each where the
  vocabulary allows, else 4). A rolling hash over 16 ids cuts each document's id stream, so equal passages
  give equal chunks wherever they stand; each different chunk is stored once.
* ``recipes``: per document, in ascending doc_id order (nulls first): shard, doc_id, local_start (ids before it in
  its shard), n_tokens, chunk_ids, root (Merkle root over its chunk ids).
* ``manifest``: per shard of at most ``SHARD_DOCS`` documents: n_docs, n_tokens, start (ids in all earlier shards) and the
  Merkle root over its documents' roots.
* ``summary``: one row: n_shards, n_docs, n_tokens and the Merkle root over the shards' roots.

``write`` encodes each text once into a staging table in the shared folder. ``read_ids`` joins chunks back into
id streams; ``digest`` verifies the store without moving payloads: each chunk is read where it lies, its
SHA-256 compared with its name and its CRC-32 taken; a document's CRC-32 is combined from those of its chunks,
and its Merkle root recomputed; before that, each shard's counts, starts and Merkle root are recomputed from its recipes
and compared with the manifest both ways, and the summary from the manifest. A chunk, document, shard or summary that
doesn't verify raises an error, a lost one too.

Defined results: a null or empty text is the end id alone; documents with the same doc_id keep their own
recipes, ordered by their Merkle root; an empty table gives an empty store; other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import BROADCAST_BYTES, Scratch, col

END_ID = 2
#: A cut where the rolling hash has these bits clear: one in 512 ids; chunks of 64 to 4096 ids.
CUT_MASK = np.uint64(511 << 40)
MIN_CHUNK, MAX_CHUNK, WINDOW = 64, 4096, 16
#: Most documents of a shard, whose roots one task brings together (32 bytes each).
SHARD_DOCS = 1 << 16
#: Pieces that a worker keeps: more of them save encoding and take memory.
MEMO = 800_000
#: Bytes of text that a task encodes together: more of them hold more copies of a piece, and take more memory.
TOGETHER = 8 << 20


def _gear(n: int = 1 << 16) -> np.ndarray:
    """A fixed pseudo-random 64-bit value per id (ids beyond the table wrap round)."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return x * np.uint64(0x94D049BB133111EB)


GEAR = _gear()


def cuts(ids: np.ndarray) -> list[int]:
    """Where an id stream's chunks end."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    rolled, k = GEAR[ids & 0xFFFF], 1
    while k < WINDOW:  # the sum over 2k ids from those over k: values[i] + (values[i - 1] << 3) + (values[i - 2] << 6) ...
        rolled[k:] += rolled[:-k] << np.uint64(3 * k)
        k *= 2
    out, last = [], 0
    for at in (np.flatnonzero((rolled & CUT_MASK) == 0) + 1).tolist():
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if at - last >= MIN_CHUNK:
            out.append(at)
            last = at
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    if last < n:
        out.append(n)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node rises as it is; no leaves: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo CRC-32's, bit-reversed as the checksum is."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(1 << 16)
def _shift(n: int) -> int:
    """x to the power 8n."""
    out, base = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, base)
        base, n = _times(base, base), n >> 1
    return out


def crc_join(first: int, second: int, n_second: int) -> int:
    """CRC-32 of a concatenation, from both parts' checksums and the second's bytes."""
    return _times(first, _shift(n_second)) ^ second


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``TOGETHER`` bytes; a longer text begins one."""
    group = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64) // TOGETHER
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    return zip(bounds[:-1], bounds[1:], strict=True)


def staged(docs: DataFrame, tokenizer: str, end_id: int, width: int, text: str, key: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("chunk_ids", pa.list_(pa.binary())), ("payloads", pa.list_(pa.binary()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind, end = encoder(tokenizer, MEMO), "<u2" if width == 2 else "<u4", np.array([end_id], "<u4")
        for batch in batches:
            for first, to in _slices(batch.column(1)):
                part, rows, held = batch.slice(first, to - first), [], 0
                for doc, own in zip(part.column(0).to_pylist(), enc.column(part.column(1)), strict=True):
                    ids = np.append(own, end)
                    if width == 2 and int(ids.max()) > 0xFFFF:
                        raise ValueError("an id needs more than 2 bytes; write with width=4")
                    raw, ends = ids.astype(kind).tobytes(), cuts(ids)
                    payloads = [raw[a * width : b * width] for a, b in zip([0, *ends], ends)]  # noqa: B905
                    names = [hashlib.sha256(p).digest() for p in payloads]
                    rows.append((doc, len(ids), merkle(names), names, payloads))
                    held += len(raw)
                    if held > 4 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    return docs.select(col(key).cast("long").alias("doc_id"), col(text).cast("string").alias("text")).mapInArrow(cut, "doc_id long, n_tokens long, root binary, chunk_ids array<binary>, payloads array<binary>")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, width: int = 2, text: str = "text", key: str = "doc_id", shard_docs: int = SHARD_DOCS) -> None:
    """Writes the store; ``path`` must be new, in a folder that all executors share."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    stage = scratch.write(staged(docs, tokenizer, end_id, width, text, key), "staged")
    pairs = stage.select(F.explode(F.arrays_zip("chunk_ids", "payloads")).alias("c")).select(F.col("c.chunk_ids").alias("chunk_id"), F.col("c.payloads").alias("payload"))
    once = pairs.groupBy("chunk_id").agg(F.first("payload").alias("payload"))
    once.select("chunk_id", (F.octet_length("payload") / width).cast("long").alias("n_ids"), "payload").write.option("compression", "zstd").parquet(f"{path}/chunks")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("chunk_ids", pa.list_(pa.binary()))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, at, base = 0, 0, 0
        for b in batches:
            sizes, own = np.asarray(b.column(1)), seen + np.arange(b.num_rows)
            before = at + np.cumsum(sizes) - sizes
            shard = (TaskContext.get().partitionId() << 32) + own // shard_docs
            first = np.maximum.accumulate(np.where(own % shard_docs == 0, before, base))
            seen, at, base = seen + len(own), at + int(sizes.sum()), int(first[-1]) if len(own) else base
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0), pa.array(before - first), b.column(1), b.column(2), b.column(3)], schema=schema)

    order = [F.col("doc_id").asc_nulls_first(), "root"]
    ordered = stage.select("doc_id", "n_tokens", "root", "chunk_ids").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(number, "shard long, doc_id long, local_start long, n_tokens long, root binary, chunk_ids array<binary>").write.option("compression", "zstd").parquet(f"{path}/recipes")
    scratch.drop("staged")

    _shards(spark, path).write.parquet(f"{path}/manifest")
    _summary(spark, path).write.parquet(f"{path}/summary")


def _trees(df: DataFrame) -> DataFrame:
    """``df`` with its last column, an array of (at, n, root), as the Merkle root over those roots in order of ``at``.

    Where they don't follow on (each ``at`` is the sum of the ``n`` before it) the root is null.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[:-1]) + ", root binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = []
            for own in b.columns[-1]:
                parts = sorted((x["at"], x["n"], x["root"]) for x in own.as_py())
                at, sizes = np.array([x[:2] for x in parts], np.int64).reshape(-1, 2).T
                roots.append(merkle([x[2] for x in parts]) if (at == np.cumsum(sizes) - sizes).all() else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(roots, pa.binary())], names=[*b.schema.names[:-1], "root"])

    return df.mapInArrow(run, schema)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The manifest that the stored recipes give. A list holds at most ``SHARD_DOCS`` roots."""
    recipes = spark.read.parquet(f"{path}/recipes")
    shards = _trees(recipes.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.collect_list(F.struct(F.col("local_start").alias("at"), F.col("n_tokens").alias("n"), "root")).alias("roots")))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return shards.select("shard", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "root")


def _summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary that the stored manifest gives; 40 bytes a shard are brought together."""
    kept = spark.read.parquet(f"{path}/manifest")
    return _trees(kept.agg(F.count(F.lit(1)).alias("n_shards"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.collect_list(F.struct(F.col("start").alias("at"), F.col("n_tokens").alias("n"), "root")).alias("roots")))


def verify_shards(spark: SparkSession, path: str) -> None:
    """Raises if a shard's manifest row isn't what its recipes give, its documents don't follow on, or the summary differs."""
    kept, found = (d.select("shard", F.struct("n_docs", "n_tokens", "start", F.hex("root").alias("root")).alias(n)) for d, n in ((spark.read.parquet(f"{path}/manifest"), "kept"), (_shards(spark, path), "found")))
    bad = kept.join(found, "shard", "full").filter(~F.col("kept").eqNullSafe(F.col("found"))).agg(F.min("shard")).first()[0]
    if bad is not None:
        raise ValueError(f"shard {bad} does not verify")
    if spark.read.parquet(f"{path}/summary").collect() != _summary(spark, path).collect():  # one row each
        raise ValueError("the summary does not verify")


def _chunk_facts(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(chunk_id, n, crc) of each stored chunk; crc is that of its ids as 32-bit integers."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(payload).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4")
                rows.append((name, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            yield _batch(rows, pa.schema([("chunk_id", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())]))

    return spark.read.parquet(f"{path}/chunks").select("chunk_id", "payload").mapInArrow(facts, "chunk_id binary, n long, crc long")


def _located(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes")
    shards = spark.read.parquet(f"{path}/manifest").select("shard", F.col("start").alias("base"))
    if shards.count() * 64 <= BROADCAST_BYTES:
        shards = F.broadcast(shards)
    return recipes.join(shards, "shard").select("shard", "doc_id", "local_start", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "root", "chunk_ids")


def digest(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Per stored document, verified: doc_id, start, n_tokens, ids_crc32, n_chunks."""
    verify_shards(spark, path)
    parts = _located(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    joined = parts.join(_chunk_facts(spark, path, width), "chunk_id", "left")
    docs = joined.groupBy("start", "n_tokens", "root", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "n", "crc"))).alias("parts"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_chunks", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, root, doc, lists = batch.columns
            flat = lists.flatten()
            ends = (np.asarray(lists.offsets) - lists.offsets[0].as_py()).tolist()
            names, many, crcs = (flat.field(c).to_pylist() for c in (1, 2, 3))
            rows = []
            for k, to, at, n_tokens, tree, name in zip(ends[:-1], ends[1:], start.to_pylist(), size.to_pylist(), root.to_pylist(), doc.to_pylist(), strict=True):
                if None in many[k:to]:
                    raise ValueError(f"document {name}: a chunk is missing")
                crc, n = crcs[k], many[k]
                for j in range(k + 1, to):
                    crc = crc_join(crc, crcs[j], 4 * many[j])
                    n += many[j]
                if n != n_tokens or merkle(names[k:to]) != tree:
                    raise ValueError(f"document {name} does not verify")
                rows.append((name, at, n, crc, to - k))
            yield _batch(rows, schema)

    return docs.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long")


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, ids): every document's id stream, put together from its chunks."""
    parts = _located(spark, path).select("doc_id", "start", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    whole = parts.join(spark.read.parquet(f"{path}/chunks"), "chunk_id").groupBy("start", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in own.as_py()), "<u2" if width == 2 else "<u4").astype(np.int32) for own in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return whole.select("doc_id", "start", "parts").mapInArrow(join, "doc_id long, start long, ids array<int>")
