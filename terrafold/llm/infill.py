"""Fill-in-middle transformation over rank and select.

The token boundaries of a batch of texts are one bitvector over their bytes: a bit is set where a token ends. It is packed
into 64-bit words, and a directory holds the ones before each block of eight words. Popcounts give a text's number of
tokens n; where its prefix and its middle end is a select of two ranks, which yields byte cuts without a list of tokens. A
second bitvector marks the first bytes of code points; its ranks give lengths in code points.

A token is white space and the run of other characters behind it, or white space at the end of the text. All bytes
of multi-byte characters are no white space, so bytes give the same cuts as code points do.

There is no shuffle: each text is read and written once, and a task holds one batch of them (``SLICE`` bytes of output
at a time). Results depend on doc_id, text and seed alone, so a task that runs again gives the same.

Defined results: a null text is an empty one; an empty text, or one that holds a sentinel, stays plain; a null doc_id counts
as the empty text in the hash; repeated rows each get a row; texts of white space alone are one token; other columns play no part; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of those the ones with the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
#: Bytes of texts that are written at a time.
SLICE = 8 << 20
_WORDS = 8  # of 64 bits, in a block of the directory
_STEP = 1 << 22  # bytes whose flags are unpacked at a time; a multiple of a block's bits
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Bits:
    """A bitvector with a directory of the ones before each block of ``_WORDS`` words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).reshape(-1, _WORDS).sum(1, dtype=np.int64))])

    @classmethod
    def pack(cls, n: int, flags) -> Bits:
        """Of ``n`` bits, which ``flags(start, end)`` gives a step at a time."""
        words = np.zeros(-(-(n + 1) // (64 * _WORDS)) * _WORDS, "<u8")
        octets = words.view(np.uint8)
        for a in range(0, n, _STEP):
            own = np.packbits(flags(a, min(n, a + _STEP)), bitorder="little")
            octets[a // 8 : a // 8 + len(own)] = own
        return cls(words)

    def set(self, at: np.ndarray) -> Bits:
        """With these bits set as well."""
        words = self.words.copy()
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return Bits(words)

    def _blocks(self, block: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words.reshape(-1, _WORDS)[block]).astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, block = at >> 6, at // (64 * _WORDS)
        whole = np.where(np.arange(_WORDS) < (word % _WORDS)[:, None], self._blocks(block), 0).sum(1)
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the one that ``k`` ones precede."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        upto = self._blocks(block).cumsum(1)
        word = (upto <= left[:, None]).sum(1)
        left = left - np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        own = np.ascontiguousarray(self.words[block * _WORDS + word])
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").cumsum(1)
        return (block * _WORDS + word) * 64 + (bits <= left[:, None]).sum(1)


def boundaries(raw: np.ndarray, ends: np.ndarray) -> Bits:
    """Bits at the last bytes of all tokens of texts that lie in ``raw`` one after another up to ``ends``."""

    def flags(a: int, b: int) -> np.ndarray:
        space = _IS_SPACE[raw[a : min(len(raw), b + 1)]]
        return ~space[: b - a] & (space[1:] if b < len(raw) else np.append(space[1:], True))

    starts = np.concatenate([[0], ends[:-1]])
    return Bits.pack(len(raw), flags).set(ends[ends > starts] - 1)


def characters(raw: np.ndarray) -> Bits:
    """Bits at the first bytes of all code points."""
    return Bits.pack(len(raw), lambda a, b: (raw[a:b] & 0xC0) != 0x80)


def draws(keys: list[str], seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers per key: the first groups of the sha256 of ``seed:key``."""
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:16] for k in keys), ">u4").reshape(-1, 4).astype(np.int64)


def _octets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each row ends in them."""
    own = texts.cast(pa.large_binary())
    offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    raw = np.frombuffer(own.buffers()[2], np.uint8) if own.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def transformed(keys: list[str], texts: pa.Array, seed: int, rate: int, suffix_first: int) -> pa.RecordBatch:
    """One batch: n, form, prefix_chars, middle_chars, output."""
    raw, ends = _octets(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    tokens, points, h = boundaries(raw, ends), characters(raw), draws(keys, seed)
    base = tokens.rank(starts)
    n = tokens.rank(ends) - base
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)

    def cut(k: np.ndarray) -> np.ndarray:
        out = starts.copy()
        some = k > 0
        out[some] = tokens.select((base + k - 1)[some]) + 1
        return out

    first, second = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    marked = np.zeros(len(n), bool)
    for s in (PREFIX, SUFFIX, MIDDLE):
        marked |= np.asarray(pc.match_substring(texts, s))
    plain = marked | (n == 0) | (h[:, 2] % 100 >= rate)
    spm = h[:, 3] % 100 < suffix_first
    sign_p, sign_s, sign_m, octets = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode(), memoryview(raw)
    out = []
    for k in range(len(n)):
        a, b, c, e = starts[k], first[k], second[k], ends[k]
        if plain[k]:
            out.append(bytes(octets[a:e]))
        elif spm[k]:
            out.append(b"".join((sign_s, octets[c:e], sign_p, octets[a:b], sign_m, octets[b:c])))
        else:
            out.append(b"".join((sign_p, octets[a:b], sign_s, octets[c:e], sign_m, octets[b:c])))
    r0, r1, r2 = points.rank(starts), points.rank(first), points.rank(second)
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    columns = [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(r1 - r0, pa.int64(), mask=plain), pa.array(r2 - r1, pa.int64(), mask=plain)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary()).cast(pa.string())], names=["n", "form", "prefix_chars", "middle_chars", "output"])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE`` bytes (a longer text is a range of its own)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    a, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > SLICE:
            yield a, k
            a, held = k, 0
        held += size
    if len(sizes):
        yield a, len(sizes)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per row: key, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null: plain) and the output."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e in _slices(b.column(2)):
                part = b.slice(a, e - a)
                done = transformed(part.column(1).to_pylist(), part.column(2), seed, rate, suffix_first)
                yield pa.RecordBatch.from_arrays([part.column(0), *done.columns], names=["id", *done.schema.names])

    slim = docs.select(col(key).alias("id"), F.coalesce(col(key).cast("string"), F.lit("")).alias("drawn"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    found = slim.mapInArrow(run, f"id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("id", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Sentinels don't occur in transformed texts, so they cut the output exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``fill_in_middle``'s rows with hashes of the output and of the text that is rebuilt from it."""
    own = restored(F.col("output"), F.col("form"))
    return found.select(col(key), "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(own.cast("binary"), 256).alias("restored_sha256"))


_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE_SQL = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
b AS (SELECT *, regexp_extract_all(t, '{_TOKEN}') AS u FROM a),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS k1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS k2,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= {RATE} THEN 'plain'
           WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT *, array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m, array_to_string(u[greatest(k1, k2) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM d
"""
