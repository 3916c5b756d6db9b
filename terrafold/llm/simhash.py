"""SimHash near-duplicates, found by pigeonring filtering.

A text's fingerprint has a bit for each of 64 (or several times 64): set if more than half of its word-shingle hashes
(XXH64, seed 42; further words by mixing them) have it set. Two rules link fingerprints, and linked texts form classes.

``near_duplicates`` (op2): 64 bits of four-word shingles, linked at ``LIMIT`` = 4 or fewer differing bits. The bits are a
ring of five segments. If two fingerprints differ in at most 4 bits then (cycle lemma) from some segment on, every chain
of l consecutive segments differs in at most floor(4 l / 5) bits: 0, 1, 2, 3, 4. The first segment is then equal, of
the next, with at most one difference, one half, of the third a third and of the fourth a quarter: the join key is
(segment, parts, their bits). Keys lengthen with the corpus (``depth``): 19 bits of two segments, 23 of three or 26 of
four. Within a key the whole chain condition is applied before the Hamming check. No link is lost.

``near_copies`` (the pipeline's stage): texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more. Such
texts differ in about 15 % of their bits, too many for equal segments to be certain in 64 bits, so the fingerprint has
``WIDE`` = 512 bits. Texts meet where a segment of it is equal, the chain from there must keep budgets
proportional to ``FAR`` = 102 bits, then the full distance. Segments lengthen with the corpus so that a key holds 16 texts at most on average (``SEGMENTS``): 32
segments of 16 bits, 128 of 20, 192 of 24 or 384 of 28, over several arrangements of the bits. Of pairs at 73 bits, the usual distance at a
similarity of 0.8, these find 96, 99, 98 and 98 % (simulated), of those at 64 bits over 99 %, all within 31. Up to
``SURE`` bits (over three deviations below the distance that a similarity of 0.8 gives) a pair is a link; beyond, the shingle
sets of both texts are compared. First the shortest candidates that span what all of a key's candidates connect are compared; then, wherever
one of these failed, all candidates between texts that are still in different classes. So no candidate that would join two classes is left out.

Equal fingerprints are one node, so copies cost one aggregation. A key with more than ``BLOCK`` fingerprints is
split into blocks and each pair of blocks is a group of its own. A group gives at most one edge per
fingerprint, never all pairs: a spanning forest of its links (op2), or the shortest edges that span them (near copies).
Components come from alternating stars over written tables. Fingerprints are never collected.

Defined results: a null or empty text and one without words have fingerprint zero, linked like any other;
fewer words than a shingle are one shingle; repeated rows each get their row; rows with a null doc_id take part
and get the smallest id of their class (null if it has none); other columns pass through; an empty table gives none.
``keep_first`` keeps one row of each class: the smallest id (null ids last), of rows that share it the one with the smallest
text digest, of rows that share both the one with the smallest row hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, free_name, small_side
from .components import stars

SHINGLE = 4
SEED = 42
LIMIT = 4
#: Fingerprints of a key that are compared at once.
BLOCK = 4096
#: (first bit, bits) of the ring's segments.
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
KEY_BITS = 40

#: Near copies: words of a shingle, least Jaccard similarity, and the wide fingerprint.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
WIDE = 512
#: (most texts, bits of a segment, bytes from a segment's start to the next one's, arrangements of the bits).
SEGMENTS = ((1 << 20, 16, 2, 1), (1 << 24, 20, 1, 2), (1 << 28, 24, 1, 3), (1 << 62, 28, 1, 6))
#: Bits within which a pair is a link, and beyond which it is none.
SURE, FAR = 51, 102
#: Groups up to this size are compared pair by pair at once.
SMALL = 256


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``shingle`` lower-cased words, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], "<u8")


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Word k of the wide hashes: for 0 the hashes themselves."""
    if not k:
        return h
    x = (h ^ (h >> np.uint64(32))) * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def majority(hashes: np.ndarray, n_words: int = 1) -> np.ndarray:
    """The fingerprint of some shingle hashes, as unsigned 64-bit words."""
    sums = np.zeros(64 * n_words, np.int64)
    for at in range(0, len(hashes), 1 << 13):  # what is held doesn't grow with the text
        part = hashes[at : at + (1 << 13)]
        raw = np.stack([_mixed(part, k) for k in range(n_words)], 1).view(np.uint8)
        sums += np.add.reduce(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return np.packbits(sums * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    return int(majority(shingle_hashes(text, shingle))[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(col(key).cast("long").alias("doc_id"), col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _parts(at: int, n: int, k: int) -> list[tuple[int, int]]:
    """(first bit, bits) of k near-equal parts of a segment."""
    cuts = [at + n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def key_parts(depth: int) -> list[list[tuple[int, int]]]:
    """Per key the (first bit, bits) of what it holds: a segment, then a part of each of the next ``depth`` - 1.

    The l-th segment of a chain that keeps its budgets has at most l - 1 differences, so one of l parts is equal.
    """
    out = []
    for i in range(len(RING)):
        own = [[RING[i]]]
        for length in range(2, depth + 1):
            own = [[*k, p] for k in own for p in _parts(*RING[(i + length - 1) % len(RING)], length)]
        out += own
    return out


def depth_for(n: int) -> int:
    """How many segments a key covers: 2 up to 4 million fingerprints, 3 up to 64 million, else 4."""
    return 2 if n <= 1 << 22 else 3 if n <= 1 << 26 else 4


def _keys(depth: int):
    """The join keys of a fingerprint: the key's number above ``KEY_BITS``, its bits below."""
    out = []
    for number, parts in enumerate(key_parts(depth)):
        key = F.lit(number).cast("long")
        for at, n in parts:
            key = F.shiftleft(key, n).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1).cast("long")))
        out.append(F.shiftleft(key, KEY_BITS - sum(n for _, n in parts)))
    return F.array(*out)


#: Per first segment: the bits of chains of 1 to 5 segments.
CHAINS = [[np.uint64(sum(((1 << n) - 1) << at for at, n in [RING[(i + k) % 5] for k in range(length)])) for length in range(1, 6)] for i in range(5)]


def forest(fps: np.ndarray, segment: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Edges that span the links of some unsigned fingerprints whose chain from ``segment`` keeps its budgets."""
    chain, edges, left = CHAINS[segment], [], fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            pick, apart = np.arange(len(left)), left ^ at
            for length, mask in enumerate(chain, 1):
                ok = np.bitwise_count(apart & mask) <= limit * length // len(RING)
                pick, apart = pick[ok], apart[ok]
                if not len(pick):
                    break
            if len(pick):
                found = left[pick]
                edges += [(int(at), int(x)) for x in found]
                frontier += list(found)
                left = np.delete(left, pick)
    return edges


def _dealt(keyed: DataFrame, scratch: Scratch, block: int, name: str, *values: str) -> DataFrame:
    """Groups (k, list of ``values``): each key's rows, or each pair of blocks of a key of more than ``block`` rows."""
    large = scratch.write(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("k", F.ceil(F.col("n") / block).cast("int").alias("blocks")), name)
    dealt = keyed.join(large, "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(values[0]), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    what = values[0] if len(values) == 1 else F.struct(*values)
    return dealt.groupBy("k", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list(what).alias("rows")).filter(F.size("rows") > 1).select("k", "rows")


def links(nodes: DataFrame, scratch: Scratch, block: int = BLOCK, depth: int | None = None) -> DataFrame:
    """(u, v): a spanning set of the links between different fingerprints (column fp of a written table)."""
    depth = depth or depth_for(nodes.count())
    per_segment = len(key_parts(depth)) // len(RING)
    groups = _dealt(nodes.select("fp", F.explode(_keys(depth)).alias("k")), scratch, block, "large", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            out: list[tuple[int, int]] = []
            for k, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                segment = (k >> KEY_BITS) // per_segment
                if b - a == 2:
                    x, y = int(flat[a]), int(flat[a + 1])
                    apart = x ^ y
                    if all((apart & int(m)).bit_count() <= LIMIT * n // 5 for n, m in enumerate(CHAINS[segment], 1)):
                        out.append((x, y))
                else:
                    out += forest(np.unique(flat[a:b]), segment)
            if out:
                pair = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

    return groups.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.write(fingerprints(docs, shingle, text, key), "fps")
    nodes = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = stars(links(nodes.select("fp"), scratch), scratch)
    rooted = nodes.join(found.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # Only classes of several nodes need looking up; as a table of their own, so that a large class's rows can be split.
    best = scratch.write(best.filter("n > 1").select("root", "component_id"), "best")
    named = rooted.join(best, "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    named = scratch.write(named, "named")
    scratch.drop("large", "nodes", "rooted", "best")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _budgets() -> np.ndarray:
    """Most differing bits of chains of 64, 128, ... bits."""
    return np.arange(1, WIDE // 64 + 1) * 64 * FAR // WIDE


def _apart(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs i[k], j[k] the numbers k whose chains keep all budgets, and their distances; chains start at the first bit."""
    rows, total = np.arange(len(i)), np.zeros(len(i), np.int64)
    for word, budget in enumerate(_budgets()):
        total = total + np.bitwise_count(fps[i[rows], word] ^ fps[j[rows], word])
        ok = total <= budget
        rows, total = rows[ok], total[ok]
        if not len(rows):
            break
    return rows, total


def shortest(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (distance, i, j) the shortest that span what all of them connect."""
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    out = []
    for d, i, j in sorted(pairs):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.append((d, i, j))
    return out


def _large_group(fps: np.ndarray) -> list[tuple[int, int, int]]:
    """(distance, i, j) for one large group: a forest of its sure links, then the shortest that span what connects its trees."""
    n, edges = len(fps), []
    tree, left = np.full(n, -1), np.arange(n)
    while len(left):
        top, left = int(left[0]), left[1:]
        tree[top], frontier = top, [top]
        while frontier and len(left):
            at = frontier.pop()
            apart = np.bitwise_count(fps[left] ^ fps[at]).sum(1, dtype=np.int64)
            hit = apart <= SURE
            if hit.any():
                edges += [(int(d), at, int(j)) for d, j in zip(apart[hit], left[hit], strict=True)]
                tree[left[hit]] = top
                frontier += left[hit].tolist()
                left = left[~hit]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for at, j, d in _between(fps, tree):
        ends = (int(min(tree[at], tree[j])), int(max(tree[at], tree[j])))
        if ends not in best or best[ends] > (d, at, j):
            best[ends] = (d, at, j)
    spanning = shortest([(d, *ends) for ends, (d, _, _) in best.items()])
    return edges + [best[ends] for _, *ends in spanning for ends in [tuple(ends)]]


def _between(fps: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, distance) of the pairs of one group that keep their budgets and are of different classes."""
    names, own = np.unique(classes, return_inverse=True)
    biggest = np.bincount(own).argmax()
    outside = np.flatnonzero(own != biggest)
    for at in outside.tolist():
        others = np.flatnonzero((own != own[at]) & ((own == biggest) | (np.arange(len(own)) > at)))
        rows, total = _apart(fps, np.full(len(others), at), others)
        yield from ((at, int(j), int(d)) for j, d in zip(others[rows], total, strict=True))


def group_edges(nodes: np.ndarray, fps: np.ndarray, sizes: np.ndarray, classes: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(node, node, distance) of the candidate links of some groups that lie one after another, turned so that their segment comes first.

    Without ``classes`` the shortest that span what all of a group's candidates connect; with them, all candidates between different classes.
    """
    group = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    last, found = (ends - 1)[group], []
    small = sizes[group] <= SMALL
    for step in range(1, int(min(sizes.max(initial=0), SMALL))):
        here = small & (np.arange(len(group)) + step <= last)
        if classes is not None:
            here[: len(here) - step] &= classes[: len(here) - step] != classes[step:]
        i = np.flatnonzero(here)
        if not len(i):
            if classes is None:
                break
            continue
        rows, total = _apart(fps, i, i + step)
        found += list(zip(group[i[rows]].tolist(), total.tolist(), i[rows].tolist(), (i[rows] + step).tolist(), strict=True))
    out = []
    if classes is None:
        found.sort()
        at = 0
        while at < len(found):
            to = at
            while to < len(found) and found[to][0] == found[at][0]:
                to += 1
            out += shortest([x[1:] for x in found[at:to]])
            at = to
    else:
        out += [x[1:] for x in found]
    for g in np.flatnonzero(sizes > SMALL).tolist():
        first, end = int(ends[g] - sizes[g]), int(ends[g])
        more = _large_group(fps[first:end]) if classes is None else [(d, i, j) for i, j, d in _between(fps[first:end], classes[first:end])]
        out += [(d, first + i, first + j) for d, i, j in more]
    return [(int(nodes[i]), int(nodes[j]), d) for d, i, j in out]


def _wide(docs: DataFrame, shingle: int, text: str, key: str) -> DataFrame:
    """(doc_id, text_key, fp) with fp as 64 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [majority(shingle_hashes(x.as_py(), shingle), WIDE // 64).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary())], names=["doc_id", "text_key", "fp"])

    slim = docs.select(col(key).cast("long").alias("doc_id"), _text_key(text).alias("text_key"), col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, text_key long, fp binary")


def _text_key(text: str):
    """A text's digest; null and empty texts share one."""
    return F.xxhash64(F.coalesce(col(text), F.lit("")))


def segments_for(n: int) -> tuple[int, int, int]:
    """Bits of a segment, bytes from start to start, and arrangements for ``n`` texts."""
    return next(x[1:] for x in SEGMENTS if n <= x[0])


def segment_keys(fps: np.ndarray, bits: int, step: int, arrangements: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per segment: each fingerprint's key and the fingerprint turned so that the segment comes first."""
    flat = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    for k in range(arrangements):
        own = np.packbits(flat[:, np.random.default_rng(k).permutation(WIDE)], axis=1, bitorder="little") if k else fps.view(np.uint8)
        for j, start in enumerate(range(0, WIDE // 8, step)):
            turned = np.ascontiguousarray(np.roll(own, -start, 1))
            head = turned[:, :4].copy().view("<u4")[:, 0].astype(np.int64) & ((1 << bits) - 1)
            yield (k * (WIDE // 8 // step) + j << 32) | head, turned


def _candidates(nodes: DataFrame, scratch: Scratch, block: int, segments: tuple[int, int, int], name: str) -> DataFrame:
    """(u, v, apart) between node numbers, u < v: spanning ones, or, where the nodes have a class, all between different classes."""
    classed = ["class"] if "class" in nodes.columns else []
    kept = ["node", "fp", *classed]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                fps = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, WIDE // 8)
                for keys, turned in segment_keys(fps, *segments):
                    offsets = pa.py_buffer((np.arange(len(fps) + 1) * (WIDE // 8)).astype(np.int32))
                    fp = pa.Array.from_buffers(pa.binary(), len(fps), [None, offsets, pa.py_buffer(turned)])
                    yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0), fp, *part.columns[2:]], names=["k", *kept])

    keyed = nodes.select(*kept).mapInArrow(deal, "k long, node long, fp binary" + ", class long" * len(classed))
    groups = _dealt(keyed, scratch, block, f"large{name}", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.cumsum(np.diff(np.asarray(batch.column(1).offsets)))
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(held // 50_000)) + 1):  # what is compared at once is bounded
                own = batch.slice(int(part[0]), len(part)) if len(part) else batch.slice(0, 0)
                lists = own.column(1)
                flat, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets)).astype(np.int64)
                fps = np.frombuffer(b"".join(flat.field(1).to_pylist()), "<u8").reshape(-1, WIDE // 64)
                found = group_edges(np.asarray(flat.field(0)), fps, sizes, np.asarray(flat.field(2)) if classed else None)
                if found:
                    u, v, d = np.array(found, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d)], names=["u", "v", "apart"])

    return groups.mapInArrow(run, "u long, v long, apart long").distinct()


def _similar(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, scratch: Scratch, shingle: int, similarity: float, text: str, name: str = "") -> DataFrame:
    """Those (u, v) of ``pairs`` whose shingle sets are as similar as asked for. Only texts of such pairs are read again."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    some = scratch.write(nodes.select("node", "text_key").join(ends, "node"), f"borderline{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(keys: list, sets: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["text_key", "hashes"])

        for b in batches:
            keys, sets, held = [], [], 0
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys.append(k)
                sets.append(np.unique(shingle_hashes(x.as_py(), shingle)).view(np.int64))
                held += len(sets[-1])
                if held > 1 << 18:
                    yield batch(keys, sets)
                    keys, sets, held = [], [], 0
            if keys:
                yield batch(keys, sets)

    slim = docs.select(_text_key(text).alias("text_key"), col(text).alias("text"))
    sets = small_side(slim, some.select("text_key"), "text_key", "left_semi").mapInArrow(run, "text_key long, hashes array<long>").dropDuplicates(["text_key"])
    sets = scratch.write(sets.join(some, "text_key").select("node", "hashes"), f"sets{name}")
    a, b = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"{n}_set")) for n in ("u", "v"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v")
    same = F.size(F.array_intersect("u_set", "v_set"))
    return both.filter(same >= F.lit(similarity) * (F.size("u_set") + F.size("v_set") - same)).select("u", "v")


def near_copies(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id", block: int = BLOCK, scratch: Scratch | None = None, segments: tuple[int, int, int] | None = None) -> DataFrame:
    """Per row: doc_id, text_key and class (a number), by Jaccard similarity of shingle sets."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.write(_wide(docs, shingle, text, key), "wide")
    # A node's number is only ever read from the written table, where it is fixed.
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("text_key").alias("text_key")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    segments = segments or segments_for(nodes.count())
    found = scratch.write(_candidates(nodes, scratch, block, segments, "1"), "candidates")
    close = _similar(docs, found.filter(F.col("apart") > SURE), nodes, scratch, shingle, similarity, text)
    links = scratch.write(found.filter(F.col("apart") <= SURE).select("u", "v").unionByName(close), "links")
    classes = scratch.write(_classes(nodes, stars(links, scratch)), "first_classes")
    # Where a spanning candidate failed, others may connect what it would have: all between different classes are compared.
    a, b = (classes.select(F.col("node").alias(n), F.col("class").alias(f"{n}_class")) for n in ("u", "v"))
    failed = found.join(a, "u").join(b, "v").filter("u_class <> v_class").select("u", "v")
    if failed.head(1):
        spans = scratch.write(_classes(nodes, stars(found.select("u", "v"), scratch, "spans")), "spans")
        where = scratch.write(failed.select(F.col("u").alias("node")).join(spans, "node").select("class").distinct(), "where")
        again = spans.join(where, "class").select("node").join(nodes.select("node", "fp"), "node").join(classes, "node")
        more = _candidates(scratch.write(again, "again"), scratch, block, segments, "2").join(found.select("u", "v"), ["u", "v"], "left_anti")
        more = scratch.write(more, "more")
        late = _similar(docs, more.filter(F.col("apart") > SURE), nodes, scratch, shingle, similarity, text, "2")
        links = scratch.write(links.unionByName(more.filter(F.col("apart") <= SURE).select("u", "v")).unionByName(late), "all_links")
        classes = _classes(nodes, stars(links, scratch, "last"))
    named = scratch.write(nodes.select("node", "fp").join(classes, "node").select("fp", "class"), "named")
    return rows.join(named, "fp").select("doc_id", "text_key", "class")


def _classes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, class) of all nodes."""
    return nodes.select("node").join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("class"))


def keep_first(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of near copies."""
    scratch = Scratch(docs.sparkSession)
    named = scratch.write(near_copies(docs, shingle, similarity, text, key, scratch=scratch).groupBy("class", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    firsts = scratch.write(named.groupBy("class").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("class", "first"), "firsts")
    gone = named.join(firsts, "class").filter(order != F.col("first")).select("doc_id", "text_key")
    again = named.join(firsts, "class", "left").filter(F.col("first").isNull() | (order == F.col("first"))).filter("n > 1").select("doc_id", "text_key")
    id_name, text_name, n = (free_name(docs, f"tf_{x}") for x in ("id", "text_key", "n"))
    out = scratch.write(gone.withColumn("n", F.lit(0)).unionByName(again.withColumn("n", F.lit(1))).toDF(id_name, text_name, n), "gone")
    scratch.drop("large1", "large2", "nodes", "candidates", "borderline", "borderline2", "sets", "sets2", "links", "all_links", "first_classes", "spans", "where", "again", "more", "firsts", "named", "wide")
    marked = docs.withColumn(text_name, _text_key(text)).withColumn(id_name, col(key).cast("long"))
    left = small_side(marked, out.drop(n), [id_name, text_name], "left_anti").select(*map(col, docs.columns))
    if not out.filter(col(n) == 1).head(1):
        return left
    # Rows that share id and text: one of them stays, whatever their other columns.
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    twins = small_side(marked, out.filter(col(n) == 1).drop(n), [id_name, text_name], "left_semi")
    one = twins.groupBy(col(id_name), col(text_name)).agg(F.min_by(F.struct(*map(col, docs.columns)), F.xxhash64(*map(col, plain))).alias("row"))
    return left.unionByName(one.select("row.*"))
