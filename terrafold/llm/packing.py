"""Best-fit packing by a configuration linear program over the length histogram.

1. Every text is encoded once; each document becomes pieces of at most ``capacity`` ids. The pieces (no ids,
   only lengths and checksums) are a table in the shared folder, numbered per (task, length).
2. The histogram has at most ``capacity`` lengths, however many documents there are. Over it the driver solves
   the configuration program: cover every length's count with as few sequences as possible, each sequence a configuration
   (how many pieces of which lengths). Prices per length fall by multiplicative weights as the length gets covered; knapsack dynamic
   programming gives the best total price of every room, so one table prices, for each length, the best configuration that
   holds it. A round raises the target coverage by 1 / ``STEPS``; configurations within ``LOSS`` of the best price are used fractionally until
   all lengths reach it. Prices divided by the best sequence's price are a dual solution: a lower bound. Uses are rounded
   down; what this leaves is solved again in whole uses, at first without loss, and what no priced configuration holds is packed best fit.
3. A plan row says: the pieces of one length ranked from..to fill these sequences at this offset. The rank of a
   piece is its number within its task and length plus the pieces of that length in earlier tasks: a small
   join and no sort of documents, so a length that a third of all pieces share costs no more than another.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by one; other columns
play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Scratch, col

CAPACITY = 4096
END_ID = 1
#: Rounds until all lengths should be covered (a few more are made for those that lag), the share of the best price
#: that a configuration may lack, and how fast prices fall: over a full coverage by as much as that.
STEPS, LOSS, RATE = 8, 1 / 1024, 1 / 1024


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of a length within a task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(body.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(col(key).cast("long").alias("doc_id"), col(text).alias("text")).mapInArrow(cut, schema)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The best total price for each room up to ``capacity``: dynamic programming, any number of each length."""
    value = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if k := upto[room]:
            value[room] = max(value[room], (value[room - lengths[:k]] + prices[:k]).max())
    return value


def _filled(first: int, lengths: np.ndarray, prices: np.ndarray, value: np.ndarray, need: np.ndarray, least: float, slack: float) -> dict[int, int]:
    """A configuration (place of a length -> how many) that holds ``first`` and lacks at most ``slack`` of the best such price.

    Of the lengths that keep it and are still needed the longest goes first: short ones are worth more in what remains.
    """
    used, room = {first: 1}, len(value) - 1 - int(lengths[first])
    while room > 0 and value[room] > 0:
        k = int(np.searchsorted(lengths, room, side="right"))
        lost = value[room] - prices[:k] - value[room - lengths[:k]]
        near = (lost <= slack) & (need[:k] >= least)
        for i, many in used.items():
            if i < k and need[i] < least * (many + 1):
                near[i] = False
        pick = np.flatnonzero(near)
        if not len(pick):
            break
        i = int(pick[-1])
        slack -= max(0.0, float(lost[i]))
        used[i] = used.get(i, 0) + 1
        room -= int(lengths[i])
    return used


def _sweep(lengths: np.ndarray, need: np.ndarray, prices: np.ndarray, capacity: int, least: float, loss: float, uses: dict) -> float:
    """Uses configurations near the best price until no length that is needed has one; lowers ``need``. Gives the best price."""
    value = knapsack(lengths, prices, capacity)
    floor = value[capacity] * (1 - loss) - 1e-9
    for first in range(len(lengths) - 1, -1, -1):
        reach = prices[first] + value[capacity - lengths[first]]
        while need[first] >= least and reach >= floor:
            used = _filled(first, lengths, prices, value, need, least, reach - floor)
            if sum(prices[i] * many for i, many in used.items()) < floor:
                break
            times = min(need[i] / many for i, many in used.items())
            times = int(times) if least == 1 else times
            for i, many in used.items():
                need[i] -= many * times
            filling = tuple((int(lengths[i]), many) for i, many in used.items())
            uses[filling] = uses.get(filling, 0) + times
    return float(value[capacity])


def fractional(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS, loss: float = LOSS, rate: float = RATE) -> tuple[dict[tuple, float], float]:
    """Configuration -> uses (fractions), and the lower bound of the number of sequences."""
    lengths = np.array(sorted(counts), np.int64)
    total = np.array([counts[int(x)] for x in lengths], np.float64)
    covered, uses, bound = np.zeros(len(lengths)), {}, 0.0
    for k in range(1, steps + steps // 2 + 1) if len(lengths) else ():
        prices = lengths / capacity * np.exp(-rate * covered / total)
        need = total * min(1, k / steps) - covered
        need[need < 1e-9 * total] = 0
        before = need.copy()
        best = _sweep(lengths, need, prices, capacity, 1 / steps, loss, uses)
        bound = max(bound, float((total * prices).sum()) / best)
        covered += before - need
        if not need.any() and k >= steps:
            break
    return uses, bound


def configurations(counts: dict[int, int], capacity: int = CAPACITY, facts: dict | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, how many)])] that uses every counted piece exactly once.

    ``facts`` receives the program's lower bound and the shares of ids that the rounded program, its whole uses and best fit place.
    """
    uses, bound = fractional(counts, capacity)
    plan, left = [(int(x), list(filling)) for filling, x in uses.items() if x >= 1], dict(counts)
    for times, filling in plan:
        for length, many in filling:
            left[length] -= times * many
    ids = sum(a * n for a, n in counts.items()) or 1
    rounded = sum(a * n for a, n in left.items())
    for loss in (0, LOSS / 4, LOSS, 4 * LOSS):
        rest = sum(a * n for a, n in left.items())
        while rest:
            lengths = np.array(sorted(a for a, n in left.items() if n), np.int64)
            need, own = np.array([left[int(a)] for a in lengths]), {}
            _sweep(lengths, need, lengths / capacity, capacity, 1, loss, own)
            plan += [(times, list(filling)) for filling, times in own.items()]
            left |= dict(zip(lengths.tolist(), need.tolist(), strict=True))
            was, rest = rest, sum(a * n for a, n in left.items())
            if was - rest < was / 50:
                break
    if facts is not None:
        rest = sum(a * n for a, n in left.items())
        facts |= {"bound": bound, "rounded": 1 - rounded / ids, "whole": (rounded - rest) / ids, "best_fit": rest / ids}
    return plan + best_fit({a: n for a, n in left.items() if n}, capacity)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on a histogram: sequences with the same filling are one group with a count."""
    room: dict[int, list[tuple[int, tuple]]] = {}
    free: list[int] = []

    def put(space: int, times: int, filling: tuple) -> None:
        if space not in room:
            room[space] = []
            bisect.insort(free, space)
        room[space].append((times, filling))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect.bisect_left(free, length)
            if i == len(free):
                per = capacity // length
                if n >= per:
                    put(capacity - per * length, n // per, ((length, per),))
                    n %= per
                else:
                    put(capacity - n * length, 1, ((length, n),))
                    n = 0
                continue
            space = free[i]
            times, filling = room[space].pop()
            if not room[space]:
                del room[space]
                free.pop(i)
            per = min(space // length, n)
            use = min(times, n // per)
            if use < times:
                put(space, times - use, filling)
            put(space - per * length, use, (*filling, (length, per)))
            n -= per * use
    return [(times, list(filling)) for groups in room.values() for times, filling in groups]


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Plan rows sorted by (length, from): length, from, each, first sequence, offset."""
    rows, used, sequence = [], {}, 0
    for times, filling in plan:
        offset = 0
        for length, each in filling:
            first = used.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            used[length] = first + times * each
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.write(pieces(docs, tokenizer, capacity, end_id, text, key), "pieces")
    tallies = scratch.write(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "tallies")
    counts = {r.length: r.n for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = slots(configurations(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tallies.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Merged, never broadcast: ``base`` has up to ``capacity`` rows a task. No text is in either table.
    ranked = cut.join(base.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 48 | table[:, 1]  # fewer than 2^48 pieces of one length
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            turn, nth = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + turn), pa.array(row[:, 4] + nth * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
