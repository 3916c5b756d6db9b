"""Toxicity by a factorization machine over hashed terms.

A document's terms are its different words (lower case, without marks at their ends) and their beginnings of 5,
6 and 7 letters, hashed into ``DIMS`` places. From the labelled training rows (never those that are held out)
at most ``SAMPLE`` are taken, by a hash of their id. Over them each task counts places by label. Every place that tells the
labels apart alone (G-squared of at least ``LEAST_GAIN``) goes into the machine

    logit = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

with a weight per place and a vector per place, whose products weigh pairs of terms (an insult and a group's
mention together). A term may matter only together with another: what the fitted machine leaves unexplained is tested for
all pairs of places that ``COMMON`` of the rows hold or more (a score test on the residuals), the places of pairs beyond
``PAIR_SCORE`` deviations are added and the machine is fitted again. The fit runs on the driver, on at most SAMPLE rows of
numbers; scoring reads every whole text in one pass, without a shuffle.

Labels, language, source and id are never inputs of a score. Defined results: a null or empty text has no
terms and the score of that; without training rows of both labels every score is the share of toxic ones (0
without any); a null doc_id counts as the empty string when rows are held out; a document labelled twice is
used once per label; of documents that share an id one is fitted on; repeated rows each get a row; other columns pass no part; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col

#: Bound of the labelled rows that the machine is fitted on.
SAMPLE = 20_000
DIMS = 1 << 18
#: Least G-squared of a place that is kept for itself.
LEAST_GAIN = 6.0
#: Least share of rows that hold a place tested in pairs, and the least score of a pair whose places are kept.
COMMON, PAIR_SCORE = 0.02, 7.0
RANK = 8
STARTS = (5, 6, 7)
#: Words whose places a worker keeps.
MEMO = 400_000
_MARKS = " \t\r\n.,;:!?\"'()[]{}<>|*#$%&-_/\\`~+=@^"


class Places(dict):
    """Word -> its places as 32-bit integers; ``number`` maps a place to a kept term's number (or -1)."""

    def __init__(self, number: np.ndarray | None = None):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> bytes:
        from xxhash import xxh32_intdigest

        own = word.strip(_MARKS)
        terms = {own} | {own[:n] + "\0" for n in STARTS if len(own) >= n} if own else set()
        places = np.array([xxh32_intdigest(t.encode("utf-8", "surrogatepass")) % DIMS for t in terms], np.int32)
        if self.number is not None:
            places = self.number[places]
            places = places[places >= 0]
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = places.astype("<i4").tobytes()
        return value

    def of(self, text: str | None) -> np.ndarray:
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set((text or "").lower().split()))), "<i4"))


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Machine:
    """A fitted factorization machine: kept places, bias, weights and vectors."""

    def __init__(self, places: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.places, self.bias, self.weights, self.vectors = places, bias, weights, vectors

    def number(self) -> np.ndarray:
        out = np.full(DIMS, -1, np.int32)
        out[self.places] = np.arange(len(self.places), dtype=np.int32)
        return out

    def logit(self, terms: np.ndarray) -> float:
        v = self.vectors[terms]
        s = v.sum(0)
        return float(self.bias + self.weights[terms].sum() + 0.5 * (s @ s - (v * v).sum()))


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, rank: int = RANK, epochs: int = 60, batch: int = 256, rate: float = 0.05, decay: float = 1e-4, slow: float = 0.05, pair_decay: float = 1e-3, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by Adam on the logistic loss; rows are arrays of term numbers."""
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float64)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    theta = np.zeros((n_terms, rank + 1))
    theta[:, 1:] = rng.normal(0, 0.02, (n_terms, rank))
    bias = math.log(share / (1 - share))
    # Weights settle first; the vectors, which move more slowly and are held smaller, explain what is left.
    pace = np.full(rank + 1, rate * slow)
    pace[0] = rate
    m, v, mb, vb, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = order[at : at + batch]
            sizes = np.fromiter((len(rows[k]) for k in own), np.int64, len(own))
            at_row, terms = np.repeat(np.arange(len(own)), sizes), np.concatenate([rows[k] for k in own])

            def summed(x: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
                return np.stack([np.bincount(by, c, n).astype(np.float64) for c in x.T], 1)  # without rows it counts in integers

            got = summed(theta[terms], at_row, len(own))
            s = got[:, 1:]
            squares = np.bincount(at_row, (theta[terms, 1:] ** 2).sum(1), len(own))
            z = bias + got[:, 0] + 0.5 * ((s * s).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
            grad = summed((g[:, None] * np.concatenate([np.ones((len(own), 1)), s], 1))[at_row], terms, n_terms)
            grad[:, 1:] += (pair_decay - grad[:, :1]) * theta[:, 1:]
            grad[:, 0] += decay * theta[:, 0]
            gb = float(g.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            a, b = 1 - 0.9**step, 1 - 0.999**step
            theta -= pace * (m / a) / (np.sqrt(v / b) + 1e-8)
            bias -= rate * (mb / a) / (math.sqrt(vb / b) + 1e-8)
    return bias, theta[:, 0].copy(), theta[:, 1:].copy()


def _g2(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """G-squared of presence against label."""
    def part(k: np.ndarray, n: int, share: np.ndarray) -> np.ndarray:
        return k * np.log((k + 1e-9) / (n * share + 1e-9)) + (n - k) * np.log((n - k + 1e-9) / (n * (1 - share) + 1e-9))

    share = (pos + neg) / (n_pos + n_neg)
    return part(pos, n_pos, share) + part(neg, n_neg, share)


def pair_terms(rows: list[np.ndarray], left: np.ndarray, spread: np.ndarray, n_terms: int, least: float = PAIR_SCORE, block: int = 256) -> np.ndarray:
    """Terms of pairs whose joint presence goes with the residuals: |sum r x_i x_j| of ``least`` deviations or more.

    ``left`` has the residuals y - p and ``spread`` the variances p (1 - p). A block of terms at a time: 4 * block bytes a row.
    """
    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, term) pairs, some rows at a time."""
        for at in range(0, len(rows), 1000):
            own = rows[at : at + 1000]
            yield np.repeat(np.arange(at, at + len(own), dtype=np.int32), [len(t) for t in own]), np.concatenate(own)

    # A pair's score is at most what either term reaches alone, and no bound is below ``least``.
    reach = np.zeros(n_terms)
    for row, term in parts():
        reach += np.bincount(term, np.abs(left)[row], n_terms)
    alive = np.flatnonzero(reach >= least)
    own = np.full(n_terms, -1, np.int32)
    own[alive] = np.arange(len(alive), dtype=np.int32)
    kept = [(row[own[term] >= 0], own[term][own[term] >= 0]) for row, term in parts()]
    row, term = (np.concatenate([np.empty(0, np.int32), *(k[i] for k in kept)]) for i in (0, 1))
    del kept
    n_terms = len(alive)
    order = np.argsort(term, kind="stable")
    row, term = row[order], term[order]

    def part(first: int) -> np.ndarray:
        own = slice(*np.searchsorted(term, [first, first + block]))
        x = np.zeros((len(rows), min(block, n_terms - first)), np.float32)
        x[row[own], term[own] - first] = 1
        return x

    hit = np.zeros(n_terms, bool)
    r, v = left.astype(np.float32)[:, None], spread.astype(np.float32)[:, None]
    for a in range(0, n_terms, block):
        x = part(a)
        moved, wide = (x * r).T, (x * v).T
        for b in range(a, n_terms, block):
            y = x if a == b else part(b)
            strong = np.abs(moved @ y) >= least * np.sqrt(wide @ y + 1)
            if a == b:
                np.fill_diagonal(strong, False)
            hit[a : a + len(x.T)] |= strong.any(1)
            hit[b : b + len(y.T)] |= strong.any(0)
    return alive[hit]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine from the labelled documents that are not held out."""
    scratch = Scratch(docs.sparkSession)
    usable = labels.select(col(key).cast("long").alias("id"), col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out("id"))
    # A document may lack a label and a label its document; the bound holds for the label rows taken.
    chosen = usable.withColumn("turn", F.xxhash64("id")).orderBy("turn", "id", "y").limit(sample).select("id", "y")
    chosen = scratch.write(chosen, "chosen")
    joined = docs.select(col(key).cast("long").alias("id"), col(text).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` rows of 12 bytes

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Places()
        for b in batches:
            ids, ys, texts = (b.column(b.schema.get_field_index(c)) for c in ("id", "y", "text"))
            yield pa.RecordBatch.from_arrays([ids, ys, pa.array([memo.of(x.as_py()) for x in texts], pa.list_(pa.int32()))], names=["id", "y", "places"])

    # One row a label row: documents that share an id would else be without a bound (the smallest of their terms is taken).
    rows = scratch.write(joined.mapInArrow(places, "id long, y int, places array<int>").groupBy("id", "y").agg(F.min("places").alias("places")), "rows")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, DIMS + 1), np.int64)
        for b in batches:
            for y, own in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen[y, np.asarray(own.values)] += 1
                seen[y, DIMS] += 1
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], names=["place", "neg", "pos"])

    sums = rows.select("y", "places").mapInArrow(tally, "place long, neg long, pos long").groupBy("place").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    sums = sums.filter((F.col("neg") + F.col("pos") >= 3) | (F.col("place") == DIMS)).toArrow().to_pandas()  # at most DIMS rows
    whole = sums[sums.place == DIMS]
    n_neg, n_pos = (int(whole[c].sum()) for c in ("neg", "pos"))
    if not n_neg or not n_pos:
        share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.0
        return Machine(np.empty(0, np.int64), 50.0 if share == 1 else -50.0, np.zeros(0), np.zeros((0, RANK)))
    own = sums[sums.place < DIMS]
    gain = _g2(own.pos.to_numpy(float), own.neg.to_numpy(float), n_pos, n_neg)
    own = own.assign(gain=gain).sort_values("place")
    own = own[(own.gain >= LEAST_GAIN) | (own.neg + own.pos >= COMMON * (n_neg + n_pos))]
    kept, alone = own.place.to_numpy(), own.gain.to_numpy() >= LEAST_GAIN
    number = np.full(DIMS, -1, np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x[x >= 0] for x in (number[np.asarray(own.values)] for own in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "y", "terms"])

    fitted = rows.mapInArrow(renumber, "id long, y int, terms array<int>").toArrow().combine_chunks()  # at most `sample` rows
    ids, y = (fitted.column(c).to_numpy() for c in ("id", "y"))
    order = np.lexsort((y, ids))  # a row per id and label
    lists = fitted.column("terms").chunk(0) if len(fitted) else pa.array([], pa.list_(pa.int32()))
    flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
    x, y = [flat[ends[k] : ends[k + 1]] for k in order.tolist()], y[order]

    def fit(terms: np.ndarray) -> tuple[Machine, list[np.ndarray]]:
        own = np.full(len(kept), -1)
        own[terms] = np.arange(len(terms))
        rows = [r[r >= 0] for r in (own[t] for t in x)]
        return Machine(kept[terms], *fit_machine(rows, y, len(terms))), rows

    first = np.flatnonzero(alone)
    machine, rows_ = fit(first)
    p = 1 / (1 + np.exp(-np.clip([machine.logit(r) for r in rows_], -30, 30)))
    more = pair_terms(x, y - p, p * (1 - p), len(kept))
    if len(np.setdiff1d(more, first)):
        machine, _ = fit(np.union1d(first, more))
    scratch.drop("rows", "chosen")
    return machine


def score(docs: DataFrame, machine: Machine, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1."""
    number, where, kinds = machine.number(), docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Places(number)
        for b in batches:
            scores = [1 / (1 + math.exp(-min(max(machine.logit(memo.of(x.as_py())), -50), 50))) for x in b.column(where)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, type(kinds)([*kinds.fields]).add(name, "double"))


def rate(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    machine = train(docs, labels, text, key, label)
    scored = score(docs.select(col(key).cast("long").alias("doc_id"), col(text).alias("text")), machine)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``docs`` without those that the machine takes for toxic."""
    from .common import free_name

    name = free_name(docs, "tf_score")
    return score(docs, train(docs, labels, text, key, label), name, text).filter(col(name) < 0.5).drop(name)
