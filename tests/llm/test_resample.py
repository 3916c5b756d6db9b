"""Importance resampling against a plain version; the CSR matrix against counters."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terrafold.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def buckets(text, n=10_000):
    w = WORD.findall(lower(text or ""))
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in (1, 2) for i in range(len(w) - k + 1))


def slow(rows, target):
    s, t = Counter(), Counter()
    own = [buckets(x) for _, x in rows]
    for c in own:
        s.update(c)
    for x in target:
        t.update(buckets(x))
    many, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (many + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in range(10_000)]
    out = []
    for (i, _), c in zip(rows, own, strict=True):
        n = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = [r for r in out if r[1] >= 39]
    long.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(long[: 25 * len(long) // 100], 1):
        r[4] = k
    return sorted(map(repr, map(tuple, out)))


@pytest.fixture(scope="module")
def target(spark, rows):
    rng = random.Random(9)
    return [" ".join(rng.sample([w for _, t, *_ in rows[:40] for w in t.split()], 40)) for _ in range(30)] + [None, ""]


def test_operator(spark, docs, rows, empty, odd, target):
    wanted = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(target)], "item_id string, text string")
    want = slow([(i, t) for i, t, *_ in rows], target)
    for block in (1 << 20, 500):
        got = resample.resample(docs, wanted, block=block)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert resample.resample(empty, wanted).count() == 0
    assert resample.resample(odd, wanted).count() == 2
    nothing = wanted.limit(0)
    assert sorted(repr(tuple(r)) for r in resample.resample(docs, nothing).collect()) == slow([(i, t) for i, t, *_ in rows], [])


def test_ties_and_repeated_rows(spark):
    """Equal scores: rows of one text and one id; ranks are still 1, 2, 3 and so on, smaller ids first."""
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text)] * 40 + [(k, text) for k in range(40)] + [(None, text)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = resample.resample(df, df).collect()
    drawn = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, 22))
    assert sorted(repr(tuple(r)) for r in got) == slow(rows, [text] * len(rows))


def test_counts_in_steps(monkeypatch):
    """Long texts come in parts: runs of words over the edges count once, words are never cut."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Über", "a", "B2b", "漢字", "x" * 70]) for _ in range(rng.randint(0, 400))) for _ in range(20)] + ["A" * 5000, "", "--", "one"]
    for step in (7, 64, 1 << 20):
        monkeypatch.setattr(resample, "STEP", step)
        doc, bucket, count, features = resample.counted([t.encode() for t in texts], 97)
        got = [Counter() for _ in texts]
        for d, b, c in zip(doc.tolist(), bucket.tolist(), count.tolist(), strict=True):
            got[d][b] = c
        assert got == [buckets(t, 97) for t in texts]
        assert features.tolist() == [sum(c.values()) for c in got]


def test_joined_crc():
    rng = random.Random(1)
    a, b = ([rng.randbytes(rng.randint(0, 300)) for _ in range(500)] for _ in range(2))
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert (resample.joined_crc(crc(a), crc(b), np.array([len(x) for x in b])) == crc([x + y for x, y in zip(a, b, strict=True)])).all()


def test_blocks_are_bounded(spark, docs, rows):
    found = resample.blocks(docs, block=500).collect()
    sizes = {i: len((t or "").encode()) for i, t, *_ in rows}
    assert sum(len(r.ids) for r in found) == len(rows)
    for r in found:
        assert len(r.ids) == 1 or sum(sizes[i] if i is not None else 0 for i in r.ids) <= 500
        assert r.starts[0] == 0 and r.starts[-1] == len(r.buckets) == len(r.counts) and len(r.starts) == len(r.ids) + 1


def test_packed_blocks(spark, docs):
    """The table of blocks holds bytes, in small pages, and gives the sums of the lists."""
    lists, packed = resample.blocks(docs, block=500), resample.blocks(docs, block=500, packed=True)
    assert [t for _, t in packed.dtypes][1:] == ["binary"] * 4
    want = Counter()
    for r in lists.collect():
        want.update(dict.fromkeys(r.buckets, 0))
        for b, n in zip(r.buckets, r.counts, strict=True):
            want[b] += n
    assert {r.bucket: r.n for r in resample.column_sums(packed).collect()} == dict(want)
    x = np.array([0, 70_000, 3])
    assert resample._numbers(resample._bytes(x), 3).tolist() == x.tolist() and resample._numbers(b"", 0).tolist() == []
