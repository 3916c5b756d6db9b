"""The pipeline's near-duplicate stage: five-word shingles, Jaccard similarity of 0.8 or more."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import simhash

from .conftest import DOCS, prose


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else prose(rng, 1) for w in text.split())


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        own = prose(rng, rng.choice([40, 120, 400]))
        texts += [own] + [edited(rng, own, rng.choice([0, 0.01, 0.02, 0.05, 0.3])) for _ in range(rng.randint(0, 5))]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3).cache()


def exact_pairs(texts):
    sets = [shingles(t) for t in texts]
    return [(i, j, len(a & sets[j]) / len(a | sets[j])) for i, a in enumerate(sets) for j in range(i) if a and sets[j]]


def test_classes_are_those_of_similar_texts(near):
    rows, docs = near
    texts = [r[1] for r in rows]
    pairs = exact_pairs(texts)
    for block in (4096, 8):
        found = {r.doc_id: r["class"] for r in simhash.near_copies(docs, block=block).collect()}
        similar = [(i, j) for i, j, s in pairs if s >= 0.8]
        assert len(similar) > 100
        assert np.mean([found[i] == found[j] for i, j in similar]) >= 0.97
        # a class holds nothing but what similar pairs connect
        near_to = defaultdict(set)
        for i, j in similar:
            near_to[i].add(j)
            near_to[j].add(i)
        members = defaultdict(set)
        for i, c in found.items():
            members[c].add(i)
        for own in members.values():
            seen, todo = set(), [min(own)]
            while todo:
                at = todo.pop()
                if at not in seen:
                    seen.add(at)
                    todo += near_to[at]
            assert own <= seen


def test_large_groups_equal_small_ones(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (6, 8), np.uint64)
    fps = []
    for b in base:
        for _ in range(50):
            own = np.unpackbits(b.view(np.uint8)).copy()
            own[16 + rng.choice(496, rng.integers(0, 60), replace=False)] ^= 1
            own[:16] = 0
            fps.append(np.packbits(own).view(np.uint64))
    fps = np.array(fps)

    def classes(edges):
        root = list(range(len(fps)))
        for u, v, _ in edges:
            a, b = root[u], root[v]
            root = [a if r == b else r for r in root]
        return root

    ask = (np.arange(len(fps)), fps, np.array([len(fps)]))
    monkeypatch.setattr(simhash, "SMALL", 1000)
    small = classes(simhash.group_edges(*ask))
    monkeypatch.setattr(simhash, "SMALL", 10)
    assert len(set(small)) == 6
    large = classes(simhash.group_edges(*ask))
    assert all((small[i] == small[j]) == (large[i] == large[j]) for i in range(len(fps)) for j in range(i))


def test_keep_first_loses_no_text(spark, empty, odd):
    rng = random.Random(2)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (8, c, "en", "s", 1), (9, c, "de", "s", 1), (3, c + " end", "en", "s", 1), (5, d, "en", "s", 1), (5, d, "de", "s", 2), (None, d, "en", "s", 1), (None, "", "en", "s", 0), (None, None, "en", "s", 0), (None, "solo", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_first(docs.repartition(3)).collect()), key=repr)
    assert [k for k in kept if k[1]] == sorted([(7, a), (7, b), (3, c + " end"), (5, d), (None, "solo")], key=repr)
    assert len([k for k in kept if not k[1]]) == 1
    assert simhash.keep_first(docs).collect() == simhash.keep_first(docs).collect()
    assert simhash.keep_first(empty).count() == 0
    assert simhash.keep_first(odd).collect() == odd.filter("doc_id = 1").collect()
    assert simhash.near_duplicates(odd).count() == 2


def test_long_text_is_folded_in_parts():
    hashes = np.random.default_rng(1).integers(0, 2**64, 70_000, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) * 2 > len(hashes)
    assert (np.unpackbits(simhash.majority(hashes).view(np.uint8), bitorder="little") == bits).all()


def test_no_text_is_shuffled_where_few_go(spark, near):
    _, docs = near
    plan = simhash.keep_first(docs.withColumn("n_chars", F.length("text").cast("long")))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "strategy=broadcast" in plan


@pytest.mark.parametrize("segments", [x[1:] for x in simhash.SEGMENTS])
def test_families_lose_no_candidate(spark, segments):
    """Families of edited texts: every two similar texts that some candidate connects end in one class."""
    rng = random.Random(21)
    texts, family = [], []
    for f in range(6):
        own = prose(rng, rng.choice([60, 150, 400]))
        for _ in range(25):
            texts.append(edited(rng, own, rng.choice([0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03])))
            family.append(f)
    similar = [(i, j) for i, j, s in exact_pairs(texts) if s >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r["class"] for r in simhash.near_copies(docs, segments=segments).collect()}
    fps = np.array([simhash.majority(simhash.shingle_hashes(t, 5), 8) for t in texts])
    meet = set()
    for keys, turned in simhash.segment_keys(fps.view(np.uint8), *segments):
        own = turned.view("<u8")
        by_key = defaultdict(list)
        for i, k in enumerate(keys.tolist()):
            by_key[k].append(i)
        meet |= {(i, j) for g in by_key.values() for i in g for j in g if j < i and len(simhash._apart(own, np.array([i]), np.array([j]))[0])}
    offered = [p for p in similar if p in meet]
    assert len(offered) >= 0.9 * len(similar) > 300
    assert all(got[i] == got[j] for i, j in offered)
    assert np.mean([got[i] == got[j] for i, j in similar]) > 0.95
    assert all(family[i] == family[j] for i in range(len(texts)) for j in range(i) if got[i] == got[j])
