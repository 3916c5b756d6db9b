"""Pairs of terms: learned end to end where only they carry the label, and summed as the formula says."""

import random

import numpy as np

from terrafold.llm import toxicity


def test_only_a_pair_carries_the_label(spark):
    """Toxic if exactly one of two words is there: each alone says nothing."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(3000):
        words = [rng.choice(["the", "of", "and", "reon", "able", "inst", "oure"]) for _ in range(rng.randint(3, 12))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["zig"] * a + ["zag"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a != b)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.rate(docs, marks).collect()}
    held = [found[i].predicted == y for i, y in labels if found[i].held_out]
    assert np.mean(held) > 0.95


def test_logit_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    w, v = rng.normal(size=9), rng.normal(size=(9, 4))
    machine = toxicity.Machine(np.arange(9), 0.3, w, v)
    for _ in range(20):
        x = np.flatnonzero(rng.random(9) < 0.5)
        want = 0.3 + w[x].sum() + sum(v[i] @ v[j] for i in x for j in x if i < j)
        assert abs(machine.logit(x) - want) < 1e-9


def test_pair_terms_equal_brute_force():
    rng = np.random.default_rng(5)
    x = rng.random((400, 30)) < 0.4
    r = np.where(x[:, 3] & x[:, 17], 0.9, -0.1) + rng.normal(0, 0.2, 400)
    v = np.full(400, 0.2)
    want = {i for i in range(30) for j in range(30) if i != j and abs((r * x[:, i] * x[:, j]).sum()) >= 7 * np.sqrt((v * x[:, i] * x[:, j]).sum() + 1)}
    rows = [np.flatnonzero(t) for t in x]
    assert {3, 17} <= want
    for block in (7, 512):
        assert set(toxicity.pair_terms(rows, r, v, 30, 7.0, block)) == want
    assert len(toxicity.pair_terms([], np.empty(0), np.empty(0), 0)) == 0


def test_very_long_text_and_clashing_names(spark, odd):
    docs = spark.createDataFrame([(1, "scum " + "word " * 400_000), (2, None), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted(r.doc_id for r in toxicity.rate(docs, none).collect()) == [1, 2, 3]
    assert toxicity.rate(odd, none).count() == 2
