"""The configuration program: dual bound, knapsack, shares, and never more sequences than best fit alone."""

import random
from collections import Counter

import numpy as np
import pytest

from terrafold.llm import packing


def histogram(seed, n, times=1):
    rng = random.Random(seed)
    return {k: v * times for k, v in Counter(min(4096, max(1, int(rng.lognormvariate(6.5, 1.2)))) for _ in range(n)).items()}


@pytest.mark.parametrize("counts", [histogram(2, 4000), histogram(2, 4000, 500), histogram(3, 60_000), {3000: 100, 2500: 50, 1500: 70, 1000: 90}, {4096: 5}, {2100: 40, 1: 3}])
def test_program(counts):
    facts = {}
    plan = packing.configurations(counts, facts=facts)
    used = Counter()
    for times, filling in plan:
        assert times > 0 and sum(a * n for a, n in filling) <= 4096
        for a, n in filling:
            used[a] += times * n
    assert used == counts
    sequences, alone = sum(t for t, _ in plan), sum(t for t, _ in packing.best_fit(counts))
    assert facts["bound"] - 1e-6 <= sequences <= alone
    assert facts["best_fit"] < 0.001 or len(counts) == 2  # prices know no counts: three single ids look like a filling
    if len(counts) > 100:
        assert sequences <= facts["bound"] * 1.0001 + 2 and facts["rounded"] > 0.3


def test_the_program_beats_best_fit():
    counts = histogram(2, 10_000, 3000)
    assert sum(t for t, _ in packing.configurations(counts)) < sum(t for t, _ in packing.best_fit(counts))


def test_fractional_solution_covers_and_keeps_the_bound():
    counts = histogram(5, 20_000)
    uses, bound = packing.fractional(counts)
    covered = Counter()
    for filling, x in uses.items():
        assert x > 0 and sum(a * n for a, n in filling) <= 4096
        for a, n in filling:
            covered[a] += n * x
    assert all(covered[a] <= n + 1e-6 for a, n in counts.items())
    assert sum(a * x for a, x in covered.items()) > 0.97 * sum(a * n for a, n in counts.items())
    assert bound >= sum(a * n for a, n in counts.items()) / 4096 * 0.999
    assert packing.fractional({}) == ({}, 0.0)


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 30, 5))
        prices = rng.random(len(lengths))
        best = [0.0] * 61
        for room in range(1, 61):
            best[room] = max([best[room - 1]] + [best[room - a] + p for a, p in zip(lengths.tolist(), prices.tolist(), strict=True) if a <= room])
        assert np.allclose(packing.knapsack(lengths, prices, 60), best)
