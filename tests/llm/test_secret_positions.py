"""Texts with many matches: positions by blocks equal those of a plain search, and the work grows with the text."""

import random
import re
import time

from terrafold.llm import secrets


def text(rng, n):
    parts = ["password=" + "q" * 9, "AKIA" + "Z" * 16, "".join(rng.choices("0123456789abcdef", k=32)), "é", "token: short", "pin=1", "\n"]
    return " ".join(rng.choice(parts) for _ in range(n))


def test_many_matches_of_all_kinds(spark):
    rng = random.Random(4)
    texts = [text(rng, n) for n in (0, 1, secrets.WALK - 1, secrets.WALK, secrets.WALK + 1, 3 * secrets.WALK, 9_000)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m.group(1)) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t)] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
        base = [f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in sorted(spans)]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("link")] == base


def test_a_text_of_ten_megabytes(spark):
    rng = random.Random(1)
    took = []
    for n in (30_000, 300_000):
        own = " ".join("".join(rng.choices("0123456789abcdef", k=32)) for _ in range(n))
        start = time.time()
        r = secrets.scan(spark.createDataFrame([(1, own)], "doc_id long, text string")).collect()[0]
        took.append(time.time() - start)
        assert r.n_hex == n and r.spans.startswith("hex:0:32,hex:33:65") and r.spans.endswith(f"hex:{33 * (n - 1)}:{33 * n - 1}")
    assert took[1] < 40 * max(took[0], 1.0)
