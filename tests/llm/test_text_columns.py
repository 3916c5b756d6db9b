"""Columns of texts against an unmodified tokenizer, and what encoding and cutting them costs in lookups."""

import random

import numpy as np
import pyarrow as pa
import pytest

from terrafold.llm import bpe, idstore

from .test_bpe import NAMES, PARTS

P = pytest.importorskip("public_tokenizers")
MARKED = [*PARTS, "×", "÷", "ÿ", "À", "Ã", "$", "&&&", "***", "(", ")", "/", "don't", "it's.", "a.b", "É.", "'re", "''s", "~", "^", "`", "%", "ñ##"]


@pytest.mark.parametrize("name", NAMES)
def test_random_columns(name):
    from tokenizers import Tokenizer

    plain, enc, rng = Tokenizer.from_file(P.path(name)), bpe.Encoder(P.path(name)), random.Random(8)
    for _ in range(200):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(MARKED if rng.random() < 0.7 else PARTS[:45]) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 60))]
        column = pa.array(["another  ", *texts], pa.string())[1:]
        assert [x.tolist() for x in enc.column(column)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("texts", [[], [None], [""], [None, "", None], ["", "a"], [" ", "\n", "  \n"]])
def test_little_columns(texts):
    enc = bpe.Encoder(P.path("byte_bpe_50k.json"))
    assert [x.tobytes() for x in enc.column(pa.array(texts, pa.string()))] == [enc.encode(t) for t in texts]


def test_a_piece_is_looked_up_once():
    class Counting(bpe.Encoder):
        seen = 0

        def __getitem__(self, piece):
            self.seen += 1
            return super().__getitem__(piece)

    enc = Counting(P.path("byte_bpe_50k.json"))
    enc.column(pa.array(["thable erin, erin *** thable. thableé$$$ erin"] * 500))
    assert enc.seen <= 9  # "thable", " erin", ",", " ***", " thable", ".", " thableé", "$$$" in 4,500 places
    assert " erin," not in enc and " thable." not in enc


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr(idstore, "TOGETHER", 100)
    rng = random.Random(3)
    for _ in range(200):
        texts = [None if rng.random() < 0.2 else "x" * rng.choice([0, 1, 30, 99, 100, 450]) for _ in range(rng.randint(0, 20))]
        found = list(idstore._slices(pa.array(texts, pa.string())))
        assert [k for a, b in found for k in range(a, b)] == list(range(len(texts)))
        assert all(sum(len(t or "") for t in texts[a + 1 : b]) <= 100 for a, b in found)


def test_cuts_are_those_of_the_plain_sum():
    rng = np.random.default_rng(4)
    for n in (65, 66, 80, 700, 60_000):
        ids = rng.integers(0, 50_000, n).astype("<u4")
        values = idstore.GEAR[ids]
        rolled = sum(np.concatenate([np.zeros(k, np.uint64), values[: n - k] << np.uint64(3 * k)]) for k in range(idstore.WINDOW))
        at = set((np.flatnonzero((rolled & idstore.CUT_MASK) == 0) + 1).tolist())
        ends, last = [], 0
        for k in range(1, n + 1):
            if k == n or k - last == idstore.MAX_CHUNK or k - last >= idstore.MIN_CHUNK and k in at:
                ends.append(k)
                last = k
        assert idstore.cuts(ids) == ends


@pytest.mark.parametrize("together", [1, 1000, 8 << 20])
def test_ids_do_not_depend_on_slices(rows, monkeypatch, together):
    from tokenizers import Tokenizer

    monkeypatch.setattr(idstore, "TOGETHER", together)
    plain, enc = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.Encoder(P.path("byte_bpe_50k.json"))
    texts = pa.array([r[1] for r in rows], pa.string())
    found = [x.tolist() for a, b in idstore._slices(texts) for x in enc.column(texts[a:b])]
    assert found == [plain.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
