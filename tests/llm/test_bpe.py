"""Ids against an unmodified tokenizer: random texts, added tokens' strings, other files."""

import json
import random

import numpy as np
import pytest

from terrafold.llm import bpe

P = pytest.importorskip("public_tokenizers")
NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = ["a", "The", "word", "thanedble", "Éa", "ß", "İ", "Σ", "ſ", "é", "e\u0301", "\u0301", "日本", "語", "١٢", "12", "7", "'s", "'ll", "'", "’", ".", ",", "...", "!?", ";:", "-", "_", "#", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|endofText|>",
         " ", " ", " ", " ", "  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "\x00", "\x01", "😀", "\ufeff", "ŉ", "ǅ"]


@pytest.mark.parametrize("name", NAMES)
def test_random_texts(name):
    from tokenizers import Tokenizer

    plain, enc, rng = Tokenizer.from_file(P.path(name)), bpe.Encoder(P.path(name)), random.Random(8)
    assert enc.cuts and enc.words == name.startswith("word")
    for k in range(20_000):
        usual = rng.random() < 0.5  # half of them without rare characters
        text = "".join(rng.choice(PARTS[:45] if usual else PARTS) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, (k, text)


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens_are_the_librarys(name):
    enc = bpe.Encoder(P.path(name))
    want = {"byte_bpe_50k.json": [87, 220, 50256, 331], "word_bpe_49k.json": [343, 49407, 344]}[name]
    assert np.frombuffer(enc.encode("x <|endoftext|> y"), "<u4").tolist() == want


@pytest.mark.parametrize("name", NAMES)
def test_other_settings_go_whole(name, tmp_path):
    from tokenizers import Tokenizer

    said = json.load(open(P.path(name), encoding="utf-8"))
    said["normalizer"] = {"type": "Replace", "pattern": {"String": " a"}, "content": "b"}
    path = str(tmp_path / "other.json")
    json.dump(said, open(path, "w", encoding="utf-8"))
    enc, plain = bpe.Encoder(path), Tokenizer.from_file(path)
    assert not enc.cuts
    for text in ("x a y", "some words, and more a a", ""):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_very_long_text(name):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    text = " ".join(rng.choice(["ane", "thable", "Eriner", "inest,", "x" * 30]) for _ in range(300_000))
    assert np.frombuffer(bpe.Encoder(P.path(name)).encode(text), "<u4").tolist() == Tokenizer.from_file(P.path(name)).encode(text, add_special_tokens=False).ids
