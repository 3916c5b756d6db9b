"""Fill-in-middle: rank and select against plain sums, the operator against lists of tokens."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from terrafold.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow(key, text):
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (key, len(units), "plain", None, None, sha(text), sha(text))
    out, form = (f"<S>{s}<P>{p}<M>{m}", "spm") if h4 % 100 < 80 else (f"<P>{p}<S>{s}<M>{m}", "psm")
    return (key, len(units), form, len(p), len(m), sha(out), sha(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=1500), st.data())
def test_rank_and_select(flags, data):
    own = np.array(flags, bool)
    bits = infill.Bits.pack(len(own), lambda a, b: own[a:b])
    at = np.arange(len(own) + 1)
    assert bits.rank(at).tolist() == np.concatenate([[0], np.cumsum(own)]).tolist()
    assert bits.select(np.arange(own.sum())).tolist() == np.flatnonzero(own).tolist()
    assert bits.before[-1] == own.sum()


def test_steps_join(monkeypatch):
    """Flags are unpacked a step at a time; tokens may cross the steps' edges."""
    monkeypatch.setattr(infill, "_STEP", 512)
    texts = [" ".join(["word" * k, "é" * k, "\t\n"]) for k in range(60)] + ["", "x" * 2000, " " * 2000]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    bits = infill.boundaries(raw, ends)
    assert np.diff(bits.rank(np.concatenate([[0], ends]))).tolist() == [len(TOKEN.findall(t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \t\n\x0b\x1c\x85 aé漢😀<PSM>\x00"), max_size=40), min_size=1, max_size=30))
def test_batch_against_tokens(texts):
    got = infill.transformed([str(k) for k in range(len(texts))], pa.array(texts, pa.string()), 42, 50, 80)
    for k, (t, r) in enumerate(zip(texts, got.to_pylist(), strict=True)):
        want = slow(k, t)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == want[1:5]
        assert hashlib.sha256(r["output"].encode()).hexdigest() == want[5]


def test_operator(spark, docs, rows, empty, odd):
    long = [(1000 + k, ("word  é\n" * 200_000) + "end" * k, None, None, 0) for k in range(4)]
    texts = spark.createDataFrame(long, docs.schema).unionByName(docs)
    got = [tuple(r) for r in infill.digests(infill.fill_in_middle(texts)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(slow(i, t)) for i, t, *_ in [*rows, *long])
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    found = infill.fill_in_middle(empty)
    assert found.count() == 0 and found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert infill.fill_in_middle(odd).count() == 2


def test_all_outputs_give_their_texts_back(spark, docs, rows):
    found = infill.fill_in_middle(docs, rate=100, suffix_first=50)
    own = found.select("doc_id", infill.restored(found.output, found.form).alias("t")).collect()
    assert sorted((repr(r.doc_id), r.t) for r in own) == sorted((repr(i), t or "") for i, t, *_ in rows)


def test_a_batch_is_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(infill, "SLICE", 10)
    a = pa.array(["x" * 4, "x" * 7, "", "x" * 30, "y"], pa.string())
    assert list(infill._slices(a)) == [(0, 1), (1, 3), (3, 4), (4, 5)]
