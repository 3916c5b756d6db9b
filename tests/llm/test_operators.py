"""Each operator against a brute-force version, with nulls, empty tables, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import bpe, decontam, idstore, linedup, packing, phrases, quality, rollups, secrets, simhash, toxicity
from terrafold.llm.common import Scratch

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
P = pytest.importorskip("public_tokenizers")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def ids(name, text):
    from tokenizers import Tokenizer

    if name not in ids.kept:
        ids.kept[name] = Tokenizer.from_file(P.path(name))
    return ids.kept[name].encode(text or "", add_special_tokens=False).ids


ids.kept = {}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def by_key(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


# op 1


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.2
        words = [rng.choice(["the", "of", "and", "reon", "thable", "inest"]) for _ in range(rng.randint(5, 60))]
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(["Idiot!", "scum,"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.rate(docs, marks).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    held = [(y, found[i].predicted) for i, y in labels if found[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    # held-out labels play no part
    flipped = spark.createDataFrame([(i, 1 - y if found[i].held_out else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.rate(docs, flipped).collect()}
    assert again == {i: r.score for i, r in found.items()}


def test_toxicity_edges(spark, docs, empty, odd, rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 1e-9 for r in toxicity.rate(docs, none).collect()} == {True}
    assert toxicity.rate(empty, none).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.rate(docs, labels).count() == len(rows)
    kept = toxicity.keep_clean(odd, none)
    assert kept.columns == odd.columns and kept.count() == 2


def test_machine_learns_pairs():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(2000):
        x = np.flatnonzero(rng.random(6) < 0.5)
        rows.append(x)
        y.append(int(0 in x and 1 in x))  # only together
    bias, w, v = toxicity.fit_machine(rows, np.array(y), 6, slow=0.5, pair_decay=1e-5)
    machine = toxicity.Machine(np.arange(6), bias, w, v)
    assert np.mean([(machine.logit(x) >= 0) == b for x, b in zip(rows, y, strict=True)]) > 0.97
    assert v[0] @ v[1] > 0


# op 2


def slow_fingerprint(t):
    from xxhash import xxh64

    w = SPACE.findall(lower(t or ""))
    if not w:
        return 0
    h = [xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def classes(fps, limit=4):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows, empty, odd):
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    group = classes(fps)
    first = defaultdict(lambda: None)
    for (i, *_), g in zip(rows, group, strict=True):
        if i is not None:
            first[g] = i if first[g] is None else min(first[g], i)
    want = Counter((i, f"{f:016x}", first[g]) for (i, *_), f, g in zip(rows, fps, group, strict=True))
    assert by_key(simhash.near_duplicates(docs).collect(), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_keep_every_component(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        own = rng.getrandbits(64)
        for _ in range(12):
            fps.add(own)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                own ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = {frozenset(signed[i] for i in range(len(fps)) if g[i] == c) for g in [classes(fps)] for c in set(g)}
    for block, depth in ((4096, 2), (16, 2), (4096, 3), (4096, 4)):  # whole keys, keys split into pairs of blocks, longer keys
        scratch = Scratch(spark)
        root = {r.u: r.root for r in simhash.stars(simhash.links(nodes, scratch, block, depth), scratch).collect()}
        found = defaultdict(set)
        for s in signed:
            found[root.get(s, s)].add(s)
        assert {frozenset(x) for x in found.values()} == want


# op 3 to 5


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name, rows):
    enc = bpe.Encoder(P.path(name))
    texts = [t for _, t, *_ in rows] + ["a  b", " a", "a ", "a\n\nb", "a \n b", "...! word,, it's", "Á é", "x\x00y", "İstanbul ΣΑΣ", "<|endoftext|> x", "don't 123 4,5", "日本 語。"]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids(name, t), repr(t)


def check_packing(found, rows):
    pieces = Counter()
    for i, t, *_ in rows:
        own = [*ids("word_bpe_49k.json", t), 1]
        for k, at in enumerate(range(0, len(own), 4096)):
            part = own[at : at + 4096]
            pieces[i, k, at, len(part), crc(part)] += 1
    assert by_key(found, "doc_id", "piece", "start", "length", "ids_crc32") == pieces
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences), -(-sum(k[3] * n for k, n in pieces.items()) // 4096)


def test_packing(docs, rows, empty, odd):
    used, bound = check_packing(packing.pack(docs, P.path("word_bpe_49k.json")).collect(), rows)
    assert used <= bound + 1
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0
    assert packing.pack(odd, P.path("word_bpe_49k.json")).count() == 2


def test_configurations_use_every_piece_once():
    rng = random.Random(2)
    for n in (0, 1, 50, 5000, 200_000):
        counts = Counter(min(4096, max(1, int(rng.lognormvariate(6.5, 1.2)))) for _ in range(min(n, 5000)))
        counts = {k: v * max(1, n // 5000) for k, v in counts.items()}
        used = Counter()
        plan = packing.configurations(counts)
        for times, filling in plan:
            assert times > 0 and sum(a * b for a, b in filling) <= 4096
            for a, b in filling:
                used[a] += times * b
        assert used == counts
        bound = -(-sum(a * b for a, b in counts.items()) // 4096)
        assert sum(t for t, _ in plan) <= bound * 1.01 + 2


def test_id_store(spark, docs, rows, empty):
    name, path = "byte_bpe_50k.json", Scratch(spark).path("store")
    idstore.write(docs, path, P.path(name))
    found = sorted((r for r in idstore.digest(spark, path).collect()), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    whole = {i: [*ids(name, t), 2] for i, t, *_ in rows}
    at = 0
    for r in found:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(whole[r.doc_id]), crc(whole[r.doc_id]))
        at += r.n_tokens
    assert {(r.doc_id, r.start): r.ids for r in idstore.read_ids(spark, path).collect()} == {(r.doc_id, r.start): whole[r.doc_id] for r in found}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() < sum(r.n_chunks for r in found)
    other = Scratch(spark).path("store")
    idstore.write(empty, other, P.path(name))
    assert idstore.digest(spark, other).count() == 0
    # damage shows
    broken = Scratch(spark).path("store")
    for part in ("recipes", "manifest", "summary"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{broken}/{part}")
    chunks.withColumn("payload", F.concat("payload", F.lit(b"\0\0"))).write.parquet(f"{broken}/chunks")
    with pytest.raises(Exception, match="is damaged"):
        idstore.digest(spark, broken).collect()


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50000, 30000).astype("<u4"), rng.integers(0, 50000, 777).astype("<u4")
    one, two = idstore.cuts(a), idstore.cuts(np.concatenate([b, a]))
    assert one[-1] == len(a) and len({x + len(b) for x in one} & set(two)) > 0.8 * len(one)
    assert all(q - p <= idstore.MAX_CHUNK for p, q in zip([0, *one], one))  # noqa: B905
    for n in range(40):
        x, y = rng.bytes(n), rng.bytes(2 * n + 1)
        assert idstore.crc_join(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


# op 6

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, docs, rows, empty, odd):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[5:25])), (2, "tiny words"), (3, None), (4, "###"), (5, texts[1][40:300].upper()), (5, texts[2][:90]), (None, " ".join(texts[3].split()[2:14])), (7, " ".join(texts[0].split()[10:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        own = WORD.findall(lower(t or ""))
        for at in range(max(1, len(own) - 9) if own else 0):
            windows[tuple(own[at : at + 10])] |= {str(i)} if i is not None else set()
    want = Counter()
    for i, t, *_ in rows:
        own, hit, names = WORD.findall(lower(t or "")), set(), set()
        for at in range(len(own)):
            for n in range(1, 11):
                if len(k := tuple(own[at : at + n])) == n and k in windows:
                    hit |= set(range(at, at + n))
                    names |= windows[k]
        want[i, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for size in (4 << 20, 1):  # items in a block, items as tables
        assert by_key(decontam.decontaminate(docs, bench, block_bytes=size).collect(), *columns) == want
    clean = sum(n for k, n in want.items() if not k[-1])
    assert clean < len(rows) and decontam.keep_clean(docs, bench).count() == clean
    assert decontam.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(docs, bench.limit(0)).collect())
    kept = decontam.keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 2


# op 7


def test_quality(docs, rows, empty, odd):
    line_docs, totals, lines_of = Counter(), Counter(), []
    for _, t, _, source, _ in rows:
        own = Counter()
        for line in (t or "").split("\n"):
            parts = SPACE.findall(line)
            if parts:
                own[lower(" ".join(parts))] += len(parts)
        lines_of.append(own)
        totals[source] += 1
        line_docs.update((source, x) for x in own)
    want = Counter()
    for (i, t, _, source, _), own in zip(rows, lines_of, strict=True):
        t = t or ""
        words = SPACE.findall(t)
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        runs = defaultdict(list)
        for at in range(len(words) - 2):
            runs[tuple(words[at : at + 3])].append(at)
        again = len({at + k for v in runs.values() if len(v) > 1 for at in v for k in range(3)})
        failed = len(words) < 50 or 100 * again > 50 * len(words)
        gone = sum(n for x, n in own.items() if line_docs[source, x] >= 5 and line_docs[source, x] > 0.05 * totals[source])
        want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, failed, gone, not failed and len(words) - gone >= 0.5 * len(words)] += 1
    found = quality.rate(docs, min_docs=5, max_ratio=0.05).collect()
    assert by_key(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept") == want
    assert any(r.n_removed_words for r in found)
    assert quality.rate(empty).count() == 0 and quality.rate(odd).count() == 2


# op 8


def test_secrets(spark, empty, odd):
    key = "AKIA" + "B2" * 8
    texts = [
        f"é password = 'hunter22x' {key} {'ab12' * 8}", "Token:short", "api_key=abcdefgh API-KEY=zzzzzzzzz apikey:'12345678", "user_name=alice pin=4321", "user_name=alice", f"pin=4321 {'x' * 900} user_name=alice",
        "see https://db.example.org:99/x", "login: bob pwd: 12345 at https://db.example.org", f"{'0a' * 40} AKIASHORT secretpassword=abcdefghij", None, "", "token=token:abcdefghij", "ſecret=abcdefghijk " * 3, "10.0.0.1 secret=abcd",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "other"), (None, texts[0])], "doc_id long, text string")
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 8), ("access", re.compile("AKIA[A-Z0-9]+"), 16), ("hex", re.compile("[0-9a-f]+"), 32))
    found = secrets.scan(docs).collect()
    assert len(found) == docs.count()
    by_text = defaultdict(list)
    for r in found:
        by_text[r.doc_id].append(r)
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (n, p, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m.group(2) if n == "assign" else m.group()) >= least)
        base = ",".join(f"{kinds[k][0]}:{a}:{e}" for a, k, e in spans)
        r = next(x for x in by_text[i] if i != 3 or x.n_linked or not x.spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (t, base, r)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    weak = {i: [s.split(":")[0] for s in by_text[i][0].spans.split(",") if s.startswith("link")] for i in (4, 5, 6, 7)}
    assert weak == {4: [], 5: [], 6: [], 7: ["link_id", "link_secret", "link_endpoint"]}
    assert sorted(r.spans for r in by_text[3]) == ["", "link_id:0:15,link_secret:16:24", "link_id:0:15,link_secret:16:24"]
    assert secrets.scan(empty).count() == 0 and secrets.scan(odd).count() == 2


# op 9


def test_line_dedup(docs, rows, empty, odd):
    norm = lambda x: x.strip(" \t\r")
    seen, totals = Counter(), Counter()
    for _, t, _, source, _ in rows:
        totals[source] += 1
        seen.update({(source, norm(x)) for x in (t.split("\n") if t is not None else []) if norm(x)})
    want = Counter()
    for i, t, _, source, _ in rows:
        lines = t.split("\n") if t is not None else []
        drop = [bool(norm(x)) and seen[source, norm(x)] >= 4 and seen[source, norm(x)] > 0.1 * totals[source] for x in lines]
        want[i, None if t is None else "\n".join(x for x, gone in zip(lines, drop, strict=True) if not gone), len(lines), sum(drop)] += 1
    out = linedup.drop_boilerplate(docs, max_ratio=0.1, min_pages=4, n_lines="n_lines", n_dropped="n_dropped")
    found = out.collect()
    assert by_key(found, "doc_id", "text", "n_lines", "n_dropped") == want and any(r.n_dropped for r in found)
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
    assert linedup.drop_boilerplate(empty).count() == 0
    assert linedup.drop_boilerplate(odd).columns == odd.columns


# op 10


def test_substring_dedup(spark, docs, rows, empty, odd):
    words = [SPACE.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[a : a + 35]) for w in words for a in range(len(w) - 34))
    want = Counter()
    for (i, *_), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for a in range(len(w) - 34):
            if seen[tuple(w[a : a + 35])] > 1:
                keep[a : a + 35] = [False] * 35
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        want[i, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    for more in ({"shard_words": 300}, {"hot": 0}, {"shard_bytes": 500, "shard_words": 40}):
        found = phrases.remove_repeats(docs, keep_text=True, **more).collect()
        assert by_key(found, "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == want
    assert phrases.remove_repeats(empty).count() == 0
    # near copies with edits here and there: recurring windows instead of many overlapping runs
    rng = random.Random(12)
    base = [f"w{k}" for k in range(62)]
    edited = [[w if rng.random() > 0.03 else f"x{i}" for w in base] for i in range(40)]
    found = phrases.confirm([(1, " ".join(e).encode(), 1) for e in edited])
    counts = Counter(" ".join(e[k : k + 35]).encode() for e in edited for k in range(28))
    assert {p for _, p in found} == {w for w, n in counts.items() if n > 1}
    assert [r.n_removed for r in phrases.remove_repeats(odd).collect()] == [0, 0]


def test_anchors_are_shared():
    rng = random.Random(4)
    for _ in range(30):
        core = [rng.choice([b"a", b"bb", b"ccc", b"d"]) for _ in range(35)]
        places = []
        for _ in range(2):
            before = [str(rng.random()).encode() for _ in range(rng.randint(0, 50))]
            w = [*before, *core, *[str(rng.random()).encode() for _ in range(rng.randint(0, 50))]]
            anchors, first, many = phrases.anchored(w)
            assert first[0] == 0 and many.sum() == len(w) - 34
            run = int(np.searchsorted(first, len(before), side="right")) - 1
            places.append(anchors[run])
        assert places[0] == places[1]
    assert (phrases._least(np.array([5, 3, 9, 1, 7], np.uint64), 3) == [3, 1, 1]).all()
