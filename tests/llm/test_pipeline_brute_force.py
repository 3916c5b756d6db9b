"""Every stage of the pipeline against a brute-force version of itself on its own input; empty tables through all of it."""

from collections import Counter

import pytest

import corpus_pipeline
from terrafold.llm import toxicity
from terrafold.llm.linedup import MAX_RATIO, MIN_PAGES

from .conftest import DOCS
from .test_near_copies import exact_pairs
from .test_operators import WORD, check_packing, lower


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """Documents with insults, shared lines, copies, benchmark passages, nulls and repeated ids."""
    where = str(tmp_path_factory.mktemp("pipeline"))
    long = [t for _, t, *_ in rows if t and len(t.split()) > 60]
    own = [(i, None if t is None else t + ("\nfilthy scum here" if i is not None and i % 5 == 1 else ""), lang, source, n) for i, t, lang, source, n in rows]
    own += [(500 + k, f"Site menu\n{' '.join(f'u{k}x{j}' for j in range(40))}", "en", "site0", 1) for k in range(6)]
    own += [(600, long[0] + " extra", "en", "site1", 1), (600, long[1] + " more", "en", "site1", 1)]
    spark.createDataFrame(own, DOCS).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 1)) for i, t, *_ in own if i is not None and t], "doc_id long, toxic int").distinct().write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, " ".join(long[2].split()[5:30])), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, tables):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    start = plain(docs)

    # toxicity: what the machine scores below 0.5 stays, whole rows
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    scores = Counter((r.doc_id, r.score >= 0.5) for r in toxicity.rate(docs, labels).collect())
    one = plain(kept := stages["toxicity"](spark, docs, tables).cache())
    assert Counter(r[0] for r in one) == Counter({i: n for (i, bad), n in scores.items() if not bad})
    assert not Counter(one) - Counter(start) and len(one) < len(start)
    assert all("scum" not in (r[1] or "") for r in one)

    # line dedup
    norm = lambda x: x.strip(" \t\r")
    pages, seen = Counter(r[3] for r in one), Counter()
    for source, text in {(r[3], r[1]) for r in one if r[1] is not None}:
        seen.update({(source, norm(x)) for x in text.split("\n") if norm(x)})
    gone = {k for k, n in seen.items() if n >= MIN_PAGES and n > MAX_RATIO * pages[k[0]]}
    assert gone
    cut = [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, norm(x)) not in gone), lang, s) for i, t, lang, s, _ in one]
    two = plain(kept := stages["line_dedup"](spark, kept, tables).cache())
    assert Counter(two) == Counter((*r, None if r[1] is None else len(r[1])) for r in cut)

    # near duplicates: one row of each class stays, the first by id and text
    texts = [r[1] or "" for r in two]
    root = list(range(len(two)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    first_text = {}
    for i, t in enumerate(texts):
        words = b" ".join(t.encode().lower().split())
        root[find(i)] = find(first_text.setdefault(words, i))
    for i, j, similarity in exact_pairs(texts):
        if similarity >= 0.8:
            root[find(i)] = find(j)
    classes = {}
    for i, r in enumerate(two):
        classes.setdefault(find(i), []).append(r)
    three = plain(kept := stages["simhash_near_dedup"](spark, kept, tables).cache())
    assert len(three) == len(classes) < len(two)
    for own in classes.values():
        left = Counter(own) & Counter(three)
        assert sum(left.values()) == 1
        assert next(iter(left))[0] == min((r[0] for r in own if r[0] is not None), default=None)

    # decontamination
    windows = set()
    for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect():
        own = WORD.findall(lower(r.text or ""))
        windows |= {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9) if own else 0)}
    hit = lambda t: any(tuple(w[k : k + 10]) in windows for w in [WORD.findall(lower(t or ""))] for k in range(len(w)))
    four = plain(kept := stages["decontamination"](spark, kept, tables).cache())
    assert Counter(four) == Counter(r for r in three if not hit(r[1])) and len(four) < len(three)

    # packing
    used, bound = check_packing(stages["packing"](spark, kept, tables).collect(), four)
    assert used <= bound + 1


@pytest.mark.parametrize("table", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tables, tmp_path, table):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{tables}/{name}.parquet")
        (df.limit(0) if name == table else df.limit(20)).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 if table == "documents" else out.count() > 0
