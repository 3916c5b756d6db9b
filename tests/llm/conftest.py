import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(["an", "re", "th", "es", "ou", "ti", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", ". ", ".\n", " "]) for w in words).strip()


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, boilerplate, markup, odd spaces, nulls and repeated rows."""
    rng = random.Random(5)
    texts: list[str | None] = [prose(rng, rng.choice([3, 20, 60, 150, 400])) for _ in range(60)]
    passage = " ".join(prose(rng, 60).split())
    texts += [texts[3]] * 4 + [texts[4].replace(" ", "  ", 2), texts[5] + " end"]
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 20) for _ in range(5)]
    texts += [t + "\nAll rights reserved." for t in texts[:30]]
    texts += [None, "", "   \n\t ", "one", "é ü ñ ça va", "x" * 5000, "word " * 3000, "### %% $$ ||| <>", "don't it's\r\nwe're\x0b\x1c ok"]
    rows = [(i, t, "en" if i % 3 else None, f"site{i % 2}" if i % 11 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, texts[8], None, None, 0)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Extra columns whose names operators use themselves."""
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, length long, rank long, host string, k1 long, fp long, tf_drop string, TF_HOST string"
    return spark.createDataFrame([(1, "a b c d e f\nline", "en", "s", 3, 0.5, 1, 2, "h", 3, 4, "d", "t"), (2, "a b c d e f\nline", "en", "s", 3, None, None, None, None, None, None, None, None)], names)
