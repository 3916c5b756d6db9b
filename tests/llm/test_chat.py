"""Chat formatting: layouts by fingerprint, exact way back from the formatted text, the loss mask."""

import hashlib
import random

from pyspark.sql import functions as F

from terrafold.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def slow(turns):
    """Digests of one conversation's (role, text) turns."""
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned)


def nasty(rng):
    parts = ["<turn>", "</turn>", "\\", "\\b", "\\s", "\\e", "\\n", "<", "</turn", "turn>", "\n", "user\n", "é😀", " ", "", "### Assistant:", "\x00"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))


def test_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, k, rng.choice(["user", "assistant", "system", "a\nb", "</turn>", ""]), nasty(rng)) for i in range(150) for k in range(rng.randint(1, 6))]
    rows += [(None, 1, "assistant", "x"), (None, 0, "user", None), (200, 0, None, "t"), (201, 5, "user", "b"), (201, 5, "user", "a"), (201, 5, "user", "a"), (201, None, "assistant", "first")]
    want = {}
    for i, k, r, t in sorted(rows, key=lambda x: (repr(x[0]), x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(i, []).append((r or "", t or ""))
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    chats = chat.format_chats(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chats).collect()}
    assert got == {i: slow(t) for i, t in want.items()}
    for r in chats.collect():
        assert r.formatted.count("<turn>") == r.formatted.count("</turn>") == r.n_turns


def test_mixed_layouts(spark):
    lines = [
        ('{"id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "source": "a"}', "messages", [("user", "hi"), ("assistant", "yo")]),
        ('{"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', "conversations", [("user", "q"), ("assistant", "a")]),
        ('{"id": 3, "prompt": "p", "completion": "c"}', "prompt", [("user", "p"), ("assistant", "c")]),
        ('{"id": 4, "instruction": "do", "input": "this", "output": "done"}', "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        ('{"id": 5, "instruction": "do", "input": "", "output": "done", "score": 1}', "instruction", [("user", "do"), ("assistant", "done")]),
        ('{"id": 6, "instruction": "do", "output": "done", "system": "be kind"}', "instruction", [("system", "be kind"), ("user", "do"), ("assistant", "done")]),
        ('{"id": 7, "data": {"prompt": "p", "response": "r"}}', "nested_prompt", [("user", "p"), ("assistant", "r")]),
        ('{"id": 8, "weird": "x", "prompt": "alone"}', None, []),
        ('{"id": 9, "messages": []}', None, []),
        ('{"id": 10, "messages": [{"role": "assistant", "content": null}]}', "messages", [("assistant", "")]),
        ('{"id": 11, "role": "user", "text": null}', "turn", [("user", "")]),
        ('{"id": 12, "question": "why", "context": "so", "answer": "thus"}', "question", [("user", "so\n\nwhy"), ("assistant", "thus")]),
        ('{"id": 13, "prompt": "p", "response": "r"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
        ('{"id": 14, "prompt": "p", "completion": "c", "messages": [{"role": "user", "content": "both"}]}', None, []),
    ]
    df = spark.read.json(spark.createDataFrame([(x,) for x, *_ in lines], "value string").rdd.map(lambda r: r.value))
    got = {r.id: r for r in chat.canonical(df, keep=(("id", "id"),)).collect()}
    for k, (_, name, turns) in enumerate(lines, 1):
        assert got[k].layout == name, k
        assert [tuple(t) for t in got[k].turns or []] == turns, k
    assert len({r.fingerprint for r in got.values() if r.layout == "instruction"}) == 2
    told = {r.paths: r.n for r in chat.unknown(df).collect()}
    assert told == {"prompt": 1, "": 1, "completion\nmessages[].content\nmessages[].role\nprompt": 1}
    whole = chat.digests(chat.format_chats(df, "id", None), "id")
    assert {r.id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in whole.collect()} == {k: slow(t) for k, (_, _, t) in enumerate(lines, 1)}


def test_only_some_columns_and_clashing_ones(spark):
    df = spark.createDataFrame([(1, "p", "c", "x", 1.0, "y")], "id long, Prompt string, completion string, paths string, mark double, turns string")
    got = chat.format_chats(df, "id", None).collect()
    assert got[0].formatted == "<turn>user\np</turn><turn>assistant\nc</turn>" and got[0].loss == [0, 1]
    rows = spark.createDataFrame([(1, 0, "user", "a", "own", 5), (1, 1, "assistant", "b", None, 6)], ROWS + ", place string, id long")
    assert chat.format_chats(rows).collect()[0].n_turns == 2


def test_empty_and_long(spark):
    none = spark.createDataFrame([], ROWS)
    assert chat.digests(chat.format_chats(none)).count() == 0
    many = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("ab </turn> "), 5).alias("text"))
    long = spark.createDataFrame([(2, 0, "assistant", "é\\" * 3_000_000)], ROWS)
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(many.unionByName(long))).collect()}
    assert tuple(got[1][1:5]) == slow([("user" if k % 2 == 0 else "assistant", "ab </turn> " * 5) for k in range(20_000)])
    assert got[2].loss_chars == 6_000_000 and got[2].loss_sha256 == sha("é\\" * 3_000_000)


def test_layouts_must_differ(spark):
    df = spark.createDataFrame([("a", "b")], "prompt string, completion string")
    twice = (*chat.LAYOUTS, chat.Layout("again", ("prompt", "completion"), turns=(("user", ("prompt",)),)))
    try:
        chat.canonical(df, twice)
    except ValueError as e:
        assert "in common" in str(e)
    else:
        raise AssertionError


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], ROWS)
    plan = chat.digests(chat.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
