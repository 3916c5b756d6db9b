"""Chat formatting by schema fingerprints; built-in functions only.

A table of records may hold several layouts at once (as a file of JSON lines read by Spark does: the columns are the union
of all layouts' fields, null where a record has none). ``LAYOUTS`` describes each layout by the nested paths of its fields,
required and optional, and by the turns that they make. A row's fingerprint is the hash of the paths that it
fills, in order, and selects the layout; every set of optional paths has its hash in the lookup, so a null text is
still a text of its layout. Paths that no layout names (ids, sources, scores) are left out of it. Rows of no
known layout keep a null layout and no turns (``unknown`` lists their paths): they are told, not dropped.

A conversation may lie in several rows (one per turn). Its rows are gathered in the order of their position, then
its turns are formatted as ``<turn>role`` line feed text ``</turn>``. Inside roles and texts the escape character and the control strings are written as
``\\b``, ``\\s``, ``\\e`` and, in roles, a line feed as ``\\n``: a formatted text can be cut at its control
strings and gives back exactly what went in (``parsed``). The loss mask says per turn how many of its last
characters before ``</turn>`` are learned: all of an assistant's, none of the others'.

Gathering sends each turn once, combined nowhere (it is text); rows of one conversation end in one row, as the format
asks, so a conversation has to fit in a task's memory, several of them need not. Records that are whole conversations by themselves
don't shuffle. All steps are linear in a conversation's length.

Defined results: null texts are empty; null roles are empty (a row with neither is of no known layout); rows of one conversation with the same position are ordered
by role and text and all kept; null ids are one conversation; unknown roles are kept and not learned; other columns play
no part, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, free_name, ident

START, END = "<turn>", "</turn>"
#: What is escaped, in this order; in reverse order for the way back.
ESCAPES = (("\\", "\\b"), (START, "\\s"), (END, "\\e"))
TRAINED = ("assistant",)
#: Names that other layouts have for a role.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A layout's paths (``a.b`` for a field, ``a[].b`` for a field of an array's elements) and its turns.

    ``turns`` are (role, paths) pairs, whose texts are joined by a blank line; or, for arrays, one (role path, text path) pair in ``each``.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str] | None = None
    renamed: bool = False  # roles have other names, which ROLES translates


LAYOUTS = (
    Layout("turn", ("role",), ("text",), each=("role", "text")),
    Layout("turn_content", ("role", "content"), each=("role", "content")),
    Layout("bare_turn", ("text",), turns=(("", ("text",)),)),
    Layout("messages", ("messages[].role",), ("messages[].content", "system"), (("system", ("system",)),), ("messages[].role", "messages[].content")),
    Layout("conversations", ("conversations[].from",), ("conversations[].value", "system"), (("system", ("system",)),), ("conversations[].from", "conversations[].value"), True),
    Layout("prompt", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("question", "answer"), ("context",), (("user", ("context", "question")), ("assistant", ("answer",)))),
    Layout("nested_prompt", ("data.prompt", "data.response"), turns=(("user", ("data.prompt",)), ("assistant", ("data.response",)))),
)


def _field(kind: T.DataType, names: list[str]) -> bool:
    """Whether a schema has a nested field (compared without case, as Spark does)."""
    for n in names:
        inner = n.endswith("[]")
        n = n.removesuffix("[]")
        if not isinstance(kind, T.StructType) or n.lower() not in (found := {f.name.lower(): f.dataType for f in kind}):
            return False
        kind = found[n.lower()]
        if inner:
            if not isinstance(kind, T.ArrayType):
                return False
            kind = kind.elementType
    return not isinstance(kind, T.StructType) and not isinstance(kind, T.ArrayType)


def _value(path: str) -> Column:
    """A path's value; for a path into an array, the array of its elements' values."""
    if "[]" not in path:
        return F.col(".".join(map(ident, path.split(".")))).cast("string")
    outer, inner = path.split("[].")
    return F.transform(F.col(".".join(map(ident, outer.split(".")))), lambda e: e.getField(inner).cast("string"))


def _filled(path: str) -> Column:
    return F.exists(_value(path), lambda v: v.isNotNull()) if "[]" in path else _value(path).isNotNull()


def paths(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    """All paths of the layouts, in the order in which fingerprints take them."""
    return sorted({p for x in layouts for p in (*x.required, *x.optional)})


def _present(df: DataFrame, layouts: tuple[Layout, ...]) -> Column:
    """The paths that a row fills, one a line."""
    own = [p for p in paths(layouts) if _field(df.schema, p.split("."))]
    return F.concat_ws("\n", *[F.when(_filled(p), F.lit(p)) for p in own]) if own else F.lit("")


def _hashes(df: DataFrame, layouts: tuple[Layout, ...]) -> dict[str, list[int]]:
    """Fingerprints of each layout: one for every set of its optional paths."""
    sets = [(x.name, "\n".join(sorted({*x.required, *some}))) for x in layouts for some in chain.from_iterable(combinations(x.optional, k) for k in range(len(x.optional) + 1))]
    row = df.sparkSession.range(1).select(*[F.xxhash64(F.lit(s)) for _, s in sets]).first()
    taken: dict[int, str] = {}
    out: dict[str, list[int]] = {}
    for (name, _), h in zip(sets, row, strict=True):
        if taken.setdefault(h, name) != name:
            raise ValueError(f"layouts {taken[h]} and {name} have a set of paths in common")
        out.setdefault(name, []).append(h)
    return out


def _turn(role: Column, text: Column, renamed: bool = False) -> Column:
    role = F.coalesce(role, F.lit(""))
    if renamed:
        role = F.coalesce(F.create_map(*[F.lit(v) for pair in ROLES.items() for v in pair])[F.lower(role)], role)
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(df: DataFrame, x: Layout) -> Column:
    """A layout's turns, from those of its fields that the table has."""
    has = lambda p: _field(df.schema, p.split("."))
    found = []
    for role, own in x.turns:
        if own := [p for p in own if has(p)]:
            text = F.concat_ws("\n\n", *[F.nullif(_value(p), F.lit("")) for p in own])
            needed = set(own) & set(x.required)
            found.append(F.array(_turn(F.lit(role), text)) if needed else F.when(_value(own[0]).isNotNull(), F.array(_turn(F.lit(role), text))).otherwise(F.array().cast(TURNS)))
    if x.each:
        role, text = x.each
        if "[]" in role:
            outer, r = role.split("[].")
            whole = F.col(".".join(map(ident, outer.split("."))))
            t = text.split("[].")[1]
            found.append(F.transform(whole, lambda e: _turn(e.getField(r).cast("string"), e.getField(t).cast("string") if has(text) else F.lit(""), x.renamed)))
        else:
            found.append(F.array(_turn(_value(role), _value(text) if has(text) else F.lit(""))))
    return F.concat(*found).cast(TURNS)


def canonical(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, keep: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Per row: the columns ``keep`` (name, new name), fingerprint, layout (null: unknown), paths and turns (null: unknown)."""
    usable = [x for x in layouts if all(_field(df.schema, p.split(".")) for p in x.required)]
    hashes = _hashes(df, layouts)
    mark = free_name(df, "paths")
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    own = F.xxhash64(F.col(mark))
    for x in usable:
        name = F.when(own.isin(hashes[x.name]), F.lit(x.name)).otherwise(name)
        turns = F.when(own.isin(hashes[x.name]), _turns(df, x)).otherwise(turns)
    kept = [col(c).alias(n) for c, n in keep]
    return df.withColumn(mark, _present(df, layouts)).select(*kept, own.alias("fingerprint"), name.alias("layout"), F.col(mark).alias("paths"), turns.alias("turns"))


def escaped(x: Column, role: bool = False) -> Column:
    for plain, mark in (*ESCAPES, ("\n", "\\n")) if role else ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(mark))
    return x


def unescaped(x: Column, role: bool = False) -> Column:
    for plain, mark in reversed((*ESCAPES, ("\n", "\\n")) if role else ESCAPES):
        x = F.replace(x, F.lit(mark), F.lit(plain))
    return x


def format_chats(records: DataFrame, key: str = "conv_id", position: str | None = "turn", layouts: tuple[Layout, ...] = LAYOUTS, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Per conversation: key, n_turns, formatted and loss (per turn, how many of its last characters are learned).

    With ``position`` a conversation is all rows of its key, in that order; without, every row is one by itself.
    Rows of unknown layouts add no turns.
    """
    none = F.array().cast(TURNS)
    if position:
        slim = canonical(records, layouts, ((key, "id"), (position, "place")))
        rows = slim.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("turns", none).alias("turns")))).alias("own"))
        rows = rows.select("id", F.flatten(F.transform("own", lambda r: r["turns"])).alias("turns"))
    else:
        rows = canonical(records, layouts, ((key, "id"),)).select("id", F.coalesce("turns", none).alias("turns"))
    ready = rows.select("id", F.transform("turns", lambda t: F.struct(t["role"].isin(*trained).alias("learn"), escaped(t["role"], True).alias("role"), escaped(t["text"]).alias("text"))).alias("own"))
    written = F.array_join(F.transform("own", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    loss = F.transform("own", lambda t: F.when(t["learn"], F.char_length(t["text"])).otherwise(F.lit(0)))
    return ready.select(F.col("id").alias(key), F.size("own").cast("long").alias("n_turns"), written.alias("formatted"), loss.alias("loss"))


def parsed(formatted: Column, loss: Column) -> Column:
    """Turns (role, text, learned: the text under the mask) read back from a formatted text."""
    parts = F.split(formatted, END, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)  # behind the last end there is nothing

    def turn(part: Column, n: Column) -> Column:
        at = F.locate("\n", part)
        head, body = F.substring(part, F.lit(len(START) + 1), at - (len(START) + 1)), F.substring(part, at + 1, F.char_length(part))
        return F.struct(unescaped(head, True).alias("role"), unescaped(body).alias("text"), unescaped(F.right(part, n)).alias("learned"))

    return F.zip_with(parts, loss, turn)


def digests(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """``format_chats``'s rows with hashes of the turns and of the learned text, both read back from the formatted text."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    read = chats.select(col(key), "formatted", parsed(F.col("formatted"), F.col("loss")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("turns", lambda t: t["learned"]), "")
    return read.select(col(key), F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"), sha(learned).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def unknown(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """How many records of each set of paths fit no layout: fingerprint, paths, n."""
    return canonical(records, layouts).filter(F.col("layout").isNull()).groupBy("fingerprint", "paths").agg(F.count(F.lit(1)).alias("n"))


_HELD = "replace(replace(replace({0}, '\\', '\\b'), '<turn>', '\\s'), '</turn>', '\\e')"
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok'),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(replace({_HELD.format("role")}, chr(10), '\\n')) + length({_HELD.format("text")}) + 14) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
