"""Secret scans with multipart credential linking (DataFrame and SQL functions only).

Base spans are what three patterns match, leftmost and non-overlapping per kind, less the short ones: they
are always reported. Weak parts (an account or access identifier, a short or short-hex secret, an endpoint)
say little alone. They are reported only when complementary parts stand in the same scope: an interval join
brings together a weak part and the parts whose span, widened by ``scope`` code points, covers its start. An identifier needs a secret, a secret needs an
identifier or an endpoint, an endpoint needs both. Base assign and hex spans count as secrets and base access
spans as identifiers.

Positions come from Spark's own functions: a text split at a pattern gives the lengths between the matches,
so starts are running sums. The interval join is an equi-join on (document, scope-wide bucket) with a range
condition, as left-semi joins: no pair of parts is ever emitted, and a document's parts meet only within their
buckets. Only texts with a weak part enter it, as spans without their text.

Defined results: a null text is empty; a text without spans has counts of 0, the digest of the empty string
and an empty list; rows are matched by doc_id (null safe) and a 128-bit digest of the text, so repeated rows
each get the same result and rows that share an id but not a text get their own; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, free_name

#: Code points that may lie between two parts of one credential.
SCOPE = 200

#: Matches that are walked in one block.
WALK = 512

#: Fixed values of the base kinds, in their listed order: pattern, the group whose length counts, least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
#: Weak parts: kind, role, pattern. Fewer characters than a base kind asks for, or no secret at all.
WEAK = (
    ("link_id", "id", r"""(?i:access_?key_?id|client_?id|account|user_?name|login|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""),
    ("link_key", "id", r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{4,11}(?![A-Z0-9])"),
    ("link_secret", "secret", r"""(?i:password|passwd|secret|token|api_?key|pwd|pin)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,7}(?![A-Za-z0-9+/_.=-])"""),
    ("link_hex", "secret", r"(?<![0-9a-f])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,31}(?![0-9a-f])"),
    ("link_endpoint", "endpoint", r"""(?:https?|jdbc:[a-z]+|postgres|mysql|redis|mongodb|amqp|ftp|s3)://[^\s"'<>]+"""),
    ("link_host", "endpoint", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])"),
)
#: Strings of which one is in every text that a pattern can match (the text in lower case for the keyed kinds).
HINTS = {
    "assign": ("password", "passwd", "secret", "token", "api"), "link_secret": ("password", "passwd", "secret", "token", "api", "pwd", "pin"),
    "link_id": ("access", "client", "account", "user", "login"), "link_endpoint": ("://",), "access": ("akia",), "link_key": ("akia", "asia"),
}
ORDER = {kind: i for i, kind in enumerate([b[0] for b in BASE] + [w[0] for w in WEAK])}
ROLE = {"assign": "secret", "access": "id", "hex": "secret"} | {kind: role for kind, role, _ in WEAK}


def _sql(pattern: str) -> str:
    return "r\"" + pattern.replace('"', r"\x22") + "\""


def _spans(kind: str, pattern: str, text: str, low: str, group: int = 0, least: int = 0) -> str:
    """SQL for the spans of one kind: array of (first, last, rank), first and last in code points."""
    p = _sql(pattern)
    hint = " OR ".join(f"contains({low}, '{h}')" for h in HINTS[kind]) if kind in HINTS else f"{text} RLIKE {p}"
    none = "CAST(array() AS array<struct<first:int,last:int,rank:int>>)"
    sizes = f"transform(regexp_extract_all({text}, {p}, {group}), x -> length(x))" if least else f"transform(regexp_extract_all({text}, {p}, 0), x -> 9999)"
    # A list that grows by one is copied each time, so matches are walked in blocks and the blocks' lists put together: linear in all but the blocks.
    walk = f"""flatten(transform(
      array(arrays_zip(transform(split({text}, {p}, -1), x -> length(x)), transform(regexp_extract_all({text}, {p}, 0), x -> length(x)), {sizes})),
      z -> aggregate(
        transform(sequence(0, (size(z) - 1) div {WALK}), k -> slice(z, k * {WALK} + 1, {WALK})),
        named_struct('at', 0, 'outs', array({none})),
        (a, block) -> aggregate(block, named_struct('at', a.at, 'out', {none}),
          (i, x) -> named_struct('at', i.at + x.`0` + coalesce(x.`1`, 0),
            'out', IF(coalesce(x.`2`, 0) >= {max(1, least)}, concat(i.out, array(named_struct('first', i.at + x.`0`, 'last', i.at + x.`0` + x.`1`, 'rank', {ORDER[kind]}))), i.out)),
          i -> named_struct('at', i.at, 'outs', IF(size(i.out) = 0, a.outs, concat(a.outs, array(i.out))))),
        a -> flatten(a.outs))))"""
    return f"CASE WHEN {hint} THEN {walk} ELSE {none} END"


def _listed(spans: str) -> str:
    """SQL: kind:first:last of sorted spans, joined by commas."""
    names = ", ".join(f"'{k}'" for k in ORDER)
    sort = f"array_sort({spans}, (l, r) -> CASE WHEN l.first <> r.first THEN l.first - r.first WHEN l.rank <> r.rank THEN l.rank - r.rank ELSE l.last - r.last END)"
    return f"array_join(transform({sort}, s -> concat(element_at(array({names}), s.rank + 1), ':', s.first, ':', s.last)), ',')"


def find_parts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: id, text_key, base spans (assign, access, hex) and weak spans."""
    slim = docs.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("t"))
    slim = slim.select("id", "t", F.md5("t").alias("text_key"), F.lower("t").alias("low"))
    found = [F.expr(_spans(k, p, "t", "low", g, n)).alias(k) for k, p, g, n in BASE] + [F.expr(_spans(k, p, "t", "low")).alias(k) for k, _, p in WEAK]
    return slim.select("id", "text_key", *found)


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(id, text_key, linked): per document the weak spans whose complementary parts are within ``scope``."""
    weak = [k for k, _, _ in WEAK]
    roles = F.create_map(*[F.lit(x) for k in ORDER for x in (ORDER[k], ROLE[k])])
    some = parts.filter(F.expr(" + ".join(f"size({k})" for k in weak)) > 0).dropDuplicates(["id", "text_key"])
    rows = some.select("id", "text_key", F.explode(F.concat(*ORDER)).alias("s")).select(
        "id", "text_key", "s.*", roles[F.col("s.rank")].alias("role"), F.expr(f"s.first div {scope}").alias("bucket"))
    # A part reaches from `scope` before its start to `scope` past its end: it is dealt to each bucket that this touches.
    reach = rows.select("id", "text_key", "role", (F.col("first") - scope).alias("lo"), (F.col("last") + scope).alias("hi"),
                        F.explode(F.expr(f"sequence(greatest(first - {scope}, 0) div {scope}, (last + {scope}) div {scope})")).alias("bucket"))

    def near(left: DataFrame, role: str) -> DataFrame:
        a, b = left.alias("a"), reach.filter(F.col("role") == role).alias("b")
        on = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.bucket") == F.col("b.bucket"))
        return a.join(b, on & F.col("a.first").between(F.col("b.lo"), F.col("b.hi")), "left_semi")

    w = rows.filter(F.col("rank") >= len(BASE))
    ids, secrets, ends = (w.filter(F.col("role") == r) for r in ("id", "secret", "endpoint"))
    linked = near(ids, "secret").unionByName(near(secrets, "id")).unionByName(near(secrets, "endpoint")).unionByName(near(near(ends, "id"), "secret"))
    return linked.select("id", "text_key", "first", "last", "rank").distinct().groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "last", "rank")).alias("linked"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: its key, n_assign, n_access, n_hex, base_sha256, n_linked and spans."""
    scratch = Scratch(docs.sparkSession)
    parts = scratch.write(find_parts(docs, text, key), "parts")
    p, k = parts.alias("p"), link_parts(parts, scope).alias("k")
    joined = p.join(k, F.col("p.id").eqNullSafe(F.col("k.id")) & (F.col("p.text_key") == F.col("k.text_key")), "left")
    none = "CAST(array() AS array<struct<first:int,last:int,rank:int>>)"
    base = f"concat({', '.join('p.' + b[0] for b in BASE)})"
    linked = f"coalesce(k.linked, {none})"
    return joined.select(
        F.col("p.id").alias(key), *[F.size(f"p.{b[0]}").cast("long").alias(f"n_{b[0]}") for b in BASE],
        F.sha2(F.expr(_listed(base)), 256).alias("base_sha256"), F.expr(f"size({linked})").cast("long").alias("n_linked"), F.expr(_listed(f"concat({base}, {linked})")).alias("spans"))
