"""Spatial join: grid cells, an equi-join on them, a box test, then the exact predicate.

Both sides get boxes. One aggregation and a small sample of the left side set the cell size, so that a left row shares its
cell with few others even where rows crowd (``cell_size``); every row goes to the cells that its box covers, and rows meet in an equi-join on the cell, which Spark
spreads over the cluster and splits where it is skewed. A pair is kept only in the cell of the lower left corner of its
boxes' overlap, so no distinct is needed. A row that covers more than ``MAX_CELLS`` cells goes to a coarser grid instead: its
level's cells, 8 times as wide per level, and the other side's rows are dealt to the levels in use too.

A compound condition is a predicate for the grid, columns that must be equal (they join the cell in the equi-join) and a rest,
which is tested on the pairs that are left. Outer, semi and anti joins come from the inner join: a left row has a partner if its
values that the condition reads (geometry, equal columns, columns of the rest) are among the inner join's. So no row numbers
and no files are needed, and equal rows share their fate, as they must.

Where rows share their geometries (at least ``SHARED`` to one, by an estimate), the different ones are joined and the pairs are then given their
rows back in equi-joins: a predicate is decided once for all rows that share it. ``spatial_aggregate`` gives each left row counts, sums, least
and greatest values over its partners without forming the pairs: rows that the condition can't tell apart are added up before they are
joined, and a comparison of a column of each side is answered from running aggregates in the order of the right one.

Points as structs and boxes as structs are tested natively throughout; Python only runs for predicates that boxes
don't decide. Nothing is broadcast, whatever the sizes, unless Spark itself finds a side small enough.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import native
from ..functions import scalar as S
from ..functions.registry import scalar_udf

MAX_CELLS = 64
LEVELS = 8
#: Left rows that may share a cell with a row, and the rows that a cell's size is judged by.
CROWD, SAMPLE = 8, 20_000
#: Rows to a different geometry from which on these are joined instead of rows.
SHARED = 4
JOINABLE = (*[p for p in S.PREDICATES if p != "ST_Disjoint"], "ST_DWithin", "ST_BBoxIntersects")


def kind(df: DataFrame, c: str) -> str:
    t = df.schema[c].dataType
    if isinstance(t, T.StructType):
        return "point" if {"x", "y"} <= set(t.names) else "box"
    return "geometry"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_names(names: list[str], *taken: DataFrame) -> list[str]:
    """Column names like these that no given table has (Spark compares without case)."""
    own = {c.lower() for d in taken for c in d.columns}
    out = []
    for n in names:
        while n.lower() in own:
            n = "_" + n
        out.append(n)
    return out


def _box(df: DataFrame, c: str) -> Column:
    k = kind(df, c)
    g = F.col(quoted(c))
    return native.point_box(g) if k == "point" else native.box_ordered(g) if k == "box" else scalar_udf("ST_Envelope")(g)


def decided(pred: str, lk: str, rk: str, p: Column, q: Column) -> Column | None:
    """The exact predicate from both boxes, where points and upright boxes of positive size decide it natively."""
    if pred == "ST_BBoxIntersects":
        return native.boxes_intersect(p, q)
    if {lk, rk} <= {"point", "box"}:
        if pred == "ST_Intersects":
            return native.boxes_intersect(p, q)
        if pred == "ST_Covers" and lk == "box" or pred == "ST_CoveredBy" and rk == "box":
            return native.box_contains(p, q) if pred == "ST_Covers" else native.box_contains(q, p)
        if lk == rk == "point" and pred == "ST_Equals":
            return (p["xmin"] == q["xmin"]) & (p["ymin"] == q["ymin"])
        inside = lambda o, i: (o["xmin"] < i["xmin"]) & (i["xmin"] < o["xmax"]) & (o["ymin"] < i["ymin"]) & (i["ymin"] < o["ymax"])
        if pred in ("ST_Contains", "ST_ContainsProperly") and (lk, rk) == ("box", "point"):
            return inside(p, q)
        if pred == "ST_Within" and (lk, rk) == ("point", "box"):
            return inside(q, p)
    return None


def _levels(size: int, cell: float) -> range:
    """Levels that boxes between 2^(size-1) and 2^size wide can get."""
    if size == -9999:
        return range(1)
    low, high = 2.0 ** (size - 1), 2.0**size
    first = next((k for k in range(LEVELS) if low // (cell * 8.0**k) + 1 <= MAX_CELLS), LEVELS)
    last = next((k for k in range(LEVELS) if (high // (cell * 8.0**k) + 2) ** 2 <= MAX_CELLS), LEVELS)
    return range(first, last + 1)


def cell_size(cell: float, centres: np.ndarray, n: int, least: float) -> float:
    """``cell``, halved until a row shares its cell with at most ``CROWD`` others, as a sample of the ``n`` rows' centres shows.

    Cells below ``least`` (rows would cover many of them) or shared by equal centres alone don't help and aren't tried.
    """
    m = len(centres)
    while m > 1 and cell / 2 >= least:
        own = np.unique(np.floor(centres / cell), axis=0, return_counts=True)[1]
        if (own * (own - 1)).sum() / (m * (m - 1)) * n <= CROWD or (own > 1).sum() == 0:
            break
        cell /= 2
    return cell


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    pred: str,
    left_geom: str,
    right_geom: str,
    distance: float | None = None,
    how: str = "inner",
    cell: float | None = None,
    equal: list[tuple[str, str]] | None = None,
    residual: Column | str | None = None,
    _shared: bool = True,
) -> DataFrame:
    """Rows of both sides for which ``pred``(left geometry, right geometry) holds, ``equal`` columns are equal and ``residual`` is true.

    ``how``: inner, left, right, full, left_semi or left_anti. Columns must differ between the sides (for left_semi and
    left_anti without a residual they need not; only the left ones are returned). Null and empty geometries match nothing. ST_Disjoint has no grid: its
    semi and anti joins count the partners that meet a row instead, its inner join needs equal columns. The
    sides' values must not change from one evaluation to the next (no rand(); write such a table first).
    """
    equal = equal or []
    residual = F.expr(residual) if isinstance(residual, str) else residual
    if pred == "ST_Disjoint":
        return _disjoint(left, right, left_geom, right_geom, how, equal, residual)
    if pred not in JOINABLE:
        raise ValueError(f"{pred} cannot be joined by grid; use crossJoin and a filter")
    if pred == "ST_DWithin" and (distance is None or distance < 0):
        raise ValueError("ST_DWithin needs a distance of zero or more")
    if how not in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        raise ValueError(f"unknown kind of join: {how}")
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if both and how in ("left_semi", "left_anti") and residual is None:
        names = free_names([f"r{i}" for i in range(len(right.columns))], left)
        own = dict(zip(right.columns, names, strict=True))
        return spatial_join(left, right.toDF(*names), pred, left_geom, own[right_geom], distance, how, cell, [(l, own[r]) for l, r in equal])
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    if how != "inner":
        inner = spatial_join(left, right, pred, left_geom, right_geom, distance, "inner", cell, equal, residual)
        return _outer(left, right, inner, left_geom, right_geom, how, equal, residual)
    lk, rk = kind(left, left_geom), kind(right, right_geom)
    box, own_level, level, cx, cy = free_names(["box", "own_level", "level", "cx", "cy"], left, right)
    grow = F.lit(float(distance or 0))

    def boxed(d: DataFrame, c: str, by: Column | None = None) -> DataFrame:
        d = d.withColumn(box, _box(d, c)).filter(F.col(box).isNotNull())
        return d if by is None else d.withColumn(box, native.box_expand(F.col(box), by))

    wider = grow if pred == "ST_DWithin" else None
    l0, r0 = boxed(left, left_geom, wider), boxed(right, right_geom)
    b = F.col(box)
    wide = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    # The binary orders of magnitude of box sizes; at most a few thousand numbers, mostly one to ten.
    sizes = F.collect_set(F.when(wide > 0, F.ceil(F.log2(wide))).otherwise(F.lit(-9999)).cast("int"))
    measures = [F.min(b["xmin"]), F.max(b["xmax"]), F.min(b["ymin"]), F.max(b["ymax"]), F.count(F.lit(1)), F.avg(b["xmax"] - b["xmin"]), F.avg(b["ymax"] - b["ymin"]), sizes, F.approx_count_distinct(b)]
    sides = l0.agg(F.lit(0).alias("side"), *[m.alias(f"m{i}") for i, m in enumerate(measures)])
    sides = sides.unionByName(r0.agg(F.lit(1).alias("side"), *[m.alias(f"m{i}") for i, m in enumerate(measures)]))
    both_sides = {r.side: r[1:] for r in sides.collect()}  # one row a side
    x = both_sides[0]
    found = set(x[7]) | (set(both_sides[1][7]) if rk != "point" else {-9999})
    if _shared and any(m[4] > SHARED * m[8] and m[4] > SAMPLE for m in both_sides.values()):
        return _by_geometry(left, right, pred, left_geom, right_geom, distance, cell, equal, residual)
    if cell is None:
        side = max(x[1] - x[0], x[3] - x[2]) if x[4] else 1.0
        least = max(2 * max(x[5] or 0, x[6] or 0), 1e-12 * max(1.0, *(abs(v or 0) for v in x[:4])))
        cell = max(side / max(1.0, x[4] ** 0.5), least)
        if x[4] > CROWD and cell / 2 >= least:  # about SAMPLE rows, drawn before their boxes are taken
            some = boxed(left.sample(min(1.0, SAMPLE / x[4]), seed=7), left_geom, wider)
            middles = some.select((b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2).collect()
            cell = cell_size(cell, np.array(middles, float).reshape(-1, 2), x[4], least)
    width = F.pow(F.lit(8.0), F.col(level)) * F.lit(float(cell))

    def at(field: str) -> Column:
        return F.floor(F.col(box)[field] / width)

    n_cells = lambda w: (F.floor(b["xmax"] / w) - F.floor(b["xmin"] / w) + 1) * (F.floor(b["ymax"] / w) - F.floor(b["ymin"] / w) + 1)
    own = F.coalesce(*[F.when(n_cells(F.lit(cell * 8.0**k)) <= MAX_CELLS, F.lit(k)) for k in range(LEVELS)], F.lit(LEVELS))
    levels = sorted({k for e in found for k in _levels(e, cell)}) or [0]

    def dealt(d: DataFrame) -> DataFrame:
        """Each row at its own level and, so that unequal levels meet, at every coarser level in use."""
        d = d.withColumn(own_level, own).withColumn(level, F.explode(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col(own_level))))
        d = d.withColumn(cx, F.explode(F.sequence(at("xmin"), at("xmax"))))
        return d.withColumn(cy, F.explode(F.sequence(at("ymin"), at("ymax"))))

    l, r = dealt(l0).alias("a"), dealt(r0).alias("b")
    mine, other = (lambda c: F.col(f"a.{quoted(c)}")), (lambda c: F.col(f"b.{quoted(c)}"))
    on = (mine(level) == other(level)) & (mine(cx) == other(cx)) & (mine(cy) == other(cy))
    for one, two in equal:
        on &= mine(one) == other(two)
    on &= mine(level) == F.greatest(mine(own_level), other(own_level))  # a pair meets at the coarser of its levels only
    p, q = mine(box), other(box)
    w = F.pow(F.lit(8.0), mine(level)) * F.lit(float(cell))
    on &= native.boxes_intersect(p, q) & (F.floor(F.greatest(p["xmin"], q["xmin"]) / w) == mine(cx)) & (F.floor(F.greatest(p["ymin"], q["ymin"]) / w) == mine(cy))
    if pred in ("ST_Contains", "ST_ContainsProperly", "ST_Covers"):
        on &= native.box_contains(p, q)
    elif pred in ("ST_Within", "ST_CoveredBy"):
        on &= native.box_contains(q, p)
    lg, rg = mine(left_geom), other(right_geom)
    if pred == "ST_DWithin":
        exact = native.point_distance(lg, rg) <= grow if lk == rk == "point" else scalar_udf("ST_DWithin")(lg, rg, grow)
    else:
        exact = decided(pred, lk, rk, p, q)
        if exact is None:
            exact = scalar_udf(pred)(lg, rg)
    joined = l.join(r, on).filter(exact).select(*[mine(c) for c in left.columns], *[other(c) for c in right.columns])
    return joined if residual is None else joined.filter(residual)


def _keyed(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The different values of some columns, by other names."""
    return df.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keys, names, strict=True)]).distinct()


def _given_back(df: DataFrame, keys: list[str], found: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Rows with what was found for their values of ``keys``, which ``found`` calls ``names``."""
    return found.join(df, _all([F.col(n).eqNullSafe(F.col(quoted(c))) for c, n in zip(keys, names, strict=True)]), how)


def _by_geometry(left: DataFrame, right: DataFrame, pred: str, lg: str, rg: str, distance: float | None, cell: float | None, equal: list[tuple[str, str]], residual: Column | None) -> DataFrame:
    """The inner join by the different geometries (and equal columns) of both sides."""
    one, two = list(dict.fromkeys([lg, *[l for l, _ in equal]])), list(dict.fromkeys([rg, *[r for _, r in equal]]))
    names = free_names([f"k{i}" for i in range(len(one) + len(two))], left, right)
    mine, theirs = dict(zip(one, names, strict=False)), dict(zip(two, names[len(one) :], strict=True))
    met = spatial_join(_keyed(left, one, [*mine.values()]), _keyed(right, two, [*theirs.values()]), pred, mine[lg], theirs[rg], distance, "inner", cell, [(mine[l], theirs[r]) for l, r in equal], None, False)
    # The pairs are few and what they become is many: they are spread by number, so that small partitions aren't put together.
    met = met.repartition(4 * left.sparkSession.sparkContext.defaultParallelism, *map(F.col, mine.values()))
    joined = _given_back(right, two, _given_back(left, one, met, [*mine.values()]), [*theirs.values()])
    joined = joined.select(*[F.col(quoted(c)) for c in [*left.columns, *right.columns]])
    return joined if residual is None else joined.filter(residual)


def spatial_aggregate(
    left: DataFrame,
    right: DataFrame,
    pred: str,
    left_geom: str,
    right_geom: str,
    aggregates: dict[str, tuple[str, str | None]],
    distance: float | None = None,
    equal: list[tuple[str, str]] | None = None,
    residual: Column | str | None = None,
    compare: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Every left row with aggregates over its partners: name -> (count, sum, min or max; right column, None to count rows).

    A row without a partner has counts of zero, else nulls. ``compare`` is (left column, >, >=, < or <=, right column), a further condition, read
    from the right column's side: ("k", ">", "o") asks for o > k. The columns of the sides and of the aggregates must differ.
    """
    equal = equal or []
    residual = F.expr(residual) if isinstance(residual, str) else residual
    read = lambda d, more: list(dict.fromkeys([*more, *_read(left.crossJoin(right), residual, d.columns)]))
    one, two = read(left, [left_geom, *[l for l, _ in equal]]), read(right, [right_geom, *[r for _, r in equal]])
    first = lambda how, c: F.count(F.lit(1) if c is None else F.col(quoted(c))) if how == "count" else getattr(F, how)(quoted(c))
    then = lambda how, n: getattr(F, "sum" if how == "count" else how)(n)
    partial = [first(how, c).alias(n) for n, (how, c) in aggregates.items()]
    whole = [then(how, n).alias(n) for n, (how, _) in aggregates.items()]
    here, there = [F.col(quoted(c)) for c in one], [F.col(quoted(c)) for c in two]
    if compare is None:
        met = spatial_join(left.select(*here).distinct(), right.groupBy(*there).agg(*partial), pred, left_geom, right_geom, distance, "inner", None, equal, residual)
        totals = met.groupBy(*here).agg(*whole)
    else:
        asked, sign, told = compare
        met = spatial_join(left.select(*here).distinct(), right.select(*there).distinct(), pred, left_geom, right_geom, distance, "inner", None, equal, residual)
        names = free_names([f"k{i}" for i in range(len(one) + 1)], left, right)
        value, late = free_names(["value", "late"], left, right)
        asking = left.select(*[c.alias(n) for c, n in zip([*here, F.col(quoted(asked))], names, strict=True)]).filter(F.col(names[-1]).isNotNull()).distinct()
        asking = _given_back(asking, names[:-1], met, one).select(*there, F.col(names[-1]).alias(value), F.lit(int("=" in sign)).alias(late), *map(F.col, names))
        telling = right.filter(F.col(quoted(told)).isNotNull()).groupBy(*there, F.col(quoted(told)).alias(value)).agg(*partial).withColumn(late, F.lit(int("=" not in sign)))
        both = asking.unionByName(telling, allowMissingColumns=True)
        order = F.desc(value) if sign.startswith(">") else F.asc(value)
        running = Window.partitionBy(*there).orderBy(order, F.asc(late)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.select(late, *names, *[then(how, n).over(running).alias(n) for n, (how, _) in aggregates.items()]).filter(F.col(late) == int("=" in sign))
        totals = both.groupBy(*names).agg(*whole).toDF(*one, asked, *aggregates) if asked not in one else both.groupBy(*names[:-1]).agg(*whole).toDF(*one, *aggregates)
        one = list(dict.fromkeys([*one, asked]))
    names = free_names([f"t{i}" for i in range(len(one))], left, totals)
    totals = totals.toDF(*names, *aggregates)
    found = _given_back(left, one, totals, names, "right")
    return found.select(*[F.col(quoted(c)) for c in left.columns], *[F.coalesce(n, F.lit(0)).alias(n) if how == "count" else F.col(n) for n, (how, _) in aggregates.items()])


def _value(df: DataFrame, c: str) -> Column:
    """A column to compare rows by: long values by their hash."""
    x = F.col(quoted(c))
    return F.unhex(F.sha2(x.cast("binary"), 256)) if isinstance(df.schema[c].dataType, (T.BinaryType, T.StringType)) else x


def _read(df: DataFrame, residual: Column | None, columns: list[str]) -> list[str]:
    """Which of these columns a residual over ``df`` reads."""
    if residual is None:
        return []
    found = df.select(residual)._jdf.queryExecution().analyzed().expressions().apply(0).references().toSeq()
    names = {found.apply(i).name() for i in range(found.size())}
    return [c for c in columns if c in names]


def _partnered(df: DataFrame, inner: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join with the inner join by the columns that decide a row's fate."""
    names = free_names([f"k{i}" for i in range(len(keys))], df)
    some = inner.select(*[_value(df, c).alias(n) for c, n in zip(keys, names, strict=True)]).distinct()
    same = F.lit(True)
    for c, n in zip(keys, names, strict=True):
        same &= _value(df, c).eqNullSafe(F.col(n))
    return df.join(some, same, how)


def _outer(left: DataFrame, right: DataFrame, inner: DataFrame, lg: str, rg: str, how: str, equal: list[tuple[str, str]], residual: Column | None) -> DataFrame:
    one = list(dict.fromkeys([lg, *[l for l, _ in equal], *_read(inner, residual, left.columns)]))
    two = list(dict.fromkeys([rg, *[r for _, r in equal], *_read(inner, residual, right.columns)]))
    if how in ("left_semi", "left_anti"):
        return _partnered(left, inner, one, how)
    out = inner
    nothing = lambda d: [F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema]
    if how in ("left", "full"):
        out = out.unionByName(_partnered(left, inner, one, "left_anti").select(*[F.col(quoted(c)) for c in left.columns], *nothing(right)))
    if how in ("right", "full"):
        out = out.unionByName(_partnered(right, inner, two, "left_anti").select(*nothing(left), *[F.col(quoted(c)) for c in right.columns]))
    return out


def _disjoint(left: DataFrame, right: DataFrame, lg: str, rg: str, how: str, equal: list[tuple[str, str]], residual: Column | None) -> DataFrame:
    """ST_Disjoint without a cross join. A left row is disjoint from some right row if fewer right rows meet it than there are."""
    if how == "inner" and equal:
        on = F.lit(True)
        a, b = left.alias("a"), right.alias("b")
        for l, r in equal:
            on &= F.col(f"a.{quoted(l)}") == F.col(f"b.{quoted(r)}")
        joined = a.join(b, on).filter(scalar_udf("ST_Disjoint")(F.col(f"a.{quoted(lg)}"), F.col(f"b.{quoted(rg)}")))
        return joined if residual is None else joined.filter(residual)
    if how not in ("left_semi", "left_anti") or residual is not None:
        raise ValueError("ST_Disjoint cannot be joined by grid: use left_semi, left_anti, or equal columns; else crossJoin and a filter")
    keys, theirs = [lg, *[l for l, _ in equal]], [r for _, r in equal]
    keys = list(dict.fromkeys(keys))
    names = free_names([f"k{i}" for i in range(len(keys))], left)
    own = left.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keys, names, strict=True)]).distinct()
    by = dict(zip(keys, names, strict=True))
    others = right.toDF(*free_names([f"r{i}" for i in range(len(right.columns))], left, own))
    called = dict(zip(right.columns, others.columns, strict=True))
    n, total, *again = free_names(["n_meeting", "n_all", *[f"m{i}" for i in range(len(keys))]], left, own, others)
    meeting = spatial_join(own, others, "ST_Intersects", by[lg], called[rg], equal=[(by[l], called[r]) for l, r in equal]).groupBy(*names).agg(F.count(F.lit(1)).alias(n)).toDF(*again, n)
    own = own.join(meeting, _all([F.col(c).eqNullSafe(F.col(m)) for c, m in zip(names, again, strict=True)]), "left")
    some = others.filter(F.col(called[rg]).isNotNull())
    if equal:
        totals = some.groupBy(*[called[r] for r in dict.fromkeys(theirs)]).agg(F.count(F.lit(1)).alias(total))
        own = own.join(totals, _all([F.col(by[l]) == F.col(called[r]) for l, r in equal]))
    else:
        own = own.withColumn(total, F.lit(some.count()))
    apart = own.filter(F.col(by[lg]).isNotNull() & (F.coalesce(n, F.lit(0)) < F.col(total))).select(*names)
    return left.join(apart, _all([F.col(quoted(c)).eqNullSafe(F.col(by[c])) for c in keys]), how)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out
