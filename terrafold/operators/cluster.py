"""Clustering of rows by the centroids of their geometries, by partition.

DBSCAN runs over a grid whose cells are so small that all positions in one are neighbours. Cells with enough rows are
all core, without looking at pairs; the positions of others look for neighbours in the cells around. Cells that hold core
positions are nodes: neighbouring ones are linked if a pair of their core positions is near, which mostly shows from their
extreme ones; the rest is searched among the positions that can reach the other cell. Clusters are the components of that graph, numbered in the order
of their first core row. So no task holds a partition, and equal positions are one.

k-means runs whole in a task for partitions of up to ``limit`` rows. Larger ones are spread: starts are drawn from all positions in rounds, each
in proportion to the distance from those before, and reduced to k; each round of assignment sends k sums a task.

Rows pass through unchanged; rows with a null or empty geometry, and DBSCAN's noise, get a null number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow
from ..functions.registry import scalar_udf
from ..geom import cluster, shape
from .join import free_names, kind, quoted
from .tables import Tables, components, numbered, same

#: Rows of a partition that k-means takes in one task.
LIMIT = 1 << 20
#: Rounds in which starts are drawn, and rounds of assignment.
DRAWS, ROUNDS = 5, 100


def _clustered(df: DataFrame, geom: str, by: list[str], order: list[str], out: str, how) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])
    at = df.columns.index(geom)

    def run(t: pa.Table) -> pa.Table:
        if order:  # the starts that k-means draws depend on the rows' order
            t = t.sort_by([(c, "ascending") for c in order])
        gs = arrow.geometries(pa.concat_arrays(t.column(at).chunks) if t.num_rows else t.column(at).combine_chunks(), "clustering")
        middles = [None if g is None else shape.centroid(g.plane()) for g in gs]
        where = [i for i, c in enumerate(middles) if c is not None]
        numbers: list[int | None] = [None] * len(gs)
        if where:
            for i, n in zip(where, how(np.array([middles[i] for i in where])).tolist(), strict=True):
                numbers[i] = None if n < 0 else n
        return t.append_column(out, pa.array(numbers, pa.int32()))

    return df.groupBy(*by).applyInArrow(run, schema)


def _placed(df: DataFrame, geom: str) -> tuple[Column, Column]:
    """x and y of a geometry's centroid; null if it has none."""
    g, k = F.col(quoted(geom)), kind(df, geom)
    if k == "point":
        x, y = g["x"], g["y"]
    elif k == "box":
        x, y = (g["xmin"] + g["xmax"]) / 2, (g["ymin"] + g["ymax"]) / 2
    else:
        middle = scalar_udf("ST_Centroid")(g)
        x, y = scalar_udf("ST_X")(middle), scalar_udf("ST_Y")(middle)
    sure = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return F.when(sure, x), F.when(sure, y)


def cluster_kmeans(df: DataFrame, geom: str, k: int, by: list[str] | None = None, order: list[str] | None = None, out: str = "cluster", limit: int = LIMIT) -> DataFrame:
    """k-means with a fixed seed; k of 0 or more than a partition's positions is an error."""
    by = by or []
    x, y = _placed(df, geom)
    large = df.filter(x.isNotNull()).groupBy(*[F.col(quoted(c)) for c in by]).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).collect()  # each has over ``limit`` rows
    found, rest = [], df
    for r in large:
        own = same([F.col(quoted(c)) for c in by], [F.lit(v) for v in r[:-1]])
        rest = rest.filter(~own)
        found.append(_spread_kmeans(df.filter(own), geom, k, r[-1], out))
    if by or not large:
        found.append(_clustered(rest, geom, by, order or [], out, lambda p: cluster.kmeans(p, k)))
    else:
        found.append(rest.withColumn(out, F.lit(None).cast("int")).filter(F.lit(False)))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole


def nearest(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each position's nearest centre, and the squared distance to it."""
    label, far = [], []
    for q in np.array_split(p, max(1, len(p) * len(c) // 4_000_000)):
        d = ((q[:, None] - c[None]) ** 2).sum(2)
        label.append(d.argmin(1))
        far.append(d.min(1) if len(q) else np.zeros(0))
    return np.concatenate(label), np.concatenate(far)


def _positions(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]), b.column(2).to_numpy()


def _sums(places: DataFrame, c: np.ndarray) -> list[tuple]:
    """(centre, sum of x, sum of y, rows) of the positions nearest to each centre: k rows a task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(c), 3))
        for b in batches:
            p, n = _positions(b)
            label, _ = nearest(p, c)
            for j, w in enumerate((p[:, 0] * n, p[:, 1] * n, n)):
                total[:, j] += np.bincount(label, w, len(c))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c)), pa.int32()), *[pa.array(total[:, j]) for j in range(3)]], names=["c", "sx", "sy", "n"])

    return [tuple(r) for r in places.mapInArrow(run, "c int, sx double, sy double, n double").groupBy("c").agg(F.sum("sx"), F.sum("sy"), F.sum("n")).collect()]


def _starts(places: DataFrame, k: int) -> np.ndarray:
    """k starts from candidates that are drawn in a few rounds, about 2 k in each, in proportion to their squared distance from those before."""

    def u(r: int) -> Column:  # a number in (0, 1) that a position has in a round
        return (F.shiftrightunsigned(F.xxhash64("x", "y", F.lit(r), F.lit(cluster.SEED)), 11) + 0.5) / float(1 << 53)

    first = places.orderBy(u(0), "x", "y").limit(1).collect()
    c = np.array([(r.x, r.y) for r in first])
    for r in range(1, DRAWS + 1):
        far = F.arrow_udf(_far(c), "double")(F.col("x"), F.col("y"))
        seen = places.withColumn("cost", far * F.col("n"))
        phi = seen.agg(F.sum("cost")).first()[0]
        if not phi:
            break
        drawn = seen.filter(u(r) * phi < 2.0 * k * F.col("cost")).select("x", "y").collect()  # about 2 k, whatever the table holds
        if drawn:
            c = np.unique(np.vstack([c, [(d.x, d.y) for d in drawn]]), axis=0)
    if len(c) < k:
        more = places.orderBy(u(DRAWS + 1), "x", "y").limit(2 * k).collect()
        c = np.unique(np.vstack([c, [(d.x, d.y) for d in more]]), axis=0)
    weight = np.zeros(len(c))
    for j, _, _, n in _sums(places, c):
        weight[j] = n
    rng = np.random.default_rng(cluster.SEED)
    picked = [int(weight.argmax())]
    near = ((c - c[picked[0]]) ** 2).sum(1)
    for _ in range(1, k):
        cost = near * weight
        at = int(rng.choice(len(c), p=cost / cost.sum())) if cost.sum() > 0 else int(rng.integers(len(c)))
        picked.append(at)
        near = np.minimum(near, ((c - c[at]) ** 2).sum(1))
    return c[picked]


def _far(c: np.ndarray):
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(nearest(np.column_stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)]), c)[1])

    return run


def _label(c: np.ndarray):
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        p = np.column_stack([np.asarray(x.to_numpy(zero_copy_only=False), float), np.asarray(y.to_numpy(zero_copy_only=False), float)])
        gone = np.isnan(p).any(1)
        p[gone] = 0
        return pa.array(nearest(p, c)[0].astype(np.int32), pa.int32(), mask=gone)

    return run


def _spread_kmeans(df: DataFrame, geom: str, k: int, n: int, out: str) -> DataFrame:
    if k <= 0 or k > n:
        raise ValueError(f"k must be between 1 and the {n} rows with a position, but is {k}")
    tables = Tables(df.sparkSession)
    x, y = _placed(df, geom)
    places = tables.write(df.select(x.alias("x"), y.alias("y")).filter(F.col("x").isNotNull()).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "places")
    c = _starts(places, k)
    for _ in range(ROUNDS):
        new = c.copy()
        for j, sx, sy, many in _sums(places, c):
            if many:
                new[j] = sx / many, sy / many
        moved = np.abs(new - c).max()
        c = new
        if moved <= 1e-12 * max(1.0, float(np.abs(c).max())):  # sums may differ in their last digits from round to round
            break
    tables.drop("places")
    return df.withColumn(out, F.arrow_udf(_label(c), "int")(x, y))


def cluster_dbscan(df: DataFrame, geom: str, eps: float, min_points: int, by: list[str] | None = None, order: list[str] | None = None, out: str = "cluster") -> DataFrame:
    """DBSCAN; a row counts among its own neighbours. eps must be positive and finite. Clusters are numbered per partition in the order of their first core row
    (by ``order``, then x and y); a row near several clusters and no core row is the first one's."""
    if not np.isfinite(eps) or eps <= 0:
        raise ValueError("eps must be a positive number")
    by, order = by or [], order or []
    tables = Tables(df.sparkSession)
    keys = [f"b{i}" for i in range(len(by))]
    px, py = _placed(df, geom)
    x, y = F.col("x"), F.col("y")
    rows = df.select(*[F.col(quoted(c)).alias(k) for c, k in zip(by, keys, strict=True)], px.alias("x"), py.alias("y"), F.struct(*[F.col(quoted(c)).alias(f"o{i}") for i, c in enumerate(order)], px.alias("ox"), py.alias("oy")).alias("first"))
    side = eps * 0.7  # the diagonal of a cell is below eps
    cell = [F.floor(x / side).alias("cx"), F.floor(y / side).alias("cy")]
    places = rows.filter(x.isNotNull()).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).select("*", *cell)
    places = tables.write(places, "places")
    around = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)]
    near = lambda offsets: F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    within = lambda p, q: (F.col(f"{p}.x") - F.col(f"{q}.x")) * (F.col(f"{p}.x") - F.col(f"{q}.x")) + (F.col(f"{p}.y") - F.col(f"{q}.y")) * (F.col(f"{p}.y") - F.col(f"{q}.y")) <= eps * eps
    place = [*keys, "cx", "cy"]
    at = lambda p, names: [F.col(f"{p}.{c}") for c in names]

    counts = places.groupBy(*place).agg(F.sum("n").alias("own"))
    counted = tables.write(places.alias("p").join(counts.alias("c"), same(at("p", place), at("c", place))).select("p.*", "own"), "counted")
    sparse = counted.filter(F.col("own") < min_points)

    def looking(d: DataFrame, offsets) -> DataFrame:
        """Positions with the cells around them."""
        return d.withColumn("to", near(offsets)).withColumn("ax", F.col("cx") + F.col("to.a")).withColumn("ay", F.col("cy") + F.col("to.b"))

    # A cell with few rows has few positions, so what they see in a crowded one is in proportion to it.
    seen = looking(sparse, around).alias("p").join(places.alias("q"), same(at("p", [*keys, "ax", "ay"]), at("q", place))).filter(within("p", "q"))
    seen = seen.groupBy(*at("p", [*keys, "x", "y"])).agg(F.sum("q.n").alias("others"))
    judged = sparse.alias("p").join(seen.alias("s"), same(at("p", [*keys, "x", "y"]), at("s", [*keys, "x", "y"])), "left").select("p.*", (F.col("own") + F.coalesce("others", F.lit(0)) >= min_points).alias("core"))
    judged = tables.write(judged.unionByName(counted.filter(F.col("own") >= min_points).withColumn("core", F.lit(True))), "judged")
    core = judged.filter("core").drop("own", "core")

    spot = F.struct("x", "y")
    extremes = [f(spot, v) for v in (x, y, x + y, x - y) for f in (F.min_by, F.max_by)]
    nodes = core.groupBy(*place).agg(F.min("first").alias("first"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.array(*extremes).alias("rim"))
    nodes = tables.write(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    half = [(a, b) for a, b in around if (a, b) > (0, 0)]
    pairs = looking(nodes, half).alias("p").join(nodes.alias("q"), same(at("p", [*keys, "ax", "ay"]), at("q", place)))
    apart = lambda a: F.greatest(F.col(f"p.{a}1") - F.col(f"q.{a}2"), F.col(f"q.{a}1") - F.col(f"p.{a}2"), F.lit(0.0))
    pairs = pairs.filter(apart("x") * apart("x") + apart("y") * apart("y") <= eps * eps)
    sure = F.exists("p.rim", lambda a: F.exists("q.rim", lambda b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) <= eps * eps))
    box = lambda p: F.struct(*[F.col(f"{p}.{c}").alias(c) for c in ("x1", "x2", "y1", "y2")])
    pairs = tables.write(pairs.select(F.col("p.id").alias("u"), F.col("q.id").alias("v"), sure.alias("sure"), box("p").alias("ub"), box("q").alias("vb")), "pairs")
    open_pairs = pairs.filter(~F.col("sure"))
    members = tables.write(core.alias("p").join(nodes.alias("c"), same(at("p", place), at("c", place))).select("p.*", "c.id"), "members")

    def reaching(end: str, other: str) -> DataFrame:
        """The core positions of one end of an open pair that are near enough to the other end's box."""
        b = F.col(f"e.{other}")
        dx, dy = F.greatest(b["x1"] - F.col("m.x"), F.col("m.x") - b["x2"], F.lit(0.0)), F.greatest(b["y1"] - F.col("m.y"), F.col("m.y") - b["y2"], F.lit(0.0))
        return open_pairs.alias("e").join(members.alias("m"), F.col(f"e.{end}") == F.col("m.id")).filter(dx * dx + dy * dy <= eps * eps).select("e.u", "e.v", "m.x", "m.y")

    met = reaching("u", "vb").alias("p").join(reaching("v", "ub").alias("q"), (F.col("p.u") == F.col("q.u")) & (F.col("p.v") == F.col("q.v"))).filter(within("p", "q")).select("p.u", "p.v").distinct()
    roots = components(pairs.filter("sure").select("u", "v").unionByName(met), tables)
    rooted = tables.write(nodes.join(roots, nodes["id"] == roots["u"], "left").select(*place, "first", F.coalesce("root", "id").alias("root")), "rooted")
    firsts = rooted.groupBy(*keys, "root").agg(F.min("first").alias("first"))
    ranks = numbered(firsts, [*keys, "first"], tables, "rank").drop("first")
    lowest = ranks.groupBy(*keys).agg(F.min("rank").alias("low")) if keys else None
    if lowest is not None:
        ranks = ranks.alias("r").join(lowest.alias("l"), same(at("r", keys), at("l", keys))).select("r.root", (F.col("rank") - F.col("low")).alias("rank"))
    named = tables.write(rooted.alias("c").join(ranks.alias("r"), F.col("c.root") == F.col("r.root")).select(*at("c", place), F.col("r.rank").cast("int").alias("number")), "named")
    known = tables.write(core.alias("p").join(named.alias("c"), same(at("p", place), at("c", place))).select(*at("p", [*keys, "x", "y", "cx", "cy"]), "number"), "known")
    edge = looking(judged.filter(~F.col("core")), [*around, (0, 0)]).alias("p").join(known.alias("q"), same(at("p", [*keys, "ax", "ay"]), at("q", place))).filter(within("p", "q"))
    edge = edge.groupBy(*at("p", [*keys, "x", "y"])).agg(F.min("q.number").alias("number"))
    labels = tables.write(known.select(*keys, "x", "y", "number").unionByName(edge), "labels")
    tables.drop("places", "counted", "judged", "nodes", "pairs", "members", "rooted", "named", "known", "numbered")
    return _with_numbers(df, labels, by, keys, px, py, out)


def _with_numbers(df: DataFrame, labels: DataFrame, by: list[str], keys: list[str], px: Column, py: Column, out: str) -> DataFrame:
    """Rows with the number of their partition and position."""
    names = free_names([f"l{i}" for i in range(len(keys) + 3)], df)
    found = labels.toDF(*names)
    x, y = free_names(["px", "py"], df, found)
    mine = df.withColumn(x, px).withColumn(y, py)
    on = same([F.col(quoted(c)) for c in by], [F.col(n) for n in names[: len(keys)]]) & (F.col(x) == F.col(names[-3])) & (F.col(y) == F.col(names[-2]))
    return mine.join(found, on, "left").select(*[F.col(quoted(c)) for c in df.columns], F.col(names[-1]).alias(out))
