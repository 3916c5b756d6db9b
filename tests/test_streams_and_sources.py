"""Streams and sources."""

from pyspark.sql import functions as F

from terrafold import sources, streaming
from terrafold.functions import call, native


def test_running_extent_and_batch_join(spark, tmp_path):
    t = spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.col("id").cast("double").alias("x"))
    t.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("p", native.st_point(F.col("x"), -F.col("x")))
    q = streaming.running_extent(stream, "p", ["k"]).writeStream.outputMode("complete").format("memory").queryName("extents").start()
    q.processAllAvailable()
    q.stop()
    found = {r.k: r for r in spark.table("extents").collect()}
    assert {k: (r.extent.xmin, r.extent.ymin, r.extent.xmax, r.n) for k, r in found.items()} == {0: (0.0, -99.0, 99.0, 34), 1: (1.0, -97.0, 97.0, 33), 2: (2.0, -98.0, 98.0, 33)}
    boxes = spark.createDataFrame([(1, 0.0, -10.0, 10.0, 0.0)], "b int, a double, c double, d double, e double").select("b", native.st_make_envelope(F.col("a"), F.col("c"), F.col("d"), F.col("e")).alias("box"))
    seen = []
    q = stream.writeStream.foreachBatch(streaming.join_each_batch(boxes, "ST_Intersects", "box", "p", lambda df, _: seen.extend(r.id for r in df.collect()))).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == list(range(11))
    w = streaming.running_extent(stream, "p", time="ts", window="10 minutes")
    q = w.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("windows").orderBy("window").collect()] == [20] * 5


def test_sources_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", "POINT(1 2)"), (2, None, "POLYGON((0 0,1 0,1 1,0 0))"), (3, "c", None)], "id int, name string, w string")
    g = t.select("id", "name", sources.decoded(F.col("w"), "wkt", 4326).alias("geom"))
    sources.write_geojson_lines(g, str(tmp_path / "lines"))
    back = sources.read_geojson_lines(spark, str(tmp_path / "lines"), "id int, name string")
    assert sorted(map(tuple, back.select("id", "name", call("ST_AsText", F.col("geom"))).collect())) == sorted(map(tuple, t.collect()))
    assert [r[0] for r in g.select(call("ST_SRID", F.col("geom"))).collect()] == [4326, 4326, None]
    for e in ("wkb", "ewkb", "geojson"):
        out = t.select(sources.encoded(sources.decoded(sources.encoded(F.col("w"), e), e), "wkt").alias("w")).collect()
        assert [r.w for r in out] == [r.w for r in t.collect()]
