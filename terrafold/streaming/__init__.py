"""Spatial work on streams. Scalar functions need nothing: they run on each micro-batch as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native
from ..operators import spatial_join, st_extent


def running_extent(stream: DataFrame, point: str, keys: list[str] | None = None, time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extent of point structs per key and, with ``time`` and ``window``, per event-time window. The state is four numbers a group."""
    by = [F.col(k) for k in keys or []]
    if time and window:
        stream, by = stream.withWatermark(time, late), [F.window(time, window), *by]
    return stream.groupBy(*by).agg(st_extent(box=native.point_box(F.col(point))).alias("extent"), F.count(F.lit(1)).alias("n"))


def join_each_batch(static: DataFrame, pred: str, static_geom: str, stream_geom: str, sink: Callable[[DataFrame, int], None], **more) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that joins each micro-batch with a static table and hands the pairs to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(spatial_join(static, rows, pred, static_geom, stream_geom, **more), number)

    return batch
