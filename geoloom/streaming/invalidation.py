"""Streams of feature changes: counts by tile and window, and the tiles to make anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoloom.functions.columns import tile_of


def changed_tiles(changes: DataFrame, zooms: range, time: str = "ts", x: str = "x", y: str = "y", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """begin, z, x, y, changes: of a stream (or a batch) of changed points, by window; later rows than ``late`` go."""
    marked = changes.withWatermark(time, late) if changes.isStreaming else changes
    levels = marked.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    tx, ty = tile_of(F.col(x), F.col(y), F.col("z"))
    rows = levels.select(F.col(time).alias("_t"), "z", tx.alias("_x"), ty.alias("_y"))
    out = rows.groupBy(F.window("_t", window).alias("w"), "z", "_x", "_y").agg(F.count(F.lit(1)).alias("changes"))
    return out.select(F.col("w.start").alias("begin"), "z", F.col("_x").alias("x"), F.col("_y").alias("y"), "changes")


def remake(tiles: DataFrame, make: Callable[[DataFrame], DataFrame], put: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Make and store the changed tiles of each micro-batch."""

    def batch(df: DataFrame, _: int) -> None:
        put(make(df.select("z", "x", "y").distinct()))

    return tiles.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
