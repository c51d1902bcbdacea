"""Tiles made by feature: one scan, an exploded cover and one grouped encoding for all zooms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.columns import hilbert


def first_features(df: DataFrame, tile: list[str], most: int, order: str) -> DataFrame:
    """At most so many features of each tile, in order; 0 is no limit."""
    if not most:
        return df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*tile).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def largest_layers(df: DataFrame, tile: list[str], layer: str, size: str, most: int = 5) -> DataFrame:
    """The largest layers of each tile: features, bytes and place."""
    sums = df.groupBy(*tile, layer).agg(F.count(F.lit(1)).alias("features"), F.sum(size).cast("long").alias("bytes"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy(*tile).orderBy(F.desc("bytes"), layer))).where(F.col("place") <= most)


def diagnostics(df: DataFrame, tile: list[str], layer: str, size: str, reference: int = 1_000_000, most: int = 5) -> DataFrame:
    """Of each tile its bytes, their per cent of the reference size and its largest layers."""
    layers = df.groupBy(*tile, layer).agg(F.count(F.lit(1)).alias("features"), F.sum(size).cast("long").alias("bytes"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("bytes", "features", F.col(layer).alias("layer"))), asc=False), 1, most)
    out = layers.groupBy(*tile).agg(F.sum("bytes").alias("bytes"), top.alias("largest"))
    return out.withColumn("percent", F.round(100.0 * F.col("bytes") / reference, 2))


def deduplicated(tiles: DataFrame, digest: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(images: tile_id, data; map: z, x, y, tile_id) of tiles (z, x, y, data)."""
    name = digest or (lambda c: F.sha2(c, 256))
    named = tiles.withColumn("tile_id", name(F.col("data")))
    # Equal names have equal data: any will do, and only one a task is shuffled.
    images = named.groupBy("tile_id").agg(F.any_value("data").alias("data"))
    return images, named.select("z", "x", "y", "tile_id")


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted tiles that are not stored."""
    return wanted.join(stored.select("z", "x", "y"), ["z", "x", "y"], "left_anti")


def read_through(wanted: DataFrame, stored: DataFrame, make: Callable[[DataFrame], DataFrame], minzoom: int = 0, maxzoom: int = 99) -> tuple[DataFrame, DataFrame]:
    """(tiles, new): data of the wanted addresses, from the store or made; and what was made within the stored zooms."""
    keys = ["z", "x", "y"]
    hits = wanted.select(*keys).join(stored.select(*keys, "data"), keys)
    made = make(missing(wanted.select(*keys), stored))
    return hits.unionByName(made.select(*keys, "data")), made.where(F.col("z").between(minzoom, maxzoom))


def in_curve_order(tiles: DataFrame, partitions: int) -> DataFrame:
    """Tiles dealt and sorted along the Hilbert curve, as archives want them."""
    named = tiles.withColumn("curve", hilbert(F.col("z"), F.col("x"), F.col("y")))
    return named.repartitionByRange(partitions, "curve").sortWithinPartitions("curve")
