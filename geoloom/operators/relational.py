"""Joins that Spark's planner has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], within: float | None = None) -> DataFrame:
    """left with the values of the last right row of the same keys at or before ``on``.

    One shuffle of both sides' union by key, and one pass in order; of right rows at one time
    the greatest values win.
    """
    l = left.select("*", F.lit(None).cast(right.schema[on].dataType).alias("_at"), F.lit(1).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    r = right.select(*by, F.col(on), F.col(on).alias("_at"), F.lit(0).alias("_left"), F.struct(*values).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(on, "_left", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = both.select("*", F.last(F.when(F.col("_left") == 0, F.struct("_at", "_v")), ignorenulls=True).over(order).alias("_m")).where("_left = 1")
    near = F.lit(True) if within is None else (F.col(on).cast("double") - F.col("_m._at").cast("double")) <= within
    return out.select(*left.columns, *[F.when(near, F.col(f"_m._v.{v}")).alias(v) for v in values])


def ranges(points: DataFrame, spans: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= value <= high``, met in buckets of ``width`` instead of by all pairs.

    Spans go to each bucket that they touch, so width should be near their usual length.
    """
    w = F.lit(float(width))
    s = spans.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / w), F.floor(F.col(high) / w))))
    p = points.withColumn("_bucket", F.floor(F.col(value) / w))
    return p.join(s, "_bucket").where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("_bucket")
