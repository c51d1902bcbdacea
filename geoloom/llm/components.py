"""Connected components by alternating large and small stars, one checkpoint a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.checkpoints import checkpoint


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least of each node and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


#: Edges of a task; small graphs are gathered in few tasks, or each round would write a file for every pair of partitions.
TASK_EDGES = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that is reachable) of every node on an edge; nodes are longs.

    Loops and repeated edges do no harm; nulls are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    known = _sums(e)
    while True:
        tasks = max(2, -(-known[0] // TASK_EDGES))
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        # Large star: neighbours above u hang on the least neighbour.
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        # Small star: u and its neighbours below it hang on the least of them.
        low = large.join(_least(large), "u")
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = checkpoint(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        before, known = known, _sums(e)
        if before == known:
            return _labels(e)


def _sums(e: DataFrame) -> tuple:
    """Number and digest of the edges."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _labels(e: DataFrame) -> DataFrame:
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
