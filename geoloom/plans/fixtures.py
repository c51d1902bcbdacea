"""Collections derived from the driver's tables; the SQL of each stands beside it.

Coordinates are whole-number arithmetic and one multiplication, so any engine gets the same
doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.columns import haversine
from geoloom.operators.features import Collection


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EV = """(SELECT event_id AS fid, ts, user_id, event_type, value, props,
 CAST((user_id * 7919 + event_id * 104729) % 40075 AS DOUBLE) * 1000.0e0 - 20037000.0e0 AS x,
 CAST((user_id * 15485863 + event_id * 32452843) % 40075 AS DOUBLE) * 1000.0e0 - 20037000.0e0 AS y FROM events)"""


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    place = lambda a, b: ((F.col("user_id") * a + F.col("event_id") * b) % 40075).cast("double") * 1000.0 - 20037000.0
    return e.select(F.col("event_id").alias("fid"), "ts", "user_id", "event_type", "value", "props", place(7919, 104729).alias("x"), place(15485863, 32452843).alias("y"))


def event_collection(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection("event_points", event_points(spark, sf_dir), "fid", "x", "y", start="ts", queryable=("event_type", "user_id", "value"), srid=3857)


CU = """(SELECT c_custkey AS fid, c_name, c_nationkey, c_mktsegment,
 CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100.0e0 - 180.0e0 AS lon, CAST((c_custkey * 104729) % 17000 AS DOUBLE) / 100.0e0 - 85.0e0 AS lat FROM customer)"""


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    part = lambda a, m, o: ((F.col("c_custkey") * a) % m).cast("double") / 100.0 - o
    return c.select(F.col("c_custkey").alias("fid"), "c_name", "c_nationkey", "c_mktsegment", part(7919, 36000, 180.0).alias("lon"), part(104729, 17000, 85.0).alias("lat"))


def customer_collection(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection("customer_points", customer_points(spark, sf_dir), "fid", "lon", "lat", queryable=("c_nationkey", "c_mktsegment", "fid"))


OL_POINTS = """(SELECT l_orderkey AS fid, l_linenumber AS n,
 CAST((l_orderkey * 7919) % 40000 AS DOUBLE) * 1000.0e0 - 20000000.0e0 + CAST(l_partkey % 200 AS DOUBLE) * 5000.0e0 AS x,
 CAST((l_orderkey * 104729) % 40000 AS DOUBLE) * 1000.0e0 - 20000000.0e0 + CAST(l_suppkey % 100 AS DOUBLE) * 5000.0e0 AS y FROM lineitem)"""
OL = f"(SELECT fid, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, CAST(count(*) AS BIGINT) AS vertices FROM {OL_POINTS} GROUP BY fid)"


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    at = lambda a, k, m: ((F.col("l_orderkey") * a) % 40000).cast("double") * 1000.0 - 20000000.0 + (F.col(k) % m).cast("double") * 5000.0
    return l.select(F.col("l_orderkey").alias("fid"), F.col("l_linenumber").alias("n"), at(7919, "l_partkey", 200).alias("x"), at(104729, "l_suppkey", 100).alias("y"))


def order_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = line_points(spark, sf_dir)
    return p.groupBy("fid").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.count(F.lit(1)).alias("vertices"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, points in line order; an order has few lines."""
    p = line_points(spark, sf_dir)
    lines = p.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("a"))
    return lines.select("fid", F.transform("a", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


OS = "(SELECT o_orderkey AS fid, o_orderdate AS start_at, max(l_shipdate) AS end_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate)"


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ends = l.groupBy(F.col("l_orderkey").alias("fid")).agg(F.max("l_shipdate").alias("end_at"))
    return o.select(F.col("o_orderkey").alias("fid"), F.col("o_orderdate").alias("start_at")).join(ends, "fid")


def span_collection(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection("order_spans", order_spans(spark, sf_dir), "fid", start="start_at", end="end_at")


GN = "(SELECT CAST(n_nationkey AS BIGINT) AS id, CAST((n_nationkey * 37) % 50 AS DOUBLE) AS x, CAST((n_nationkey * 23) % 40 AS DOUBLE) AS y FROM nation)"


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), ((F.col("n_nationkey") * 37) % 50).cast("double").alias("x"), ((F.col("n_nationkey") * 23) % 40).cast("double").alias("y"))


_ONE_WAY = f"""SELECT DISTINCT a.id AS src, b.id AS dst, CAST(ceil(2 * 6371008.8e0 * asin(sqrt(
  sin(radians(b.y - a.y) / 2) * sin(radians(b.y - a.y) / 2) + cos(radians(a.y)) * cos(radians(b.y)) * sin(radians(b.x - a.x) / 2) * sin(radians(b.x - a.x) / 2)))) AS BIGINT) AS weight
 FROM {GN} a JOIN {GN} b ON b.id = (2 * a.id + 1) % 25 OR b.id = (a.id + 1) % 25"""
GE = f"(SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM ({_ONE_WAY}) UNION ALL SELECT dst, src, weight FROM ({_ONE_WAY})) GROUP BY src, dst)"


def graph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, cost: an edge table as a routing schema has it."""
    n = graph_nodes(spark, sf_dir)
    ends = n.select("id", "x", "y", F.explode(F.array((2 * F.col("id") + 1) % 25, (F.col("id") + 1) % 25)).alias("target"))
    far = n.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return ends.join(far, "target").select(F.col("id").alias("source"), "target", haversine(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")).alias("cost")).distinct()


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.operators.routing import edges_from_table

    return edges_from_table(graph_table(spark, sf_dir), graph_nodes(spark, sf_dir))


_LINKS = "SELECT c_custkey AS src, (c_custkey * {a} + {b}) % (SELECT max(c_custkey) FROM customer) + 1 AS dst, CAST(1 + (c_custkey * {w}) % 97 AS BIGINT) AS weight FROM customer"
_THREE = ((1, 0, 31), (2, 1, 57), (3, 2, 83))
CE = "(" + " UNION ALL ".join(_LINKS.format(a=a, b=b, w=w) for a, b, w in _THREE) + ")"


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three links of each customer to others."""
    c = table(spark, sf_dir, "customer")
    n = c.agg(F.max("c_custkey").alias("n"))
    links = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in _THREE])
    rows = c.select("c_custkey", F.explode(links).alias("l")).join(F.broadcast(n))
    return rows.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * F.col("l.a") + F.col("l.b")) % F.col("n") + 1).alias("dst"), (1 + (F.col("c_custkey") * F.col("l.w")) % 97).cast("long").alias("weight"))


def swiss_grid():
    """A grid over Switzerland in its own frame."""
    from geoloom.operators.grids import PIXEL, Grid, Level

    levels = []
    for z, cell in enumerate((4000.0, 2000.0, 1000.0, 250.0, 100.0)):
        side = 256 * cell
        levels.append(Level(z, cell, cell / PIXEL, 2420000.0, 1350000.0, 256, 256, math.ceil(480000 / side), math.ceil(320000 / side)))
    return Grid("Swiss", 2056, tuple(levels), "Switzerland")
