"""Routing over edge and node tables: loading, snapping, shortest paths and their documents."""

from __future__ import annotations

import heapq
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import wkb
from geoloom.functions.columns import haversine, polyline

SEARCH = 0.01


class RoutingError(Exception):
    pass


class NodeNotFound(RoutingError):
    pass


class NoRoute(RoutingError):
    pass


def edges_from_table(edges: DataFrame, nodes: DataFrame, source="source", target="target", cost="cost") -> DataFrame:
    """src, dst, weight in both directions of table edges whose ends are known; weight is the cost rounded up."""
    ids = nodes.select("id").distinct()
    e = edges.select(F.col(source).alias("src"), F.col(target).alias("dst"), F.ceil(F.col(cost)).cast("long").alias("weight"))
    e = e.join(ids.select(F.col("id").alias("src")), "src").join(ids.select(F.col("id").alias("dst")), "dst")
    return both_ways(e)


def both_ways(e: DataFrame) -> DataFrame:
    """Each edge in both directions, the least weight of parallel ones."""
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return e.select("src", "dst", "weight").unionAll(back).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def nodes_by_place(points: DataFrame, x="x", y="y") -> DataFrame:
    """id, x, y: one node for each distinct place.

    The id is a 64-bit hash of the place, so it needs no order and no pass over one partition.
    """
    return points.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct().select(F.xxhash64("x", "y").alias("id"), "x", "y")


def numbered(nodes: DataFrame) -> DataFrame:
    """Dense ids from 0 by (x, y) for small node sets; one partition sorts them."""
    from pyspark.sql import Window

    return nodes.select((F.row_number().over(Window.orderBy("x", "y")) - 1).cast("long").alias("id"), "x", "y")


def next_id(nodes: DataFrame) -> DataFrame:
    """next: the first id above those of numbered nodes; 0 where there are none."""
    return nodes.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).cast("long").alias("next"))


def line_points(df: DataFrame, geometry: str) -> DataFrame:
    """points of each line of a geometry column (GeoPackage or plain blobs); other kinds and nulls are left out."""

    def run(batches):
        for b in batches:
            out = []
            for blob in b.column(0).to_pylist():
                if blob is None:
                    continue
                kind, c = wkb.decode_gpkg(blob)[0] if blob[:2] == b"GP" else wkb.decode(blob)
                lines = [c] if kind == "LineString" else c if kind == "MultiLineString" else []
                out += [[{"x": float(p[0]), "y": float(p[1])} for p in line] for line in lines]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], ["points"])

    return df.select(F.col(geometry)).mapInArrow(run, "points array<struct<x: double, y: double>>")


def graph_of(spark: SparkSession, database: tuple[DataFrame, DataFrame] | None = None, gpkg: tuple[str, str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the configured source: the edge and node tables of a database if there are any, else the lines of (path, table, geometry) of a GeoPackage."""
    if database:
        edges, nodes = database
        return nodes, edges_from_table(edges, nodes)
    if gpkg:
        from geoloom.sources.gpkg import read

        path, table, geometry = gpkg
        return edges_from_lines(line_points(read(spark, path, table), geometry))
    raise RoutingError("no source of a graph")


def edges_from_lines(lines: DataFrame, points: str = "points", ellipsoid: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of linestrings: the ends are nodes, the length rounded to metres the weight.

    Lengths follow the ellipsoid, in Arrow batches, or the sphere, as expressions.
    """
    from geoloom.functions.columns import line_length
    from geoloom.functions.geometry import length_batches

    real = lines.where(F.size(points) >= 2).select(F.struct(F.element_at(points, 1).alias("a"), F.element_at(points, -1).alias("b")).alias("k"), F.col(points).alias("points"))
    if ellipsoid:
        measured = real.mapInArrow(length_batches, f"k {real.schema['k'].dataType.simpleString()}, metres double")
    else:
        measured = real.select("k", line_length(F.col("points")).alias("metres"))
    flat = measured.select(F.col("k.a.x").alias("ax"), F.col("k.a.y").alias("ay"), F.col("k.b.x").alias("bx"), F.col("k.b.y").alias("by"), F.round("metres").cast("long").alias("weight"))
    nodes = nodes_by_place(flat.select(F.col("ax").alias("x"), F.col("ay").alias("y")).unionAll(flat.select("bx", "by")))
    e = flat.select(F.xxhash64("ax", "ay").alias("src"), F.xxhash64("bx", "by").alias("dst"), "weight")
    return nodes, both_ways(e)


def nearest(queries: DataFrame, nodes: DataFrame, search: float = SEARCH, key: str = "qid") -> DataFrame:
    """key, id, d2 of the nearest node by squared distance below ``search``; ties go to the smaller id.

    Both sides are dealt by grid cells of the search radius and the queries go to the nine cells
    around them, so only near pairs meet.
    """
    side = math.sqrt(search)
    cell = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    n = nodes.select(F.col("id"), F.col("x").alias("nx"), F.col("y").alias("ny"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.sequence(F.lit(-1), F.lit(1))
    q = queries.select(key, F.col("x").alias("qx"), F.col("y").alias("qy"), cell("x").alias("ox"), cell("y").alias("oy"))
    q = q.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    q = q.select(key, "qx", "qy", (F.col("ox") + F.col("dx")).alias("cx"), (F.col("oy") + F.col("dy")).alias("cy"))
    dx, dy = F.col("nx") - F.col("qx"), F.col("ny") - F.col("qy")
    pairs = q.join(n, ["cx", "cy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") < search)
    best = pairs.groupBy(key).agg(F.min(F.struct("d2", "id")).alias("b"))
    return best.select(key, F.col("b.id").alias("id"), F.col("b.d2").alias("d2"))


#: Edges up to which a graph is sent to the tasks as a whole (three longs each, 24 MB), and rows of a tree that are fetched.
LOCAL_EDGES = 1_000_000


def shortest(edges: DataFrame, sources: DataFrame, targets: dict[int, list[int]] | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """source, node, cost, parent of every node that a source reaches, or that the search for its targets settles.

    A graph of few edges (counted first) is broadcast, and each source searched by Dijkstra where
    it lies.  A larger one is relaxed in rounds: each round follows the edges of nodes whose cost
    fell in the round before, keeps offers that better the known costs, and writes these alone;
    with targets, offers no better than the farthest of a source's targets are dropped.  The
    parent is the least node that a shortest path can come from.
    """
    sources = sources.select(F.col("source").cast("long").alias("source")).distinct()
    if edges.limit(local_edges + 1).count() <= local_edges:
        return _searched(edges, sources, targets or {})
    return _relaxed(edges, sources, targets or {})


_TREE = "source long, node long, cost long, parent long"


def _searched(edges: DataFrame, sources: DataFrame, targets: dict[int, list[int]]) -> DataFrame:
    table = edges.select("src", "dst", F.col("weight").cast("long").alias("weight")).toArrow()
    held = edges.sparkSession.sparkContext.broadcast([table[c].to_numpy() for c in ("src", "dst", "weight")])

    def search(batches):
        nexts = None
        for b in batches:
            nexts = nexts or neighbours(*held.value)
            for s in b.column("source").to_pylist():
                best, parent = settled(nexts, s, targets.get(s))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s] * len(best), pa.int64()), pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64()), pa.array([parent[n] for n in best], pa.int64())],
                    ["source", "node", "cost", "parent"],
                )

    return sources.mapInArrow(search, _TREE)


def _relaxed(edges: DataFrame, sources: DataFrame, targets: dict[int, list[int]]) -> DataFrame:
    from geoloom.functions.checkpoints import checkpoint

    spark = edges.sparkSession
    front = checkpoint(sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost")))
    known = front
    goals = [(s, t) for s, ts in targets.items() for t in ts]
    wanted = spark.createDataFrame(goals, "source long, node long") if goals else None
    while front.take(1):
        offers = front.join(edges, front["node"] == edges["src"]).select("source", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).cast("long").alias("cost"))
        offers = offers.groupBy("source", "node").agg(F.min("cost").alias("cost"))
        if wanted is not None:
            # A source all of whose targets are reached looks no further than the farthest.
            got = wanted.join(known, ["source", "node"], "left").groupBy("source", "node").agg(F.min("cost").alias("c"))
            bound = got.groupBy("source").agg(F.when(F.count("c") == F.count(F.lit(1)), F.max("c")).alias("bound"))
            offers = offers.join(F.broadcast(bound), "source", "left").where("bound IS NULL OR cost < bound").drop("bound")
        before = known.groupBy("source", "node").agg(F.min("cost").alias("old"))
        front = checkpoint(offers.join(before, ["source", "node"], "left").where("old IS NULL OR cost < old").drop("old"))
        known = known.unionAll(front)
    best = checkpoint(known.groupBy("source", "node").agg(F.min("cost").alias("cost")))
    come = best.join(edges, best["node"] == edges["src"]).select("source", F.col("src").alias("parent"), F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"))
    parents = best.join(come, ["source", "node", "cost"]).where("node <> source").groupBy("source", "node").agg(F.min("parent").alias("parent"))
    return best.join(parents, ["source", "node"], "left").select("source", "node", "cost", "parent")


def neighbours(src, dst, weight) -> dict[int, list[tuple[int, int]]]:
    nexts: dict[int, list[tuple[int, int]]] = {}
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        nexts.setdefault(a, []).append((b, w))
    return nexts


def settled(nexts: dict[int, list[tuple[int, int]]], source: int, targets: list[int] | None = None) -> tuple[dict[int, int], dict[int, int | None]]:
    """Cost and parent of each node in order of cost, up to the last of the targets."""
    offer: dict[int, int] = {source: 0}
    best: dict[int, int] = {}
    parent: dict[int, int | None] = {source: None}
    heap = [(0, source)]
    left = set(targets) if targets else None
    while heap:
        c, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = c
        if left is not None:
            left.discard(u)
            if not left:
                break
        for v, w in nexts.get(u, ()):
            if c + w < offer.get(v, 1 << 62):
                offer[v], parent[v] = c + w, u
                heapq.heappush(heap, (c + w, v))
            elif c + w == offer[v] and v not in best and u < parent[v]:
                parent[v] = u
    return best, parent


def path(tree: DataFrame, source: int, target: int, most: int = LOCAL_EDGES) -> list[int]:
    """Nodes from source to target along the parents.

    A tree of up to ``most`` nodes is fetched; of a larger one the chain alone, by joins that
    double the step.
    """
    from geoloom.functions.checkpoints import checkpoint

    mine = tree.where(F.col("source") == source).select("node", "parent")
    if mine.limit(most + 1).count() > most:
        jump = checkpoint(mine.where("parent IS NOT NULL"))
        chain = checkpoint(mine.where(F.col("node") == target).select("node"))
        size = chain.count()
        while True:
            up = chain.join(jump, "node").select(F.col("parent").alias("node"))
            chain = checkpoint(chain.unionAll(up).distinct())
            if size == (size := chain.count()):
                break
            then = jump.select(F.col("node").alias("parent"), F.col("parent").alias("far"))
            jump = checkpoint(jump.join(then, "parent").select("node", F.col("far").alias("parent")))
        mine = mine.join(chain, "node", "left_semi")
    found = {r.node: r.parent for r in mine.toLocalIterator()}
    if target not in found:
        raise NoRoute(f"{source} to {target}")
    out = [target]
    while out[-1] != source:
        out.append(found[out[-1]])
    return out[::-1]


def dijkstra(edges: list[tuple[int, int, int]], source: int, target: int) -> tuple[int, list[int]]:
    """Cost and nodes of the shortest path over edges that fit on one machine."""
    nexts: dict[int, list[tuple[int, int]]] = {}
    for a, b, w in edges:
        nexts.setdefault(a, []).append((b, w))
    best, parent = settled(nexts, source, [target])
    if target not in best:
        raise NoRoute(f"{source} to {target}")
    out = [target]
    while out[-1] != source:
        out.append(parent[out[-1]])
    return best[target], out[::-1]


class Router:
    """Routes between places over a graph of nodes(id, x, y) and edges(src, dst, weight)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, search: float = SEARCH):
        self.spark: SparkSession = nodes.sparkSession
        self.nodes, self.edges, self.search = nodes, edges, search

    def snap(self, points: list[tuple[float, float]]) -> list[int]:
        q = self.spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "qid long, x double, y double")
        got = {r.qid: r.id for r in nearest(q, self.nodes, self.search).collect()}
        for i in range(len(points)):
            if i not in got:
                raise NodeNotFound(points[i])
        return [got[i] for i in range(len(points))]

    def route(self, points: list[tuple[float, float]], form: str = "geojson") -> dict:
        """The route through all points."""
        if len(points) < 2:
            raise RoutingError("a route needs two points")
        ids = self.snap(points)
        cost, nodes = 0, [ids[0]]
        sources = self.spark.createDataFrame([(i,) for i in sorted(set(ids[:-1]))], "source long")
        legs: dict[int, list[int]] = {}
        for a, b in zip(ids, ids[1:], strict=False):
            legs.setdefault(a, []).append(b)
        tree = shortest(self.edges, sources, legs).persist()
        for a, b in zip(ids, ids[1:], strict=False):
            nodes += path(tree, a, b)[1:]
            cost += tree.where((F.col("source") == a) & (F.col("node") == b)).first().cost
        at = {r.id: (r.x, r.y) for r in self.nodes.where(F.col("id").isin(sorted(set(nodes)))).collect()}
        line = [at[n] for n in nodes]
        return geojson(line) if form == "geojson" else valhalla(self.spark, line, points, cost)


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as Parquet: nodes, and edges by source."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartition("src").sortWithinPartitions("src").write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str, search: float = SEARCH) -> Router:
    return Router(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), search)


def geojson(line: list[tuple[float, float]]) -> dict:
    return {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [list(p) for p in line]}}]}


def encoded(spark: SparkSession, line: list[tuple[float, float]]) -> str:
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in line],)], "points array<struct<x: double, y: double>>")
    return df.select(polyline(F.col("points")).alias("p")).first().p


def valhalla(spark: SparkSession, line, points, cost: int) -> dict:
    summary = {"length": 1.0, "time": 1.0, "cost": float(cost), "min_lon": min(x for x, _ in line), "min_lat": min(y for _, y in line), "max_lon": max(x for x, _ in line), "max_lat": max(y for _, y in line)}
    places = [{"type": "break", "lon": x, "lat": y, "original_index": i} for i, (x, y) in enumerate(points)]
    return {"trip": {"locations": places, "legs": [{"shape": encoded(spark, line), "summary": summary, "maneuvers": []}], "summary": summary, "status": 0, "status_message": "Found route between points", "units": "kilometers"}}


def request_points(body: dict | str) -> list[tuple[float, float]]:
    """Points of a request: a MultiPoint as waypoints, from_pos and to_pos, or locations."""
    r = json.loads(body) if isinstance(body, str) else body
    if "locations" in r:
        out = [(float(p["lon"]), float(p["lat"])) for p in r["locations"]]
    elif "from_pos" in r:
        out = [tuple(map(float, r[k])) for k in ("from_pos", "to_pos")]
    else:
        way = r.get("waypoints") or r.get("value") or r.get("inputs", {}).get("waypoints", {}).get("value") or {}
        out = [tuple(map(float, p[:2])) for p in way.get("coordinates", [])]
    if len(out) < 2:
        raise RoutingError("a route needs two points")
    return out


def great_circle(a: str, b: str) -> Column:
    """Metres between two struct columns of x and y."""
    return haversine(F.col(f"{a}.x"), F.col(f"{a}.y"), F.col(f"{b}.x"), F.col(f"{b}.y"))
