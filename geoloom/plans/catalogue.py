"""The queries of the engine over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import columns as C
from geoloom.operators import features as feat
from geoloom.operators import grids, jobs, relational, routing
from geoloom.operators.features import FilterParams
from geoloom.plans import fixtures as X
from geoloom.plans.fixtures import CU, EV, GE, GN, OL, OL_POINTS, OS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SIDE = 2 * C.HALF
_W = f"(CAST({_SIDE!r}e0 AS DOUBLE) / pow(2.0e0, z))"
_O = f"CAST({C.HALF!r}e0 AS DOUBLE)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_FEATURE = "CAST(fid AS VARCHAR) AS fid, event_type, user_id, value, x, y"


def _columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("fid").cast("string").alias("fid"), "event_type", "user_id", "value", "x", "y")


@query(f"SELECT {_FEATURE} FROM (SELECT * FROM {EV} ORDER BY fid LIMIT 50 OFFSET 100)")
def q01_items_page(spark, sf):
    return _columns(feat.page(X.event_collection(spark, sf), FilterParams(limit=50, offset=100)))


@query(f"SELECT CAST(count(*) AS BIGINT) AS matched FROM {EV}")
def q01_items_matched(spark, sf):
    c = X.event_collection(spark, sf)
    return feat.where(c, FilterParams()).agg(F.count(F.lit(1)).alias("matched"))


_BOX = "x BETWEEN -5000000.0e0 AND 5000000.0e0 AND y BETWEEN -2500000.0e0 AND 7500000.0e0"


@query(f"SELECT {_FEATURE} FROM {EV} WHERE {_BOX}")
def q02_items_bbox(spark, sf):
    return _columns(feat.where(X.event_collection(spark, sf), FilterParams(bbox="-5000000,-2500000,5000000,7500000")))


@query(f"SELECT {_FEATURE} FROM {EV} WHERE {_BOX}")
def q03_items_bbox_heights(spark, sf):
    return _columns(feat.where(X.event_collection(spark, sf), FilterParams(bbox="-5000000,-2500000,0,5000000,7500000,100")))


@query(f"SELECT {_FEATURE} FROM {EV} WHERE ts = (SELECT ts FROM events WHERE event_id = (SELECT min(event_id) FROM events))")
def q04_items_instant(spark, sf):
    c = X.event_collection(spark, sf)
    at = c.frame.agg(F.min_by("ts", "fid").alias("t")).first().t
    return _columns(feat.where(c, FilterParams(datetime=at.isoformat() + "Z")))


@query(f"SELECT {_FEATURE} FROM {EV} WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'")
def q05_items_until(spark, sf):
    return _columns(feat.where(X.event_collection(spark, sf), FilterParams(datetime="../2024-01-10T00:00:00Z")))


@query(f"SELECT {_FEATURE} FROM {EV} WHERE ts >= TIMESTAMP '2024-01-19 22:00:00'")
def q06_items_since(spark, sf):
    return _columns(feat.where(X.event_collection(spark, sf), FilterParams(datetime="2024-01-20T00:00:00+02:00/..")))


@query(f"SELECT fid, start_at, end_at FROM {OS} WHERE start_at >= TIMESTAMP '1996-01-01 00:00:00' AND coalesce(end_at, start_at) <= TIMESTAMP '1996-06-01 00:00:00'")
def q07_items_within(spark, sf):
    return feat.where(X.span_collection(spark, sf), FilterParams(datetime="1996-01-01T00:00:00Z/1996-06-01T00:00:00Z"))


@query(f"SELECT {_FEATURE} FROM {EV} WHERE event_type = 'click' AND user_id = 42")
def q08_items_equal(spark, sf):
    return _columns(feat.where(X.event_collection(spark, sf), FilterParams(filters={"event_type": "click", "USER_ID": "42"})))


@query(f"SELECT fid, c_name, c_mktsegment, lon, lat FROM {CU} WHERE CAST(fid AS VARCHAR) LIKE '1%5'")
def q09_items_wildcard(spark, sf):
    return feat.where(X.customer_collection(spark, sf), FilterParams(filters={"fid": "1*5"})).select("fid", "c_name", "c_mktsegment", "lon", "lat")


@query(f"SELECT {_FEATURE} FROM {EV} WHERE CAST(fid AS VARCHAR) = '77'")
def q10_item(spark, sf):
    c = X.event_collection(spark, sf)
    return feat.item(c, "77").select(F.col("id").alias("fid")).join(_columns(c.frame), "fid")


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, min({a}) AS xmin, min({b}) AS ymin, max({c}) AS xmax, max({d}) AS ymax FROM {t}"
        for n, t, a, b, c, d in (("EV", EV, "x", "y", "x", "y"), ("CU", CU, "lon", "lat", "lon", "lat"), ("OL", OL, "xmin", "ymin", "xmax", "ymax"))
    )
)
def q10_extents(spark, sf):
    ol = feat.Collection("order_lines", X.order_envelopes(spark, sf), "fid", envelope=("xmin", "ymin", "xmax", "ymax"))
    out = None
    for name, c in (("EV", X.event_collection(spark, sf)), ("CU", X.customer_collection(spark, sf)), ("OL", ol)):
        e = feat.extent(c).select(F.lit(name).alias("name"), "*")
        out = e if out is None else out.unionAll(e)
    return out


_ZOOMS = "(SELECT unnest(generate_series(0, 6)) AS z)"
_TILE = f"CAST(floor((x + {_O}) / {_W}) AS BIGINT) AS tx, CAST(floor(({_O} - y) / {_W}) AS BIGINT) AS ty"


def _addressed(spark, sf):
    e = X.event_points(spark, sf).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(6))))
    tx, ty = C.tile_of(F.col("x"), F.col("y"), F.col("z"))
    return e.select("fid", "z", tx.alias("tx"), ty.alias("ty"), "x", "y", "event_type", "value")


@query(f"SELECT fid, CAST(z AS INTEGER) AS z, {_TILE} FROM {EV}, {_ZOOMS}")
def q11_tile_addresses(spark, sf):
    return _addressed(spark, sf).select("fid", "z", "tx", "ty")


@query(f"SELECT z, tx, ty, CAST(count(*) AS BIGINT) AS features FROM (SELECT CAST(z AS INTEGER) AS z, {_TILE} FROM {EV}, {_ZOOMS}) GROUP BY ALL")
def q12_tile_counts(spark, sf):
    return _addressed(spark, sf).groupBy("z", "tx", "ty").agg(F.count(F.lit(1)).alias("features"))


@query(
    f"SELECT fid, CAST(round(lon * ({C.HALF!r}e0 / 180.0e0), 6) AS DOUBLE) AS mx, CAST(round(ln(tan((lat + 90.0e0) * pi() / 360.0e0)) * 6378137.0e0, 6) AS DOUBLE) AS my FROM {CU}"
)
def q13_mercator(spark, sf):
    c = X.customer_points(spark, sf)
    return c.select("fid", F.round(C.mercator_x(F.col("lon")), 6).alias("mx"), F.round(C.mercator_y(F.col("lat")), 6).alias("my"))


def _swiss() -> grids.Grid:
    """A metric grid of the Swiss frame: 256 pixel tiles from (2420000, 1350000)."""
    cells = (4000.0, 2000.0, 1000.0, 500.0)
    return grids.Grid("swiss", 2056, tuple(grids.Level(z, c, c / grids.PIXEL, 2420000.0, 1350000.0, 256, 256, -(-480000 // int(256 * c)), -(-320000 // int(256 * c))) for z, c in enumerate(cells)))


_GRID_SQL = """SELECT CAST(z AS INTEGER) AS z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, l + x * w AS xmin, t - (y + 1) * w AS ymin, l + (x + 1) * w AS xmax, t - y * w AS ymax
 FROM (SELECT *, unnest(generate_series(0, rows - 1)) AS y FROM (SELECT *, unnest(generate_series(0, cols - 1)) AS x FROM (VALUES {levels}) v(z, w, l, t, cols, rows)))"""


def _levels_sql(g: grids.Grid, last: int) -> str:
    return ", ".join(f"({v.z}, {v.cell * v.tile_width!r}::DOUBLE, {v.left!r}::DOUBLE, {v.top!r}::DOUBLE, {v.columns}, {v.rows})" for v in g.levels if v.z <= last)


@query(
    f"SELECT 'WebMercatorQuad' AS grid, * FROM ({_GRID_SQL.format(levels=_levels_sql(grids.web_mercator(), 3))}) UNION ALL SELECT 'swiss', * FROM ({_GRID_SQL.format(levels=_levels_sql(_swiss(), 3))})"
)
def q14_grid_tiles(spark, sf):
    a = grids.tiles(spark, grids.web_mercator(), 0, 3).select(F.lit("WebMercatorQuad").alias("grid"), "*")
    return a.unionAll(grids.tiles(spark, _swiss(), 0, 3).select(F.lit("swiss").alias("grid"), "*"))


@query(
    f"SELECT CAST(z AS INTEGER) AS z, round({_SIDE!r}::DOUBLE / 256 / pow(2.0e0, z) * 256 / 512, 9) AS pixel_width, round({_SIDE!r}::DOUBLE / 256 / pow(2.0e0, z) / 0.00028e0, 6) AS scale FROM (SELECT unnest(generate_series(0, 18)) AS z)"
)
def q15_pixel_widths(spark, sf):
    v = grids.level_frame(spark, grids.web_mercator()).where("z <= 18")
    return v.select("z", F.round(F.col("cell") * F.col("tile_width") / 512, 9).alias("pixel_width"), F.round("scale", 6).alias("scale"))


_BUFFERED = f"""SELECT CAST(z AS INTEGER) AS z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(-{_O} + x * {_W} - 10 * {_W} / 512, 6) AS xmin, round({_O} - (y + 1) * {_W} - 10 * {_W} / 512, 6) AS ymin,
 round(-{_O} + (x + 1) * {_W} + 10 * {_W} / 512, 6) AS xmax, round({_O} - y * {_W} + 10 * {_W} / 512, 6) AS ymax
 FROM (SELECT *, unnest(generate_series(0, CAST(pow(2, z) AS BIGINT) - 1)) AS y FROM (SELECT z, unnest(generate_series(0, CAST(pow(2, z) AS BIGINT) - 1)) AS x FROM (SELECT unnest([0, 1, 2, 3]) AS z)))"""


@query(_BUFFERED)
def q16_buffered_boxes(spark, sf):
    t = grids.tiles(spark, grids.web_mercator(), 0, 3)
    b = 10 * C.tile_width(F.col("z")) / 512
    return t.select("z", "x", "y", F.round(F.col("xmin") - b, 6).alias("xmin"), F.round(F.col("ymin") - b, 6).alias("ymin"), F.round(F.col("xmax") + b, 6).alias("xmax"), F.round(F.col("ymax") + b, 6).alias("ymax"))


@query(f"SELECT fid, x, y FROM (SELECT *, CAST(floor((x + {_O}) / ({_SIDE!r}e0 / 4)) AS BIGINT) AS tx, CAST(floor(({_O} - y) / ({_SIDE!r}e0 / 4)) AS BIGINT) AS ty FROM {EV}) WHERE tx = 1 AND ty = 2")
def q17_xyz_query(spark, sf):
    from geoloom.operators.layers import Layer, TileQuery, layer_rows

    _addressed(spark, sf).createOrReplaceTempView("prepared_tiles")
    layer = Layer("prepared", geometry_type="POINT", srid=3857, queries=(TileQuery(0, None, "SELECT fid, x, y FROM prepared_tiles WHERE z = !zoom! AND tx = !x! AND ty = !y!"),))
    return layer_rows(spark, layer, grids.web_mercator(), 2, 1, 2)


@query(f"SELECT fid, x, y FROM {EV} WHERE event_type = 'view' AND x BETWEEN -{_O} AND 0 AND y BETWEEN 0 AND {_O}")
def q18_custom_field(spark, sf):
    from geoloom.operators.layers import Layer, TileQuery, layer_rows

    X.event_points(spark, sf).createOrReplaceTempView("event_points")
    layer = Layer("events", geometry_type="POINT", srid=3857, queries=(TileQuery(0, None, "SELECT fid, x, y FROM event_points WHERE event_type = !kind!"),))
    return layer_rows(spark, layer, grids.web_mercator(), 1, 0, 0, {"kind": "view"})


@query("SELECT CAST(z AS INTEGER) AS z, CAST(CASE WHEN z >= 10 THEN 10 WHEN z >= 3 THEN 3 ELSE 0 END AS INTEGER) AS step FROM (SELECT unnest(generate_series(0, 14)) AS z)")
def q19_zoom_steps(spark, sf):
    steps = grids.zoom_steps([(0, 2), (3, 9), (10, None)])
    s = spark.createDataFrame([(v,) for v in steps], "step int")
    z = spark.range(15).select(F.col("id").cast("int").alias("z"))
    return z.join(F.broadcast(s), F.col("step") <= F.col("z")).groupBy("z").agg(F.max("step").alias("step"))


@query(f"SELECT fid, z, ty, CAST((1 << z) - 1 - ty AS BIGINT) AS flipped FROM (SELECT fid, CAST(z AS INTEGER) AS z, {_TILE} FROM {EV}, {_ZOOMS})")
def q20_flipped_rows(spark, sf):
    return _addressed(spark, sf).select("fid", "z", "ty", C.flip_row(F.col("z"), F.col("ty")).alias("flipped"))


_GRIDDED = f"""SELECT z, x, y, CAST(count(*) AS BIGINT) AS features FROM (SELECT CAST(z AS INTEGER) AS z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, -{_O} + x * {_W} AS a, {_O} - (y + 1) * {_W} AS b, -{_O} + (x + 1) * {_W} AS c, {_O} - y * {_W} AS d
  FROM (SELECT *, unnest(generate_series(0, CAST(pow(2, z) AS BIGINT) - 1)) AS y FROM (SELECT z, unnest(generate_series(0, CAST(pow(2, z) AS BIGINT) - 1)) AS x FROM (SELECT unnest([0, 2, 4]) AS z))))
 JOIN {OL} ON xmin <= c AND xmax >= a AND ymin <= d AND ymax >= b GROUP BY z, x, y"""


@query(_GRIDDED)
def q21_cover_counts(spark, sf):
    out = None
    for z in (0, 2, 4):
        c = grids.cover(X.order_envelopes(spark, sf), F.lit(z))
        out = c if out is None else out.unionAll(c)
    return out.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("features"))


@query(_GRIDDED)
def q22_grid_counts(spark, sf):
    t = grids.tiles(spark, grids.web_mercator(), 0, 4).where("z IN (0, 2, 4)").select("z", "x", "y", F.col("xmin").alias("a"), F.col("ymin").alias("b"), F.col("xmax").alias("c"), F.col("ymax").alias("d"))
    o = X.order_envelopes(spark, sf)
    return o.join(F.broadcast(t), (F.col("xmin") <= F.col("c")) & (F.col("xmax") >= F.col("a")) & (F.col("ymin") <= F.col("d")) & (F.col("ymax") >= F.col("b"))).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("features"))


@query(f"SELECT z, tx, ty, fid FROM (SELECT *, row_number() OVER (PARTITION BY z, tx, ty ORDER BY fid) AS n FROM (SELECT fid, CAST(z AS INTEGER) AS z, {_TILE} FROM {EV}, {_ZOOMS})) WHERE n <= 5")
def q23_first_per_tile(spark, sf):
    from geoloom.operators.tiles import first_features

    return first_features(_addressed(spark, sf), ["z", "tx", "ty"], 5, "fid").select("z", "tx", "ty", "fid")


@query(
    f"""WITH s AS (SELECT z, tx, ty, event_type AS layer, CAST(count(*) AS BIGINT) AS features, CAST(sum(length(props)) AS BIGINT) AS bytes
 FROM (SELECT event_type, props, CAST(z AS INTEGER) AS z, {_TILE} FROM {EV}, (SELECT unnest([1, 3]) AS z)) GROUP BY ALL)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY z, tx, ty ORDER BY bytes DESC, layer) AS INTEGER) AS place FROM s) WHERE place <= 3"""
)
def q24_largest_layers(spark, sf):
    from geoloom.operators.tiles import largest_layers

    e = X.event_points(spark, sf).withColumn("z", F.explode(F.array(F.lit(1), F.lit(3))))
    tx, ty = C.tile_of(F.col("x"), F.col("y"), F.col("z"))
    e = e.select("z", tx.alias("tx"), ty.alias("ty"), F.col("event_type").alias("layer"), F.length("props").alias("size"))
    return largest_layers(e, ["z", "tx", "ty"], "layer", "size", 3)


@query(f"SELECT fid, round(x / 7000.0e0) * 7000.0e0 + 0.0e0 AS sx, round(y / 7000.0e0) * 7000.0e0 + 0.0e0 AS sy FROM {EV}")
def q25_snapped(spark, sf):
    return X.event_points(spark, sf).select("fid", C.snap(F.col("x"), 7000.0).alias("sx"), C.snap(F.col("y"), 7000.0).alias("sy"))


@query(f"SELECT fid, lon, lat FROM {CU} WHERE (CASE WHEN lon < 0 THEN lon + 360.0e0 ELSE lon END) BETWEEN 170 AND 200 AND lat BETWEEN -50 AND 50")
def q26_shifted_box(spark, sf):
    from dataclasses import replace

    c = replace(X.customer_collection(spark, sf), shift_longitude=True)
    return feat.where(c, FilterParams(bbox="170,-50,200,50")).select("fid", "lon", "lat")


_PAYLOAD = f"(SELECT z, tx, ty, md5(event_type) AS tile_id, event_type AS data FROM (SELECT DISTINCT ON (z, tx, ty) z, tx, ty, event_type FROM (SELECT fid, event_type, CAST(z AS INTEGER) AS z, {_TILE} FROM {EV}, {_ZOOMS}) ORDER BY z, tx, ty, fid))"


def _payload(spark, sf):
    t = _addressed(spark, sf).groupBy("z", "tx", "ty").agg(F.min_by("event_type", "fid").alias("data"))
    return t.select("z", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("data").cast("binary").alias("data"))


@query(f"SELECT tile_id, CAST(count(*) AS BIGINT) AS tiles, min(data) AS data FROM {_PAYLOAD} GROUP BY tile_id")
def q27_images(spark, sf):
    from geoloom.operators.tiles import deduplicated

    images, refs = deduplicated(_payload(spark, sf), F.md5)
    return images.select("tile_id", F.col("data").cast("string").alias("data")).join(refs.groupBy("tile_id").agg(F.count(F.lit(1)).alias("tiles")), "tile_id")


@query(f"SELECT z, tx AS x, CAST((1 << z) - 1 - ty AS BIGINT) AS row, tile_id, data FROM {_PAYLOAD}")
def q28_tiles_of_images(spark, sf):
    from geoloom.operators.tiles import deduplicated

    images, refs = deduplicated(_payload(spark, sf), F.md5)
    return refs.join(images, "tile_id").select("z", "x", C.flip_row(F.col("z"), F.col("y")).alias("row"), "tile_id", F.col("data").cast("string").alias("data"))


@query(f"SELECT z, tx AS x, ty AS y FROM {_PAYLOAD} WHERE NOT (z <= 3 OR (tx + ty) % 2 = 0)")
def q29_missing_tiles(spark, sf):
    from geoloom.operators.tiles import missing

    t = _payload(spark, sf)
    return missing(t, t.where("z <= 3 OR (x + y) % 2 = 0")).select("z", "x", "y")


@query("SELECT CAST(z AS INTEGER) AS z, CAST(CASE WHEN z >= 10 THEN 60 WHEN z BETWEEN 4 AND 8 THEN 3600 WHEN z <= 8 THEN 86400 END AS INTEGER) AS max_age FROM (SELECT unnest(generate_series(0, 14)) AS z)")
def q30_cache_age(spark, sf):
    spans = spark.createDataFrame([(0, 0, 8, 86400), (1, 4, 8, 3600), (2, 10, 99, 60)], "idx int, lo int, hi int, age int")
    z = spark.range(15).select(F.col("id").cast("int").alias("z"))
    return z.join(F.broadcast(spans), F.col("z").between(F.col("lo"), F.col("hi")), "left").groupBy("z").agg(F.max_by("age", "idx").alias("max_age"))


@query(f"SELECT src, dst, weight FROM {GE}")
def q31_graph_edges(spark, sf):
    return X.graph_edges(spark, sf)


@query(f"SELECT x, y, CAST(row_number() OVER (ORDER BY x, y) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT x, y FROM {OL_POINTS} WHERE n = 1)")
def q32_nodes_by_place(spark, sf):
    return routing.numbered(routing.nodes_by_place(X.line_points(spark, sf).where("n = 1")))


@query(
    f"""SELECT qid, id, d2 FROM (SELECT qid, id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS n FROM (SELECT c.qid, g.id, (g.x - c.x) * (g.x - c.x) + (g.y - c.y) * (g.y - c.y) AS d2
 FROM (SELECT c_custkey AS qid, CAST(c_custkey % 50 AS DOUBLE) + 0.25e0 AS x, CAST(c_custkey % 40 AS DOUBLE) + 0.25e0 AS y FROM customer) c, {GN} g) WHERE d2 < 4) WHERE n = 1"""
)
def q33_nearest_nodes(spark, sf):
    c = table(spark, sf, "customer")
    q = c.select(F.col("c_custkey").alias("qid"), ((F.col("c_custkey") % 50).cast("double") + 0.25).alias("x"), ((F.col("c_custkey") % 40).cast("double") + 0.25).alias("y"))
    return routing.nearest(q, X.graph_nodes(spark, sf), 4.0)


#: Least cost by number of edges; a shortest path has fewer edges than there are nodes.
_COSTS = """WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {edges}), h(n, node, cost) AS (SELECT 0, CAST({source} AS BIGINT), CAST(0 AS BIGINT)
 UNION ALL SELECT n + 1, dst, min(cost + weight) FROM h JOIN e ON src = node WHERE n < {most} GROUP BY n + 1, dst), c AS MATERIALIZED (SELECT node, CAST(min(cost) AS BIGINT) AS cost FROM h GROUP BY node)"""


@query(_COSTS.format(edges=GE, source=3, most=24) + " SELECT node, cost FROM c")
def q34_shortest_costs(spark, sf):
    return routing.shortest(X.graph_edges(spark, sf), spark.createDataFrame([(3,)], "source long")).select("node", "cost")


@query(
    _COSTS.format(edges=GE, source=3, most=24)
    + f""", p AS (SELECT a.node, min(b.node) AS parent FROM c a JOIN e ON e.dst = a.node JOIN c b ON b.node = e.src AND b.cost + e.weight = a.cost GROUP BY a.node),
 w(back, id) AS (SELECT 0, CAST(17 AS BIGINT) UNION ALL SELECT back + 1, parent FROM w JOIN p ON p.node = w.id WHERE w.id <> 3)
 SELECT CAST((SELECT max(back) FROM w) - back AS BIGINT) AS step, id, x, y FROM w JOIN {GN} g USING (id)"""
)
def q35_path(spark, sf):
    """Nodes of the shortest path from 3 to 17."""
    tree = routing.shortest(X.graph_edges(spark, sf), spark.createDataFrame([(3,)], "source long"), {3: [17]})
    nodes = routing.path(tree, 3, 17)
    at = spark.createDataFrame(list(enumerate(nodes)), "step long, id long")
    return at.join(X.graph_nodes(spark, sf), "id").select("step", "id", "x", "y")


@query(
    f"""WITH RECURSIVE e AS (SELECT src, dst FROM {GE} WHERE weight < 1200000), r(a, b) AS (SELECT id, id FROM {GN} UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
 SELECT s.id AS source, t.id AS target, r.a IS NOT NULL AS reachable FROM {GN} s CROSS JOIN {GN} t LEFT JOIN r ON r.a = s.id AND r.b = t.id WHERE s.id IN (0, 20)"""
)
def q36_reachable(spark, sf):
    """What two nodes reach over edges below 1,200 km."""
    nodes = X.graph_nodes(spark, sf)
    edges = X.graph_edges(spark, sf).where("weight < 1200000")
    sources = nodes.where("id IN (0, 20)").select(F.col("id").alias("source"))
    tree = routing.shortest(edges, sources).select("source", F.col("node").alias("target"), F.lit(True).alias("reachable"))
    pairs = nodes.select(F.col("id").alias("target")).join(F.broadcast(sources))
    return pairs.join(tree, ["source", "target"], "left").select("source", "target", F.coalesce("reachable", F.lit(False)).alias("reachable"))


@query(f"SELECT CAST(max(id) + 1 AS BIGINT) AS next FROM {GN}")
def q77_next_node(spark, sf):
    return routing.next_id(X.graph_nodes(spark, sf))


@query("SELECT event_id, CAST(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 + (dense_rank() OVER (ORDER BY first, user_id) - 1) % 3 END AS INTEGER) AS pool FROM (SELECT event_id, event_type, user_id, min(CASE WHEN event_type <> 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS first FROM events)")
def q78_split_pools(spark, sf):
    """Prints to the first pool, the requests of the other projects to three more."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", "GetPrint").otherwise("GetMap").alias("kind"))
    return jobs.split_pools(e, 4, "user_id", "event_id", "kind").select("event_id", "pool")


@query(_COSTS.format(edges=X.CE, source=1, most=200) + " SELECT node, cost FROM c")
def q73_customer_graph_costs(spark, sf):
    """Least costs over a graph of all customers, relaxed in rounds as a graph too large for one task is."""
    return routing.shortest(X.customer_edges(spark, sf), spark.createDataFrame([(1,)], "source long"), local_edges=0).select("node", "cost")


_RUNS = "(SELECT event_id AS run, CASE event_id % 9 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'NOT_STARTED' WHEN 2 THEN 'MANAGED' WHEN 3 THEN 'STARTING' WHEN 4 THEN 'STARTED' WHEN 5 THEN 'SUCCESS' WHEN 6 THEN 'FAILURE' WHEN 7 THEN 'CANCELING' ELSE 'CANCELED' END AS status FROM events)"


@query(f"SELECT CASE WHEN status IN ('QUEUED', 'NOT_STARTED', 'MANAGED', 'STARTING') THEN 'accepted' WHEN status = 'STARTED' THEN 'running' WHEN status = 'SUCCESS' THEN 'successful' WHEN status = 'FAILURE' THEN 'failed' ELSE 'dismissed' END AS state, CAST(count(*) AS BIGINT) AS jobs FROM {_RUNS} GROUP BY 1")
def q37_job_states(spark, sf):
    e = table(spark, sf, "events")
    names = F.array(*[F.lit(s) for s in ("QUEUED", "NOT_STARTED", "MANAGED", "STARTING", "STARTED", "SUCCESS", "FAILURE", "CANCELING", "CANCELED")])
    return jobs.job_states(e.select(F.get(names, (F.col("event_id") % 9).cast("int")).alias("status")))


@query("SELECT user_id, max_by(props, event_id) AS result FROM events GROUP BY user_id")
def q38_last_lines(spark, sf):
    return jobs.last_lines(table(spark, sf, "events"), "user_id", "event_id", "props")


@query("SELECT event_type, CAST((row_number() OVER (ORDER BY first, event_type) - 1) % 2 AS INTEGER) AS pool FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type)")
def q39_sticky_pools(spark, sf):
    return jobs.sticky(table(spark, sf, "events"), 2, "event_type", "event_id")


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 3 AS INTEGER) AS pool FROM events")
def q40_round_robin(spark, sf):
    return jobs.round_robin(table(spark, sf, "events").select("event_id"), 3, "event_id")


@query("SELECT b AS bound, CAST((SELECT count(*) FROM events WHERE value <= b) AS BIGINT) AS count FROM (SELECT unnest([1, 2, 5, 10, 20, 50, 'inf'::DOUBLE]) AS b)")
def q41_histogram(spark, sf):
    return jobs.histogram(table(spark, sf, "events"), "value")


_TREE = "(SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, s_name FROM supplier)"


@query(f"WITH RECURSIVE t AS (SELECT id, name, 0 AS depth, CAST(name AS VARCHAR) AS path FROM {_TREE} WHERE parent IS NULL UNION ALL SELECT n.id, n.name, t.depth + 1, t.path || '/' || n.name FROM {_TREE} n JOIN t ON n.parent = t.id) SELECT id, name, CAST(depth AS INTEGER) AS depth, path FROM t")
def q42_layer_tree(spark, sf):
    r, n, s = (table(spark, sf, x) for x in ("region", "nation", "supplier"))
    tree = r.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name"))
    tree = tree.unionAll(n.select((F.col("n_nationkey") + 100).cast("long"), F.col("n_regionkey").cast("long"), "n_name"))
    return jobs.flatten_tree(tree.unionAll(s.select((F.col("s_suppkey") + 1000).cast("long"), (F.col("s_nationkey") + 100).cast("long"), "s_name")))


# -- collections over any SQL ---------------------------------------------------------------


def _sql(name: str, sql: str, oracle: str | None = None) -> None:
    """A collection over SQL that both engines read alike."""

    def run(spark, sf):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            table(spark, sf, t).createOrReplaceTempView(t)
        inventory = feat.Inventory(spark)
        return inventory.add_sql(name, sql).frame

    run.__name__ = name
    query(oracle or sql)(run)


_sql("q43_inner_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_sql("q44_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
_sql("q45_full_join", "SELECT n_nationkey, s_suppkey FROM nation FULL OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s_nationkey = n_nationkey AND n_nationkey < 20")
_sql("q46_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", None)
_sql("q47_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_sql("q48_right_join", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal < 0) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
_sql("q49_group_having", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
_sql("q50_cube", "SELECT event_type, CAST(user_id % 3 AS BIGINT) AS g, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)", "SELECT event_type, g, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, user_id % 3 AS g FROM events) GROUP BY CUBE (event_type, g)")
_sql("q51_rollup", "SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
_sql("q52_grouping_sets", "SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
_sql("q53_ranks", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS before FROM customer")
_sql("q54_frames", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS high FROM events")
_sql("q55_union_distinct", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier")
_sql("q56_intersect_except", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT n_nationkey FROM nation) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
_sql("q57_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
_sql("q58_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)")
_sql("q59_strings_dates", "SELECT upper(substr(c_name, 1, 8)) AS a, length(c_name) AS b, year(o_orderdate) AS y, CAST(count(*) AS BIGINT) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY upper(substr(c_name, 1, 8)), length(c_name), year(o_orderdate)", "SELECT upper(substr(c_name, 1, 8)) AS a, CAST(length(c_name) AS INTEGER) AS b, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3")
_sql("q60_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
_sql("q61_lateral", "SELECT n_nationkey, x.k FROM nation, LATERAL (SELECT n_nationkey * 2 AS k) x")


@query("SELECT o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey % 30) * INTERVAL '1 day' AS ts FROM orders) o ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) e ON o.user_id = e.user_id AND o.ts >= e.ts")
def q62_asof(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(o_orderkey % 30 AS INT))").alias("ts"))
    return relational.asof(o, table(spark, sf, "events"), ["user_id"], "ts", ["event_id"]).select("o_orderkey", "event_id")


@query("SELECT event_id, s_suppkey FROM events JOIN supplier ON value BETWEEN s_acctbal / 100 AND s_acctbal / 100 + 2")
def q63_range_join(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("lo"), (F.col("s_acctbal") / 100 + 2).alias("hi"))
    return relational.ranges(table(spark, sf, "events").select("event_id", "value"), s, "value", "lo", "hi", 2.0).select("event_id", "s_suppkey")


@query("SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, true AS parts_close, CAST(count(l_quantity) AS BIGINT) AS n, true AS median_close FROM lineitem GROUP BY l_returnflag")
def q64_sketches(spark, sf):
    """Sketches of distinct values and of the median, held against the exact numbers: within 10 % and one unit of rank in 20."""
    l = table(spark, sf, "lineitem")
    # A standard error of 1 %: at the default of 5 % the bound is two deviations, and one group in twenty misses it.
    sketched = l.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("about"), F.percentile_approx("l_quantity", 0.5).alias("median"))
    rank = lambda op: F.count(F.when(op, 1))
    exact = l.join(F.broadcast(sketched), "l_returnflag").groupBy("l_returnflag", "about", "median").agg(
        F.countDistinct("l_partkey").alias("parts"), F.count("l_quantity").alias("n"), rank(F.col("l_quantity") <= F.col("median")).alias("upto"), rank(F.col("l_quantity") < F.col("median")).alias("below")
    )
    median = (F.col("upto") >= 0.45 * F.col("n")) & (F.col("below") <= 0.55 * F.col("n"))
    return exact.select("l_returnflag", "parts", (F.abs(F.col("about") - F.col("parts")) <= 0.1 * F.col("parts")).alias("parts_close"), "n", median.alias("median_close"))


@query("SELECT CAST(length(props) AS INTEGER) AS n, event_id FROM events")
def q65_properties(spark, sf):
    """Properties of features as JSON keep every column but key and geometry."""
    c = X.event_collection(spark, sf)
    f = feat.features(c, c.frame)
    return f.select(F.length(F.get_json_object("properties", "$.props")).alias("n"), F.col("id").cast("long").alias("event_id"))


@query(f"SELECT fid, round(sum(d), 3) AS metres FROM (SELECT fid, n, 2 * 6371008.8e0 * asin(sqrt(sin(radians(y2 - y) / 2) * sin(radians(y2 - y) / 2) + cos(radians(y)) * cos(radians(y2)) * sin(radians(x2 - x) / 2) * sin(radians(x2 - x) / 2))) AS d FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM (SELECT fid, n, x / 200000.0e0 AS x, y / 400000.0e0 AS y FROM {OL_POINTS}) WINDOW w AS (PARTITION BY fid ORDER BY n, x, y)) WHERE x2 IS NOT NULL) GROUP BY fid HAVING count(*) >= 1")
def q66_line_lengths(spark, sf):
    lines = X.order_lines(spark, sf).where(F.size("points") > 1)
    degrees = F.transform("points", lambda p: F.struct((p["x"] / 200000.0).alias("x"), (p["y"] / 400000.0).alias("y")))
    return lines.select("fid", F.round(C.line_length(degrees), 3).alias("metres"))




_PADDED = f"""SELECT CAST(t.z AS INTEGER) AS z, CAST(t.x AS BIGINT) AS x, CAST(t.y AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS features
 FROM (SELECT z, x, y, -{_O} + x * {_W} - {_W} / 64 AS a, {_O} - (y + 1) * {_W} - {_W} / 64 AS b, -{_O} + (x + 1) * {_W} + {_W} / 64 AS c, {_O} - y * {_W} + {_W} / 64 AS d
  FROM (SELECT *, unnest(generate_series(0, CAST(pow(2, z) AS BIGINT) - 1)) AS y FROM (SELECT z, unnest(generate_series(0, CAST(pow(2, z) AS BIGINT) - 1)) AS x FROM (SELECT unnest([0, 1, 2, 3]) AS z)))) t
 JOIN {EV} e ON e.x BETWEEN a AND c AND e.y BETWEEN b AND d GROUP BY t.z, t.x, t.y"""


def _event_source(spark, sf):
    from geoloom.operators.seed import Source, points_wkb

    e = points_wkb(X.event_points(spark, sf).select("fid", "event_type", "value", "x", "y"), "x", "y")
    return Source("events", e, fid="fid", properties=("event_type", "value"))


@query(_PADDED)
def q67_seeded_features(spark, sf):
    """Features of each vector tile, as its encoder counted them."""
    from geoloom.operators.seed import seed

    return seed([_event_source(spark, sf)], 0, 3).select("z", "x", "y", "features")


@query()
def q68_seeded_lines(spark, sf):
    """Vector tiles of lines, simplified and cut: addresses, features and bytes."""
    from geoloom.operators.seed import Source, lines_wkb, seed, with_envelope

    lines = X.order_lines(spark, sf).where(F.size("points") > 1)
    frame = with_envelope(lines_wkb(lines, "points").drop("points"))
    return seed([Source("orders", frame, fid="fid", tolerance=2.0), _event_source(spark, sf)], 0, 4).select("z", "x", "y", "features", F.length("data").alias("bytes"))


def _tile_counts(points: str, boxes: str) -> str:
    """Points in the padded boxes of tiles (z, x, y, a, b, c, d)."""
    return f"SELECT CAST(t.z AS INTEGER) AS z, CAST(t.x AS BIGINT) AS x, CAST(t.y AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS features FROM {boxes} t JOIN {points} e ON e.x BETWEEN a AND c AND e.y BETWEEN b AND d GROUP BY t.z, t.x, t.y"


_MERCATOR = f"(SELECT fid, lon * {_O} / 180 AS x, ln(tan(radians(least(greatest(lat, -89.99999e0), 89.99999e0) + 90) / 2)) * 6378137.0e0 AS y FROM {CU})"
_MERCATOR_TILES = f"""(SELECT z, x, y, -{_O} + x * {_W} - {_W} / 64 AS a, {_O} - (y + 1) * {_W} - {_W} / 64 AS b, -{_O} + (x + 1) * {_W} + {_W} / 64 AS c, {_O} - y * {_W} + {_W} / 64 AS d
  FROM (SELECT *, unnest(generate_series(0, CAST(pow(2, z) AS BIGINT) - 1)) AS y FROM (SELECT z, unnest(generate_series(0, CAST(pow(2, z) AS BIGINT) - 1)) AS x FROM (SELECT unnest([0, 1, 2, 3, 4]) AS z))))"""


@query(_tile_counts(_MERCATOR, _MERCATOR_TILES))
def q74_reprojected_tiles(spark, sf):
    """Vector tiles of a geographic layer on the Web Mercator grid."""
    from geoloom.operators.layers import Layer
    from geoloom.operators.tileset import Tileset

    X.customer_points(spark, sf).createOrReplaceTempView("geographic_customers")
    layer = Layer("customers", "geographic_customers", geometry_type="POINT", srid=4326, fid="fid", x="lon", y="lat", buffer=64)
    return Tileset("customers", [layer]).seed(spark, 0, 4).select("z", "x", "y", "features")


_SWISS = "(SELECT c_custkey AS fid, CAST(2480000 + (c_custkey * 7919) % 360000 AS DOUBLE) AS x, CAST(1070000 + (c_custkey * 104729) % 230000 AS DOUBLE) AS y, c_nationkey FROM customer)"
_CELLS = "CAST([4000, 2000, 1000, 250, 100][z + 1] AS DOUBLE)"
_SWISS_TILES = f"""(SELECT z, x, y, 2420000 + x * w AS a, 1350000 - (y + 1) * w AS b, 2420000 + (x + 1) * w AS c, 1350000 - y * w AS d
  FROM (SELECT *, 256 * {_CELLS} AS w, unnest(generate_series(0, CAST(ceil(320000 / (256 * {_CELLS})) AS BIGINT) - 1)) AS y
   FROM (SELECT z, unnest(generate_series(0, CAST(ceil(480000 / (256 * {_CELLS})) AS BIGINT) - 1)) AS x FROM (SELECT unnest([0, 1, 2, 3, 4]) AS z))))"""


@query(_tile_counts(_SWISS, _SWISS_TILES))
def q75_swiss_tiles(spark, sf):
    """Vector tiles of a layer in the Swiss frame on a grid of that frame, whose levels are no powers of two."""
    from geoloom.operators.layers import Layer
    from geoloom.operators.tileset import Tileset

    place = lambda a, m, o: (F.lit(o) + (F.col("c_custkey") * a) % m).cast("double")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), place(7919, 360000, 2480000).alias("x"), place(104729, 230000, 1070000).alias("y"), "c_nationkey").createOrReplaceTempView("swiss_customers")
    layer = Layer("customers", "swiss_customers", geometry_type="POINT", srid=2056, fid="fid", buffer=0)
    return Tileset("customers", [layer], X.swiss_grid()).seed(spark, 0, 4).select("z", "x", "y", "features")


@query(f"SELECT * FROM ({_tile_counts('(SELECT *, c_nationkey AS k FROM ' + _SWISS + ')', _SWISS_TILES).replace('GROUP BY', 'WHERE e.k <= 5 * (t.z + 1) AND t.z BETWEEN 1 AND 3 GROUP BY')})")
def q76_templated_tiles(spark, sf):
    """Seeding of a query with variables: a box and the zoom."""
    from geoloom.operators.layers import Layer, TileQuery
    from geoloom.operators.tileset import Tileset

    q75_swiss_tiles(spark, sf)
    sql = "SELECT fid, x, y, c_nationkey FROM swiss_customers, (SELECT array(!bbox!) AS box) WHERE x BETWEEN box[0] AND box[2] AND y BETWEEN box[1] AND box[3] AND c_nationkey <= 5 * (!zoom! + 1)"
    layer = Layer("customers", geometry_type="POINT", srid=2056, fid="fid", buffer=0, queries=(TileQuery(0, None, sql),))
    return Tileset("customers", [layer], X.swiss_grid()).seed(spark, 1, 3).select("z", "x", "y", "features")


@query("SELECT event_type, CASE event_type WHEN 'view' THEN 'png' WHEN 'click' THEN 'mvt' WHEN 'purchase' THEN 'json' END AS format, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def q69_sniffed_formats(spark, sf):
    e = table(spark, sf, "events")
    blob = F.when(F.col("event_type") == "view", F.unhex(F.lit("89504E470D0A1A0A00"))).when(F.col("event_type") == "click", F.unhex(F.lit("1F8B0800"))).when(F.col("event_type") == "purchase", F.lit("{}").cast("binary")).otherwise(F.lit("?").cast("binary"))
    return e.groupBy("event_type", C.sniffed(blob)["format"].alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(z AS INTEGER) AS z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM (SELECT *, unnest(generate_series(0, 3)) AS y FROM (SELECT 2 AS z, unnest(generate_series(0, 3)) AS x))")
def q70_curve_order(spark, sf):
    from geoloom.operators.tiles import in_curve_order

    return in_curve_order(grids.tiles(spark, grids.web_mercator(), 2, 2), 4).select("z", "x", "y")


@query(f"SELECT fid, n_lines, CAST(x0 AS DOUBLE) AS x0 FROM (SELECT fid, CAST(count(*) AS BIGINT) AS n_lines, min(x) AS x0 FROM {OL_POINTS} GROUP BY fid)")
def q71_geometry_round_trip(spark, sf):
    """Lines through WKB and GeoJSON: points and least abscissa of what comes back."""
    from geoloom.functions.wkb import geojson_batches
    from geoloom.operators.seed import lines_wkb

    w = lines_wkb(X.order_lines(spark, sf), "points").select("fid", "geom").mapInArrow(geojson_batches, "fid long, geojson string")
    parsed = w.select("fid", F.from_json(F.get_json_object("geojson", "$.coordinates"), "array<array<double>>").alias("c"))
    return parsed.select("fid", F.size("c").cast("long").alias("n_lines"), F.array_min(F.transform("c", lambda p: p[0])).alias("x0"))


@query(f"SELECT z, x, y, CAST(count(*) AS BIGINT) AS changes FROM (SELECT CAST(z AS INTEGER) AS z, CAST(floor((x + {_O}) / {_W}) AS BIGINT) AS x, CAST(floor(({_O} - y) / {_W}) AS BIGINT) AS y FROM {EV}, (SELECT unnest([2, 4]) AS z)) GROUP BY ALL")
def q72_changed_tiles(spark, sf):
    """Changes by tile, over all windows of the change stream's aggregation."""
    from geoloom.streaming.invalidation import changed_tiles

    e = X.event_points(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return changed_tiles(e, [2, 4]).groupBy("z", "x", "y").agg(F.sum("changes").alias("changes"))
