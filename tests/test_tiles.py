import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import columns as C
from geoloom.functions import mvt, wkb
from geoloom.operators import grids, seed, tiles
from geoloom.operators.layers import Layer, MissingFilter, TileQuery, bind, field_types, layer_rows, property_columns
from geoloom.plans import documents
from geoloom.sources import archives, wms
from geoloom.sources.stores import Store, media_type, negotiate, recoded, suffix_of

G = grids.web_mercator()


def test_zoom_steps():
    assert grids.zoom_steps([(0, 2), (3, 9), (10, None)]) == [0, 3, 10]
    assert grids.zoom_steps([(3, 9), (10, 24)]) == [3, 10]
    assert grids.zoom_steps([(0, None)]) == [0] and grids.zoom_steps([(0, None)], [(0, 2), (3, 9)]) == [0, 3]
    assert grids.step_of([0, 3, 10], 9) == 3 and grids.step_of([3], 2) is None and grids.step_of([0, 3, 10], 42) == 10
    assert grids.cache_age([(0, 8, 1), (4, None, 2)], 5) == 2 and grids.cache_age([(3, 4, 1)], 9) is None


def test_grids():
    for g in (G, grids.world_wgs84()):
        assert grids.from_json(grids.to_json(g)).levels == g.levels
    assert G.valid(1, 1, 1) and not G.valid(1, 2, 0) and not G.valid(99, 0, 0)
    with pytest.raises(ValueError):
        G.bounds(0, 1, 0)
    a, b = grids.web_mercator(4), grids.world_wgs84(9)
    assert grids.grid_of([a, b], 3) is a and grids.grid_of([a, b], 3, last=True) is b and grids.grid_of([a, b], 8) is b and grids.grid_of([a], 9) is None
    assert sorted(grids.Grids().names()) == ["WebMercatorQuad", "WorldCRS84Quad"]


def test_enumeration(spark):
    t = grids.tiles(spark, G, 0, 3)
    assert t.count() == 85
    for r in t.collect():
        assert all(abs(x - y) < 1e-6 for x, y in zip((r.xmin, r.ymin, r.xmax, r.ymax), G.bounds(r.z, r.x, r.y), strict=True))
    box = (-1e6, -1e6, 1e6, 1e6)
    part = {(r.z, r.x, r.y) for r in grids.tiles(spark, G, 3, 3, box).collect()}
    assert part == {(r.z, r.x, r.y) for r in t.where("z = 3 AND xmin <= 1e6 AND xmax >= -1e6 AND ymin <= 1e6 AND ymax >= -1e6").collect()}


def test_cover_is_the_closed_box_test(spark):
    rnd = random.Random(1)
    w = 2 * C.HALF / 8
    rows = [(i, *sorted(rnd.choice((rnd.uniform(-C.HALF, C.HALF), -C.HALF + rnd.randrange(9) * w)) for _ in range(2)), *sorted(rnd.uniform(-C.HALF, C.HALF) for _ in range(2))) for i in range(60)]
    df = spark.createDataFrame([(i, a, c, b, d) for i, a, b, c, d in rows] + [(99, None, None, None, None)], "fid long, xmin double, ymin double, xmax double, ymax double")
    got = {(r.fid, r.x, r.y) for r in grids.cover(df, F.lit(3), keep=("fid",)).collect()}
    t = grids.tiles(spark, G, 3, 3).select("x", "y", *[F.col(c).alias("t" + c) for c in ("xmin", "ymin", "xmax", "ymax")])
    want = df.join(t, (F.col("xmin") <= F.col("txmax")) & (F.col("xmax") >= F.col("txmin")) & (F.col("ymin") <= F.col("tymax")) & (F.col("ymax") >= F.col("tymin")))
    assert got == {(r.fid, r.x, r.y) for r in want.collect()}


def test_curve(spark):
    t = grids.tiles(spark, G, 0, 5)
    rows = t.select("z", "x", "y", C.hilbert(F.col("z"), F.col("x"), F.col("y")).alias("d")).collect()
    assert sorted(r.d for r in rows) == list(range(len(rows)))
    for r in rows:
        assert archives.tile_id(r.z, r.x, r.y) == r.d and archives.tile_of_id(r.d) == (r.z, r.x, r.y)
    # Values of the archive specification.
    assert [archives.tile_id(*a) for a in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0))] == [0, 1, 2, 3, 4, 5]


def test_templates():
    layer = Layer("l", "t", srid=3857, tile_size=512, buffer=10)
    b = bind("SELECT * FROM t WHERE z = !zoom! AND x = !x! AND y = !y!", G, layer, 2, 1, 3)
    assert b.args == {"zoom": 2, "x": 1, "y": 3} and not b.spatial and ":zoom" in b.sql
    b = bind("f(!bbox!) a = !f! OR b = !f! OR c = !g! AND w < !pixel_width!", G, layer, 0, 0, 0, {"f": "1", "g": "2"})
    assert not b.spatial and b.args["f"] == "1" and b.args["bbox_xmin"] < -C.HALF and abs(b.args["pixel_width"] - 2 * C.HALF / 512) < 1e-9
    assert bind("SELECT 1", G, layer, 0, 0, 0).spatial
    with pytest.raises(MissingFilter):
        bind("!nope!", G, layer, 0, 0, 0)
    q = Layer("o", queries=(TileQuery(0, 2, "a", tolerance="7"), TileQuery(3, 9, "b", simplify=True), TileQuery(10, None, "c")), tolerance="!pixel_width!*2")
    assert [q.query(z) for z in (0, 2, 3, 9, 10, 42)] == ["a", "a", "b", "b", "c", "c"]
    assert q.simplified(5) and not q.simplified(1) and q.tolerance_at(1, 3.0) == 7.0 and q.tolerance_at(5, 3.0) == 6.0
    with pytest.raises(ValueError):
        Layer("x", tolerance="__import__").tolerance_at(0, 1.0)


def test_layer_rows(spark):
    spark.createDataFrame([(i, i * 1e6 - 5e6, 0.5, "k%d" % (i % 2)) for i in range(10)], "fid long, x double, y double, kind string").createOrReplaceTempView("pts")
    layer = Layer("p", "pts", geometry_type="POINT", fid="fid")
    assert {r.fid for r in layer_rows(spark, layer, G, 1, 0, 0).collect()} == set(range(6))
    assert layer_rows(spark, Layer("p", "pts", limit=2), G, 0, 0, 0).count() == 2
    df = spark.sql("SELECT 1L AS fid, CAST(1.5 AS DECIMAL(5,2)) AS d, array(1) AS a, 'x' AS s, current_timestamp() AS t, 0.0D AS x, 0.0D AS y")
    assert [c.name for c in df.select(*property_columns(df, layer)).schema] == ["d", "s"] and dict(df.select(*property_columns(df, layer)).dtypes)["d"] == "double"
    assert field_types(layer, spark, G) == {"kind": "String"}
    doc = documents.tilejson("t", [layer], {"p": {"kind": "String", "fid": "Number"}}, "http://h", 0, 6, (0, 0, 10, 20))
    assert doc["center"] == [5, 10, 0] and doc["vector_layers"][0]["fields"] == {"kind": "String"}
    assert [l["type"] for l in documents.style("t", [layer, Layer("q", geometry_type="LINESTRING"), Layer("r", geometry_type="POLYGON")], "u")["layers"]] == ["background", "circle", "line", "fill"]
    limits = documents.tileset("t", G, "b", 0, 1)["tileMatrixSetLimits"][1]
    assert (limits["maxTileRow"], limits["maxTileCol"]) == (1, 1)


@pytest.fixture(scope="module")
def source(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        x, y = rnd.uniform(-1.9e7, 1.9e7), rnd.uniform(-1.9e7, 1.9e7)
        if i % 3 == 0:
            g = ("Point", (x, y))
        elif i % 3 == 1:
            g = ("LineString", [(x, y), (x + rnd.uniform(-9e6, 9e6), y + rnd.uniform(-9e6, 9e6)), (x, y + 1e6)])
        else:
            g = ("Polygon", [[(x, y), (x + 3e6, y), (x + 3e6, y + 3e6), (x, y)]])
        rows.append((i, f"n{i % 4}", wkb.encode(g)))
    rows.append((99, None, None))
    df = seed.with_envelope(spark.createDataFrame(rows, "fid long, name string, geom binary"))
    return seed.Source("things", df, fid="fid", properties=("name",), buffer=64)


def test_seed_by_feature_is_by_tile(spark, source):
    """Each tile holds what clipping all features to it gives."""
    from geoloom.functions import geometry as K

    shapes = {r.fid: (r.name, wkb.decode(r.geom)) for r in source.frame.where("geom IS NOT NULL").collect()}
    got = {(r.z, r.x, r.y): r for r in seed.seed([source], 0, 5).collect()}
    for z in (0, 2, 5):
        for x in range(2**z):
            for y in range(2**z):
                want = {}
                for i, (name, g) in shapes.items():
                    q = K.quantised(g, G.bounds(z, x, y), 4096, 64)
                    if q:
                        want[i] = (name, q[0])
                have = {f["id"]: (f["properties"]["name"], f["geometry"][0]) for f in mvt.read(got[z, x, y].data)["things"]["features"]} if (z, x, y) in got else {}
                assert have == want, (z, x, y)
                assert not want or got[z, x, y].features == len(want)


def test_crowded_tiles(spark, source, monkeypatch):
    monkeypatch.setattr(seed, "PART", 7)
    (r,) = seed.seed([source], 0, 0).collect()
    layers = mvt.read(r.data)
    assert list(layers) == ["things"] and len(layers["things"]["features"]) == 60 == r.features
    points = seed.points_wkb(spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0)], "fid long, px double, py double"), "px", "py")
    assert [wkb.decode(r.geom) for r in points.collect()] == [("Point", (2.0, 3.0))]


@pytest.fixture(scope="module")
def made(spark):
    rows = [(z, x, y, b"tile %d" % ((x + y) % 3)) for z in range(4) for x in range(2**z) for y in range(2**z)]
    return spark.createDataFrame(rows, "z int, x long, y long, data binary")


def same(a, b):
    key = lambda d: sorted((r.z, r.x, r.y, bytes(r.data)) for r in d.collect())
    return key(a) == key(b)


@pytest.mark.parametrize("name", ["t.mbtiles", "t.pmtiles", "folder"])
def test_stores(spark, made, tmp_path, name):
    store = Store.of(f"{tmp_path}/{name}")
    store.write(made)
    store.write(made)  # again
    assert same(store.read(spark), made)
    zipped = Store(store.kind, f"{tmp_path}/z{name}", compress=True)
    zipped.write(made)
    assert same(recoded(zipped.read(spark), False), made)


def test_archives(spark, made, tmp_path):
    import os
    import sqlite3

    meta = archives.metadata("n", bounds=(0, 0, 10, 20), maxzoom=3)
    archives.write_mbtiles(made, f"{tmp_path}/a.mbtiles", meta)
    db = sqlite3.connect(f"{tmp_path}/a.mbtiles")
    assert db.execute("SELECT count(*) FROM images").fetchone()[0] == 3
    assert db.execute("SELECT tile_data FROM tiles WHERE zoom_level = 2 AND tile_column = 1 AND tile_row = 0").fetchone()[0] == b"tile 1"
    assert archives.read_metadata(f"{tmp_path}/a.mbtiles")["center"] == "5,10,0"
    archives.write_pmtiles(made, f"{tmp_path}/a.pmtiles", meta)
    p = archives.Pmtiles(f"{tmp_path}/a.pmtiles")
    assert p.header["contents"] == 3 and p.header["addressed"] == 85 and p.metadata["name"] == "n" and p.header["maxzoom"] == 3
    assert p.get(3, 7, 7) == b"tile 2" and p.get(4, 0, 0) is None
    Store.of(f"{tmp_path}/f").write(made)
    assert len(os.listdir(f"{tmp_path}/f/shared")) == 3 and os.stat(f"{tmp_path}/f/3/0/0.pbf").st_nlink > 2
    Store("objects", f"file://{tmp_path}/obj").write(made)
    assert os.path.exists(f"{tmp_path}/obj/3/7/7.pbf")
    Store("table", f"{tmp_path}/tab").write(made)
    assert same(Store("table", f"{tmp_path}/tab").read(spark), made) and archives.tile_at(Store("table", f"{tmp_path}/tab").read(spark), 3, 7, 7) == b"tile 2"
    Store.of(None).write(made)


def test_large_directory(tmp_path):
    w = archives.PmtilesWriter(f"{tmp_path}/b.pmtiles")
    rnd = random.Random(1)
    ids = sorted(rnd.sample(range(10**7), 30000))
    for d in ids:
        w.put(d, b"%d" % (d % 9999))
    w.finalize(archives.metadata("b"))
    p = archives.Pmtiles(f"{tmp_path}/b.pmtiles")
    assert p.header["leaf_size"] > 0
    for d in rnd.sample(ids, 50):
        assert p.get(*archives.tile_of_id(d)) == b"%d" % (d % 9999)


def test_read_through(spark, made):
    wanted = made.select("z", "x", "y").where("z = 2")
    stored = made.where("x = 0")
    got, new = tiles.read_through(wanted, stored, lambda m: m.withColumn("data", F.lit(b"new")), 0, 1)
    assert got.count() == 16 and got.where("data = X'6E6577'").count() == 12 and new.count() == 0
    d = tiles.diagnostics(spark.createDataFrame([(0, 0, 0, "a", 10), (0, 0, 0, "b", 30), (0, 0, 0, "a", 5)], "z int, x long, y long, l string, s int"), ["z", "x", "y"], "l", "s", 1000, 1).first()
    assert (d.bytes, d.percent, d.largest[0].layer, d.largest[0].features) == (45, 4.5, "b", 1)


def test_formats(spark):
    blobs = [b"\x1f\x8b\x08", b"x\x9c1", b"\x89PNG\r\n\x1a\n..", b"GIF89a", b"\xff\xd8\xff\xe0", b"RIFF1234WEBP", b"RIFF", b'{"foo":"bar"}', b"", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, data binary")
    got = [tuple(r.s) for r in df.orderBy("i").select(C.sniffed(F.col("data")).alias("s")).collect()]
    assert got == [("mvt", "gzip"), ("mvt", "deflate"), ("png", "none"), ("gif", "none"), ("jpg", "none"), ("webp", "none"), (None, None), ("json", "none"), (None, None), (None, None)]
    assert media_type(".pbf") == "application/x-protobuf" and suffix_of("image/jpeg; q=1") == "jpg"
    assert negotiate("mvt", None, "png") == "mvt" and negotiate(None, "image/avif,image/webp", "png") == "webp" and negotiate(None, "*/*", "png") == "png"
    t = grids.tiles(spark, G, 0, 0)
    assert "BBOX=-20037508.342789244," in wms.map_urls(t, "http://h/wms", "a,b").first().url


def test_without_collapse(spark):
    pts = spark.createDataFrame([([(0.1, 0.2), (0.2, 0.1), (5.4, 5.6)],)], "p array<struct<x: double, y: double>>")
    assert [tuple(p) for p in pts.select(C.snapped(F.col("p"), 1.0).alias("s")).first().s] == [(0, 0), (5, 6)]
    line = spark.createDataFrame([([(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)],)], "p array<struct<x: double, y: double>>")
    assert line.select(C.polyline(F.col("p"), 5).alias("s")).first().s == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
