import pytest

from geoloom.__main__ import main
from geoloom.functions import mvt
from geoloom.operators import features as feat
from geoloom.operators import routing
from geoloom.operators.features import FilterParams, Inventory
from geoloom.functions import wkb
from geoloom.functions.projection import transform
from geoloom.operators import grids
from geoloom.operators.layers import Layer, MissingFilter, TileQuery
from geoloom.operators.tileset import ArchiveOrigin, RequestOrigin, TileNotFound, Tileset
from geoloom.plans.fixtures import swiss_grid
from geoloom.sources.stores import Store


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, (i % 10) * 3.9e6 - 1.8e7, (i // 10) * 3.9e6 - 1.8e7, f"k{i % 3}", i * 1.5) for i in range(100)]
    spark.createDataFrame(rows, "fid long, x double, y double, kind string, v double").createOrReplaceTempView("spots")
    return "spots"


def names(tile):
    return {n: sorted(f["id"] or 0 for f in l["features"]) for n, l in mvt.read(tile).items()}


def test_tiles(spark, table, tmp_path):
    layer = Layer("spots", table, geometry_type="POINT", fid="fid", buffer=0)
    by_kind = Layer("kinds", geometry_type="POINT", fid="fid", minzoom=1, queries=(TileQuery(0, None, "SELECT * FROM spots WHERE kind = !kind!"),))
    t = Tileset("t", [layer, by_kind], diagnostics=True, maxzoom=3, ages=[(0, 2, 9)])
    got = mvt.read(t.tile(spark, 0, 0, 0))
    assert len(got["spots"]["features"]) == 100 and got["diagnostics"]["features"][0]["properties"]["layer1"] == "spots"
    one = names(t.tile(spark, 1, 0, 0, FilterParams(filters={"kind": "k1"})))
    assert set(one["kinds"]) < set(one["spots"]) and all(i % 3 == 1 for i in one["kinds"])
    with pytest.raises(TileNotFound):
        t.tile(spark, 0, 1, 0)
    assert t.max_age(1) == 9 and t.max_age(3) is None
    plain = Tileset("p", [layer], store=Store.of(f"{tmp_path}/p.pmtiles"), maxzoom=2)
    assert plain.seed(spark).count() == plain.made(spark, 0, 2).count()
    assert plain.made(spark, 0, 2, known=plain.store.read(spark).where("z < 2").select("z", "x", "y")).where("z < 2").count() == 0
    made = plain.made(spark, 0, 2)
    for r in made.where("z = 2").collect():
        assert names(r.data) == names(plain.tile(spark, r.z, r.x, r.y)) == names(plain.tile_cached(spark, r.z, r.x, r.y))
    kept = []
    assert plain.tile_cached(spark, 3, 0, 0, put=kept.append) == (kept[0] if kept else b"")
    assert plain.tilejson(spark, "u")["vector_layers"][0]["fields"] == {"kind": "String", "v": "Number"}
    assert plain.stylejson("u")["layers"][1]["type"] == "circle" and "vector_layers" in plain.metadata(spark)["json"]
    with pytest.raises(MissingFilter, match="kind"):
        t.seed(spark)
    with pytest.raises(MissingFilter, match="datetime"):
        plain.tile(spark, 0, 0, 0, FilterParams(datetime="2024-01-01T00:00:00Z"))


def test_command(spark, table, tmp_path):
    (tmp_path / "c.toml").write_text('[[tileset]]\nname = "t"\n[[tileset.layer]]\nname = "spots"\ntable = "spots"\nfid = "fid"')
    assert main(["seed", str(tmp_path / "c.toml"), "t", "--maxzoom", "1", "--path", str(tmp_path / "out")]) == 0
    assert main(["seed", str(tmp_path / "c.toml"), "t", "--maxzoom", "1", "--path", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out/1/1/1.pbf").exists()
    assert main(["upload", str(tmp_path / "out"), f"file://{tmp_path}/up"]) == 0
    assert (tmp_path / "up/1/1/1.pbf").read_bytes() == (tmp_path / "out/1/1/1.pbf").read_bytes()


def test_catalog_and_graph(spark, table, tmp_path):
    inv = Inventory(spark)
    spark.range(3).createOrReplaceTempView("plain_numbers")
    feat.scan_catalog(inv)
    assert inv.get("spots").key == "fid" and inv.get("spots").x == "x"
    assert any("plain_numbers" in w for w in inv.warnings)
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "id long, x double, y double")
    routing.save(nodes, routing.both_ways(spark.createDataFrame([(1, 2, 5)], "src long, dst long, weight long")), f"{tmp_path}/g")
    line = routing.load(spark, f"{tmp_path}/g").route([(0.0, 0.0), (1.0, 0.0)])["features"][0]["geometry"]["coordinates"]
    assert line == [[0.0, 0.0], [1.0, 0.0]]


def features(tile, layer):
    return sorted((f["id"] or 0, f["geometry"][1], tuple(sorted(f["properties"].items()))) for f in mvt.read(tile)[layer]["features"])


def same_as_tiles(spark, t, lo, hi, layer):
    made = t.made(spark, lo, hi).collect()
    assert made
    for r in made:
        assert features(bytes(r.data), layer) == features(t.tile(spark, r.z, r.x, r.y), layer), (r.z, r.x, r.y)
    return {(r.z, r.x, r.y) for r in made}


def test_geographic_layers_are_reprojected(spark):
    spark.createDataFrame([(1, 8.5, 47.4, "a"), (2, -60.0, -30.0, "b"), (3, 179.9, 84.0, "c")], "fid long, lon double, lat double, name string").createOrReplaceTempView("geo_spots")
    t = Tileset("g", [Layer("spots", "geo_spots", geometry_type="POINT", srid=4326, fid="fid", x="lon", y="lat", buffer=0)])
    got = same_as_tiles(spark, t, 0, 3, "spots")
    assert (3, 4, 2) in got and (3, 4, 3) not in got
    x, y = transform([8.5], [47.4], 4326, 3857)
    (place,) = [c for i, c, _ in features(t.tile(spark, 0, 0, 0), "spots") if i == 1]
    assert place == [(round((x[0] + 20037508.342789244) / 40075016.68557849 * 4096), round((20037508.342789244 - y[0]) / 40075016.68557849 * 4096))]


def test_geographic_lines_are_reprojected(spark):
    lines = [(1, wkb.encode(("LineString", [(8.0, 47.0), (9.0, 46.0), (9.5, 47.5)])), 8.0, 46.0, 9.5, 47.5), (2, wkb.encode(("Polygon", [[(5.0, 45.0), (11.0, 45.0), (11.0, 48.0), (5.0, 45.0)]])), 5.0, 45.0, 11.0, 48.0)]
    spark.createDataFrame(lines, "fid long, geom binary, x0 double, y0 double, x1 double, y1 double").createOrReplaceTempView("geo_lines")
    t = Tileset("g", [Layer("lines", "geo_lines", geometry="geom", srid=4326, fid="fid", envelope=("x0", "y0", "x1", "y1"), buffer=16, simplify=True)])
    got = same_as_tiles(spark, t, 0, 7, "lines")
    assert (7, 66, 45) in got


def test_custom_grid(spark):
    spark.createDataFrame([(i, 2480000.0 + i * 3571, 1075000.0 + i * 2111, i % 3) for i in range(100)], "fid long, x double, y double, k int").createOrReplaceTempView("swiss_spots")
    shape = wkb.encode(("Polygon", [[(2490000.0, 1080000.0), (2820000.0, 1100000.0), (2700000.0, 1290000.0), (2490000.0, 1080000.0)]]))
    spark.createDataFrame([(1, shape, 2490000.0, 1080000.0, 2820000.0, 1290000.0)], "fid long, geom binary, x0 double, y0 double, x1 double, y1 double").createOrReplaceTempView("swiss_areas")
    t = Tileset("s", [Layer("spots", "swiss_spots", srid=2056, fid="fid", buffer=8)], swiss_grid())
    assert {z for z, *_ in same_as_tiles(spark, t, 0, 4, "spots")} == {0, 1, 2, 3, 4}
    t = Tileset("s", [Layer("areas", "swiss_areas", geometry="geom", srid=2056, fid="fid", envelope=("x0", "y0", "x1", "y1"), buffer=8)], swiss_grid())
    same_as_tiles(spark, t, 0, 4, "areas")
    # A geographic layer on that grid, from 8.5 E 47.4 N.
    spark.sql("SELECT 1 AS fid, 8.5D AS x, 47.4D AS y").createOrReplaceTempView("swiss_geo")
    t = Tileset("s", [Layer("spots", "swiss_geo", srid=4326, fid="fid", buffer=0)], swiss_grid())
    assert (2, 1, 0) in same_as_tiles(spark, t, 0, 3, "spots")


def test_templates(spark):
    spark.createDataFrame([(i, 2480000.0 + i * 3571, 1075000.0 + i * 2111, i % 3) for i in range(100)], "fid long, x double, y double, k int").createOrReplaceTempView("swiss_spots")
    boxed = "SELECT * FROM swiss_spots, (SELECT array(!bbox!) AS box) WHERE x BETWEEN box[0] AND box[2] AND y BETWEEN box[1] AND box[3] AND k <= !zoom! AND !pixel_width! > 0"
    t = Tileset("t", [Layer("spots", srid=2056, fid="fid", buffer=8, queries=(TileQuery(0, 1, "SELECT * FROM swiss_spots WHERE k = 0"), TileQuery(2, None, boxed)))], swiss_grid())
    same_as_tiles(spark, t, 0, 3, "spots")
    # A template that places itself: rows come with the tile they belong to.
    spark.createDataFrame([(z, x, 0, x, 2420000.0 + (x + 0.5) * 256 * cell, 1340000.0) for z, cell in ((1, 2000), (2, 1000)) for x in range(3)], "tz int, tx long, ty long, fid long, px double, py double").createOrReplaceTempView("prepared")
    own = "SELECT fid, px, py FROM prepared WHERE tz = !z! AND tx = !x! AND ty = !y!"
    t = Tileset("t", [Layer("own", srid=2056, fid="fid", x="px", y="py", queries=(TileQuery(0, None, own),))], swiss_grid())
    got = {(r.z, r.x, r.y): r.features for r in t.made(spark, 0, 2).collect()}
    assert got == {(1, 0, 0): 1, (2, 0, 0): 1, (2, 1, 0): 1}


def test_grids_by_zoom(spark):
    spark.createDataFrame([(1, 1.0e6, 6.0e6)], "fid long, x double, y double").createOrReplaceTempView("one_spot")
    wide = grids.Grid("wide", 3857, tuple(grids.Level(z, v.cell * 2, v.scale * 2, v.left, v.top, 512, 512, max(1, v.columns // 4), max(1, v.rows // 4)) for z, v in enumerate(grids.web_mercator(6).levels)))
    t = Tileset("t", [Layer("spots", "one_spot", fid="fid", buffer=0)], grids=[(0, 2, wide)])
    assert t.grid_at(2) is wide and t.grid_at(3) is t.grid
    got = same_as_tiles(spark, t, 0, 4, "spots")
    assert (4, 8, 5) in got and (2, 0, 0) in got


def test_tilesets_of_other_origins(spark, table, tmp_path):
    made = Tileset("p", [Layer("spots", table, fid="fid", buffer=0)], store=Store.of(f"{tmp_path}/a.mbtiles"))
    made.seed(spark, 0, 2)
    copy = Tileset("c", origin=ArchiveOrigin(made.store), store=Store.of(f"{tmp_path}/copy"))
    assert copy.tile(spark, 1, 0, 0) == made.tile(spark, 1, 0, 0) and copy.tile(spark, 5, 0, 0) == b""
    assert copy.seed(spark, 1, 2).count() == made.made(spark, 1, 2).count()
    asked = RequestOrigin("http://h/wms", "base", lambda url: url.encode() if "BBOX=-20037508" in url else None)
    t = Tileset("w", origin=asked, store=Store.of(f"{tmp_path}/w"))
    assert b"LAYERS=base" in t.tile(spark, 0, 0, 0) and t.tile(spark, 1, 1, 0) == b""
    assert t.seed(spark, 0, 1).count() == 3
