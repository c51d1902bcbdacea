import json
import os

import pytest
from pyspark.sql import functions as F

from geoloom.functions import columns, mvt, wkb
from geoloom.operators import jobs, routing, seed
from geoloom.operators.features import Collection
from geoloom.plans import config, documents
from geoloom.sources import gpkg, stores


def test_feature_collections(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), 2.0, f"n{i}") for i in range(20)], "fid long, x double, y double, name string").repartition(3)
    documents.write_geojson(Collection("c", df, "fid", "x", "y"), df, str(tmp_path / "out"), collections=True)
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    found = [json.loads(p.read_text()) for p in files]
    assert all(d["type"] == "FeatureCollection" for d in found) and sum(len(d["features"]) for d in found) == 20


def test_upload_waits_and_tries_again(spark, tmp_path):
    tiles = spark.createDataFrame([(3, x, y, bytearray(f"{x},{y}", "ascii")) for x in range(8) for y in range(8)], "z int, x long, y long, data binary").repartition(2)
    os.makedirs(tmp_path / "up/3")
    stores.write_objects(tiles, f"file://{tmp_path}/up", uploads=4)
    assert (tmp_path / "up/3/5/6.pbf").read_bytes() == b"5,6" and sum(len(f) for _, _, f in os.walk(tmp_path / "up")) == 64
    (tmp_path / "no").write_text("a file, no folder")
    with pytest.raises(Exception, match="no|directory|File"):
        stores.write_objects(tiles.limit(1), f"file://{tmp_path}/no", retries=1, wait=0.01)
    with pytest.raises(ValueError):
        stores.write_objects(tiles, "nowhere")
    data = spark.createDataFrame([(bytearray(b"\x1f\x8b\x08"),), (bytearray(b"\x28\xb5\x2f\xfd\x00"),), (bytearray(b"x"),), (None,)], "d binary")
    assert [r.e for r in data.select(stores.encoding(F.col("d")).alias("e")).collect()] == ["gzip", "zstd", None, None]


def test_graph_of_a_geopackage(spark, tmp_path):
    lines = [(1, ("LineString", [(9.0, 47.0), (9.1, 47.0)])), (2, ("MultiLineString", [[(9.1, 47.0), (9.2, 47.1)], [(9.2, 47.1), (9.3, 47.1)]])), (3, ("Point", (1.0, 1.0))), (4, None)]
    gpkg.write(f"{tmp_path}/g.gpkg", "flows", lines, [("fid", "INTEGER PRIMARY KEY")], "LINESTRING")
    nodes, edges = routing.graph_of(spark, gpkg=(f"{tmp_path}/g.gpkg", "flows", "geom"))
    assert nodes.count() == 4 and edges.count() == 6
    route = routing.Router(nodes, edges).route([(9.0, 47.0), (9.3, 47.1)])
    assert route["features"][0]["geometry"]["coordinates"] == [[9.0, 47.0], [9.1, 47.0], [9.2, 47.1], [9.3, 47.1]]
    n = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "id long, x double, y double")
    table = spark.createDataFrame([(1, 2, 5.0)], "source long, target long, cost double")
    assert routing.graph_of(spark, (table, n), (f"{tmp_path}/g.gpkg", "flows", "geom"))[0].count() == 2
    with pytest.raises(routing.RoutingError):
        routing.graph_of(spark)
    assert routing.next_id(n).first().next == 3 and routing.next_id(n.limit(0)).first().next == 0


def test_pools(spark):
    log = spark.createDataFrame([(i, f"p{i % 7}", "GetPrint" if i % 5 == 0 else "GetMap") for i in range(200)], "n long, project string, kind string")
    pools = [r.pool for r in jobs.random_pool(log, 3, "n").orderBy("n").collect()]
    assert set(pools) == {0, 1, 2} and pools == [r.pool for r in jobs.random_pool(log, 3, "n").orderBy("n").collect()]
    got = jobs.split_pools(log, 3, "project", "n", "kind").collect()
    assert len(got) == 200 and all((r.pool == 0) == (r.kind == "GetPrint") for r in got)
    by = {}
    for r in got:
        by.setdefault(r.project, set()).add(r.pool)
    assert all(len(v - {0}) == 1 for v in by.values())
    assert {r.pool for r in jobs.split_pools(log, 2, "project", "n", "kind").collect()} == {0, 1}


def test_small_functions(spark):
    df = spark.createDataFrame([("abcdefgh", 0.5, 1000.49), ("abc", 1.0, 2.5), (None, None, None)], "t string, o double, s double")
    got = df.select(columns.truncated(F.col("t"), 5).alias("t"), columns.opacity_byte(F.col("o")).alias("o"), columns.whole_scale(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("ab...", 128, 1000), ("abc", 255, 3), (None, None, None)]
    point = wkb.encode(("Point", (1.0, 2.0)))
    assert wkb.with_srid(point, 2056)[5:9] == (2056).to_bytes(4, "little") and wkb.decode(wkb.with_srid(wkb.with_srid(point, 4326), 2056)) == ("Point", (1.0, 2.0))
    blob = wkb.with_srid(wkb.encode_gpkg(("Point", (1.0, 2.0)), 4326), 2056)
    assert wkb.decode_gpkg(blob)[0] == ("Point", (1.0, 2.0)) and blob[4:8] == (2056).to_bytes(4, "little")


def test_encoder_options():
    bow = wkb.encode(("Polygon", [[(0.0, 0.0), (20.0, 20.0), (20.0, 0.0), (0.0, 20.0), (0.0, 0.0)]]))
    box = (0.0, 0.0, 16.0, 16.0)
    plain = seed.encode_layer("a", 4096, 0, box, [bow], None, [1], 0)
    fixed = seed.encode_layer("a", 4096, 0, box, [bow], None, [1], 0, repair=True)
    assert len(plain.features) == len(fixed.features) == 1 and plain.features != fixed.features
    own = seed.encode_layer("a", 4096, 0, box, [wkb.encode(("LineString", [(1.0, 2.0), (30.0, 4000.0)])), wkb.encode(("Point", (7.0, 8.0)))], None, [1, 2], 0, scaled=False)
    read = mvt.read(mvt.tile([own]))["a"]["features"]
    assert [f["geometry"][1] for f in read] == [[[(1, 2), (30, 4000)]], [(7, 8)]] or [f["geometry"][1] for f in read] == [[(1, 2), (30, 4000)], [(7, 8)]]


def test_databases(spark, tmp_path):
    """The database that Spark brings along."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spec = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "partition": "ID", "connections": 3}
    try:
        spark._jvm.java.lang.Class.forName(spec["driver"])
        db = spark._jvm.java.sql.DriverManager.getConnection(url)
    except Exception:
        pytest.skip("no database driver")
    run = db.createStatement().execute
    run("CREATE TABLE spots (id INT PRIMARY KEY, name VARCHAR(9))")
    run("CREATE TABLE pairs (a INT NOT NULL, b INT NOT NULL, PRIMARY KEY (a, b))")
    for i in range(30):
        run(f"INSERT INTO spots VALUES ({i}, 'n{i}')")
    df = config.read_jdbc(spark, spec, "spots")
    assert df.count() == 30 and df.rdd.getNumPartitions() == 3
    assert config.read_jdbc(spark, spec, sql="SELECT * FROM spots WHERE id < 5").count() == 5
    assert config.read_jdbc(spark, spec, sql="SELECT * FROM spots WHERE id < 0").count() == 0
    assert config.jdbc_key(spark, spec, "SPOTS") == "ID" and config.jdbc_key(spark, spec, "PAIRS") is None
    db.close()


def test_strict_configuration():
    good = {"datasource": [{"name": "d", "parquet": {"path": "p"}}], "tileset": [{"name": "t", "layer": [{"name": "l", "table": "x"}], "store": {"path": "s"}}]}
    assert config.checked(good) is good
    for bad in ({"tilesets": []}, {"tileset": [{"name": "t", "layers": []}]}, {"tileset": [{"name": "t", "layer": [{"name": "l", "tabel": "x"}]}]}, {"store": {"url": "x"}}):
        with pytest.raises(config.ConfigError, match="unknown"):
            config.checked(bad)
    old = '[[tileset]]\nname = "t"\n[[tileset.layer]]\nname = "l"\ntable_name = "(SELECT a, geom FROM x WHERE f(a) > 1) AS q"\nminzoom = 3'
    (l,) = config.legacy(old)["tileset"][0]["layer"]
    assert l["query"] == [{"minzoom": 3, "sql": "SELECT a, geom FROM x WHERE f(a) > 1"}] and "table" not in l
