import zipfile
from datetime import datetime

import pytest

from geoloom.operators import features as feat
from geoloom.operators.features import FilterParams, Inventory
from geoloom.plans import config, documents
from geoloom.sources import gpkg, plugins
from geoloom.streaming import invalidation


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("gpkg")
    rows = [(i, f"lake {i % 3}", i * 1.5, ("Polygon", [[(float(i), 0.0), (i + 1.0, 0.0), (i + 1.0, 1.0), (float(i), 0.0)]])) for i in range(1, 31)]
    gpkg.write(f"{f}/a.gpkg", "lakes", [*rows, (99, None, None, None)], [("fid", "INTEGER PRIMARY KEY"), ("name", "TEXT"), ("size", "REAL")], "POLYGON")
    gpkg.write(f"{f}/a.gpkg", "places", [("a", 1, ("Point", (1.0, 2.0)))], [("code", "TEXT PRIMARY KEY"), ("n", "INTEGER")], "POINT")
    (f / "broken.gpkg").write_bytes(b"nothing")
    return f


def test_scan(spark, folder):
    inv = Inventory(spark)
    gpkg.scan(spark, str(folder), inv)
    assert inv.names() == ["lakes", "places"] and len(inv.warnings) == 1
    lakes = inv.get("lakes")
    assert lakes.key == "fid" and feat.queryables(lakes) == {"name": "string", "size": "number"}
    d = documents.items(inv, "lakes", FilterParams(bbox="5,0,6,1", filters={"name": "lake*"}), "")
    assert d["numberMatched"] == 3 and d["features"][0]["geometry"]["type"] == "Polygon" and "size" in d["features"][0]["properties"]
    assert documents.items(inv, "lakes", FilterParams(), "")["numberMatched"] == 31
    assert documents.item(inv, "places", "a", "")["geometry"]["coordinates"] == [1.0, 2.0]
    assert gpkg.tables(f"{folder}/a.gpkg")[0].extent == (1.0, 0.0, 31.0, 1.0)
    assert gpkg.read(spark, f"{folder}/a.gpkg", sql="SELECT name, count(*) AS n FROM lakes GROUP BY name").count() == 4


def test_paths():
    assert gpkg.common_folder([]) == "" and gpkg.common_folder(["/a", "/b"]) == "/"
    assert gpkg.common_folder(["/a/b/a", "/a/b/b", "/a/b/c"]) == "/a/b" and gpkg.common_folder(["/a/b"]) == "/a/b"


def test_config(spark, folder):
    c = config.layered('[a]\nb = 1\n[[datasource]]\nname = "g"\n[datasource.gpkg]\npath = "x"', {"GEOLOOM_A__B": "2", "GEOLOOM_C": "t", "OTHER": "1"})
    assert c["a"]["b"] == 2 and c["c"] == "t"
    d = config.Datasources.of(c["datasource"], {"GEOLOOM_DATASOURCE_G": f"{folder}/a.gpkg"})
    assert config.load(spark, d.get(), "lakes").count() == 31 and d.get("none") is None and d.get("g") == d.get()
    with pytest.raises(config.ConfigError):
        config.layer({"name": "x", "nope": 1})
    with pytest.raises(config.ConfigError):
        config.Datasources.of([{"name": "x"}], {})
    old = '[[datasource]]\nname = "d"\ndbconn = "u"\n[grid]\npredefined = "web_mercator"\n[[tileset]]\nname = "t"\n[[tileset.layer]]\nname = "l"\ntable_name = "tab"\nbuffer_size = 3\n[[tileset.layer.query]]\nminzoom = 2\nsql = "s"\n[cache.file]\nbase = "/c"'
    new = config.legacy(old)
    l = config.layer(new["tileset"][0]["layer"][0])
    assert (l.table, l.buffer, l.query(3), new["tileset"][0]["grid"], new["store"]["path"]) == ("tab", 3, "s", "WebMercatorQuad", "/c")
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/pq/t.parquet")
    assert config.load(spark, ("parquet", {"path": f"{folder}/pq"}), "t").count() == 3
    assert config.load(spark, ("parquet", {"path": f"{folder}/pq"}), sql="SELECT sum(id) AS s FROM t").first().s == 3


def test_documents():
    a = {"openapi": "3", "paths": {"/a": 1, "/b": 1}, "components": {"schemas": {"x": 1}}}
    b = {"paths": {"/b": 2}, "components": {"schemas": {"y": 2}, "parameters": {"p": 1}}}
    assert documents.merged_openapi(a, b) == {"openapi": "3", "paths": {"/a": 1, "/b": 2}, "components": {"schemas": {"x": 1, "y": 2}, "parameters": {"p": 1}}}
    assert documents.conformance(["b", "a", "a"])["conformsTo"] == ["a", "b"]
    assert len(documents.landing("t", "b", ["x", "y"])["links"]) == 3
    assert documents.processes({"a": "A"}, "b")["processes"][0]["title"] == "A"


def test_plugins(spark, tmp_path):
    for name, meta in (("a", "[general]\nname=Plug %s\nversion=1"), ("b", None)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}/metadata.txt" if meta else f"{name}/other.txt", meta or "x")
    (tmp_path / "c.zip").write_bytes(b"no zip")
    (r,) = plugins.index(spark, str(tmp_path)).collect()
    assert (r.file, r.name, r.metadata["version"]) == ("a.zip", "Plug %s", "1")


def test_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), float(x), 0.5) for m, x in ((1, 5e6), (2, 5e6), (25, -5e6))] + [(datetime(2024, 1, 1), None, 1.0)]
    spark.createDataFrame(rows, "ts timestamp, x double, y double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, x double, y double").parquet(f"{tmp_path}/in")
    got = []
    q = invalidation.remake(invalidation.changed_tiles(stream, range(0, 2)), lambda t: t, lambda t: got.extend(tuple(r) for r in t.collect()), f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert set(got) == {(0, 0, 0), (1, 1, 0), (1, 0, 0)}
    batch = invalidation.changed_tiles(spark.read.parquet(f"{tmp_path}/in"), range(1, 2))
    assert sorted((r.x, r.changes) for r in batch.collect()) == [(0, 1), (1, 2)]
