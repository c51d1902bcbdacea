import json
from dataclasses import replace
from datetime import datetime

import pytest

from geoloom.operators import features as feat
from geoloom.operators.features import Collection, FilterParams, Inventory, InvalidFilter, UnknownQueryable, parse_bbox, parse_temporal
from geoloom.plans import documents


@pytest.fixture(scope="module")
def inventory(spark):
    inv = Inventory(spark)
    rows = [(i, f"n{i % 3}" if i % 7 else None, float(i), float(-i), datetime(2024, 1, 1 + i % 28), i % 2 == 0, "50%_x" if i == 5 else "y") for i in range(1, 121)]
    df = spark.createDataFrame(rows, "fid long, Name string, x double, y double, ts timestamp_ntz, even boolean, odd string")
    inv.add(Collection("places", df, "fid", "x", "y", start="ts", queryable=("Name", "fid", "x", "even", "ts", "odd")))
    return inv


def ids(inv, **k):
    return sorted(r.fid for r in feat.where(inv.get("places"), FilterParams(**k)).collect())


def test_args():
    assert FilterParams(10, 20, "1.0,2.2,3.33,4.444").args() == "?limit=10&offset=20&bbox=1.0,2.2,3.33,4.444"
    assert FilterParams(offset=20).args() == "?offset=20" and FilterParams().args() == ""
    assert FilterParams(datetime="2024-01-01T00:00:00Z").args() == "?datetime=2024-01-01T00:00:00Z"
    assert FilterParams(filters={"ArbitraryField": "Something"}).args() == "?ArbitraryField=Something"


def test_neighbours():
    p = FilterParams(10, 20)
    assert p.previous().offset == 10 and p.following(35).offset == 30
    assert p.following(20) is None and p.following(19) is None
    assert FilterParams(10, 10).previous().offset == 0 and FilterParams(10, 10).following(35).offset == 20
    assert FilterParams(10).previous() is None and FilterParams(10).following(35).offset == 10


def test_bbox():
    assert parse_bbox("1,2,3,4") == (1, 2, 3, 4) and parse_bbox("1,2,0,3,4,9") == (1, 2, 3, 4) and parse_bbox(None) is None
    for bad in ("1,2,3", "1, 2,3,4", "a,b,c,d", "1,2,3,4,5", "nan,1,2,3"):
        with pytest.raises(InvalidFilter):
            parse_bbox(bad)


def test_temporal():
    assert parse_temporal("2024-01-01T00:00:00Z")[2]
    assert parse_temporal("../2024-01-01T02:00:00+02:00")[1].hour == 0
    for bad in ("..", "../..", "2024-01-01", "2024-01-01T00:00:00Z/../..", "2024-13-01T00:00:00Z"):
        with pytest.raises(InvalidFilter):
            parse_temporal(bad)


def test_where(inventory):
    assert ids(inventory, bbox="10,-12,11,-10") == [10, 11]
    assert ids(inventory, filters={"NAME": "n1", "even": "true"}) == [i for i in range(1, 121) if i % 3 == 1 and i % 7 and i % 2 == 0]
    assert ids(inventory, filters={"fid": "1*5"}) == [15, 105, 115]
    assert ids(inventory, filters={"odd": "50%_*"}) == [5] and ids(inventory, filters={"odd": "5_%_*"}) == []
    assert ids(inventory, datetime="2024-01-05T00:00:00Z") == [i for i in range(1, 121) if i % 28 == 4]
    assert ids(inventory, datetime="2024-01-05T00:00:00Z/2024-01-06T00:00:00Z") == [i for i in range(1, 121) if i % 28 in (4, 5)]
    for f in ({"fid": "x"}, {"even": "1"}, {"ts": "2024"}):
        with pytest.raises(InvalidFilter):
            ids(inventory, filters=f)
    with pytest.raises(UnknownQueryable):
        ids(inventory, filters={"nope": "1"})


def test_pushdown(inventory, tmp_path, spark):
    inventory.get("places").frame.write.parquet(f"{tmp_path}/p")
    c = replace(inventory.get("places"), frame=spark.read.parquet(f"{tmp_path}/p"))
    df = feat.where(c, FilterParams(bbox="1,2,3,4", datetime="2024-01-05T00:00:00Z/..", filters={"fid": "7"})).select("x")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert all(s in pushed for s in ("LessThanOrEqual(x,3.0)", "GreaterThanOrEqual(y,2.0)", "EqualTo(fid,7)", "GreaterThanOrEqual(ts"))
    assert "Name" not in next(line for line in plan.splitlines() if "ReadSchema" in line)


def test_pages(inventory):
    d = documents.items(inventory, "places", FilterParams(limit=10, offset=115), "http://h")
    assert (d["numberMatched"], d["numberReturned"]) == (120, 5)
    assert [l["rel"] for l in d["links"]] == ["self", "collection", "prev"]
    f = documents.items(inventory, "places", FilterParams(), "http://h")
    assert f["numberReturned"] == 50 and f["features"][6]["properties"]["Name"] is None
    assert f["features"][0]["id"] == "1" and f["features"][0]["geometry"] == {"type": "Point", "coordinates": [1.0, -1.0]}
    assert documents.items(inventory, "places", FilterParams(limit=0), "")["numberReturned"] == 120
    past = documents.items(inventory, "places", FilterParams(offset=500), "")
    assert (past["numberMatched"], past["numberReturned"]) == (120, 0)
    assert documents.item(inventory, "places", "7", "")["id"] == "7"
    for key in ("700", "07", "x"):
        with pytest.raises(feat.FeatureNotFound):
            documents.item(inventory, "places", key, "")


def test_documents(inventory, spark, tmp_path):
    q = documents.queryables(inventory.get("places"), "http://h")["properties"]
    assert q["ts"] == {"title": "ts", "type": "string", "format": "date-time"} and q["even"]["type"] == "boolean"
    e = feat.extent(inventory.get("places")).first()
    assert tuple(e) == (1.0, -120.0, 120.0, -1.0)
    assert documents.collection(inventory.get("places"), "b", tuple(e))["extent"]["spatial"]["bbox"] == [[1.0, -120.0, 120.0, -1.0]]
    assert [c["id"] for c in documents.collections(inventory, "b")["collections"]] == ["places"]
    with pytest.raises(feat.CollectionNotFound):
        inventory.get("none")
    c = inventory.get("places")
    documents.write_geojson(c, c.frame, f"{tmp_path}/g")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/g").collect()]
    assert len(lines) == 120 and {l["id"] for l in lines} == {str(i) for i in range(1, 121)}


def test_sql_collections(spark):
    inv = Inventory(spark)
    inv.add_sql("s", "SELECT id AS fid, id * 2 AS v FROM range(:n)", {"n": 5}, key="fid", queryable=("v",))
    assert inv.items("s", FilterParams(filters={"v": "4"})).first().id == "2"
    with pytest.raises(Exception, match="nowhere"):
        inv.add_sql("t", "SELECT * FROM nowhere")
    inv.scan({"a": 1, "b": 2}, lambda n, s: Collection(n, spark.range(s)) if s == 1 else 1 / 0)
    assert inv.names() == ["a", "s"] and len(inv.warnings) == 1
    with pytest.raises(feat.UnsupportedQueryable):
        inv.add(Collection("arr", spark.sql("SELECT array(1) AS a"), queryable=("a",)))
