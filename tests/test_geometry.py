import math
import random
import struct

import numpy as np
import pytest

from geoloom.functions import geometry as G
from geoloom.functions import lines as L
from geoloom.functions import mvt, wkb
from geoloom.functions.projection import UnknownProjection, transform, transform_box

SHAPES = [
    ("Point", (1.0, 2.0)), ("Point", None), ("LineString", [(0.0, 0.0), (1.5, 2.5)]), ("Polygon", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]),
    ("MultiPoint", [(1.0, 2.0), (3.0, 4.0)]), ("MultiLineString", [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]),
    ("MultiPolygon", [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]]), ("GeometryCollection", [("Point", (1.0, 2.0)), ("LineString", [(0.0, 0.0), (1.0, 1.0)])]),
]


@pytest.mark.parametrize("g", SHAPES)
def test_round_trips(g):
    assert wkb.decode(wkb.encode(g)) == g
    assert wkb.decode_gpkg(wkb.encode_gpkg(g, 4326)) == (None if g[1] is None else g, 4326)
    assert wkb.from_geojson(wkb.geojson(g)) == g


def test_forms():
    big = struct.pack(">BI3d", 0, 1001, 1, 2, 3)
    assert wkb.decode(big) == ("Point", (1, 2))
    ext = struct.pack("<BIi2d", 1, 0x20000001, 3857, 1, 2)
    assert wkb.decode(ext) == ("Point", (1, 2)) and wkb.srid_of(ext) == 3857
    arc = struct.pack("<BII6d", 1, 8, 3, 1, 0, 0, 1, -1, 0)
    kind, pts = wkb.decode(arc)
    assert kind == "LineString" and pts[0] == (1, 0) and pts[-1] == (-1, 0) and all(abs(math.hypot(*p) - 1) < 1e-9 and p[1] >= -1e-9 for p in pts)
    line = struct.pack("<BII4d", 1, 2, 2, -1, 0, 1, 0)
    assert len(wkb.decode(struct.pack("<BII", 1, 9, 2) + arc + line)[1]) == len(pts) + 1
    assert wkb.promoted(("Point", (1, 2))) == ("MultiPoint", [(1, 2)])
    with pytest.raises(wkb.BadGeometry):
        wkb.decode(big[:9])


def test_clip():
    rnd = random.Random(1)
    box = (0.0, 0.0, 10.0, 10.0)
    for _ in range(200):
        line = [(rnd.uniform(-5, 15), rnd.uniform(-5, 15)) for _ in range(8)]
        out = G.clip(("LineString", line), box)
        for p in wkb.points(out) if out else ():
            assert all(-1e-9 <= v <= 10 + 1e-9 for v in p)
        ring = [*line, line[0]]
        out = G.clip(("Polygon", [ring]), box)
        for p in wkb.points(out) if out else ():
            assert all(-1e-9 <= v <= 10 + 1e-9 for v in p)
    assert G.clip(("Polygon", [[(-5, -5), (15, -5), (15, 15), (-5, 15), (-5, -5)]]), box) == ("MultiPolygon", [[r]]) if (r := G.clip_ring([(-5, -5), (15, -5), (15, 15), (-5, 15), (-5, -5)], box)) else False
    assert abs(G.area(r)) == 100
    assert G.clip(("LineString", [(-1, 5), (5, 5), (5, 11), (6, 11), (6, 5)]), box)[1] == [[(0, 5), (5, 5), (5, 10)], [(6, 10), (6, 5)]]
    assert G.clip(("Point", (11, 1)), box) is None and G.clip(("Point", (10, 1)), box)[1] == [(10, 1)]


def test_simplify():
    rnd = random.Random(2)
    for _ in range(50):
        line = [(float(i), rnd.uniform(0, 3)) for i in range(60)]
        out = G.simplify_line(line, 1.0)
        assert out[0] == line[0] and out[-1] == line[-1] and set(out) <= set(line)
        for p in line:
            assert min(_distance(p, a, b) for a, b in zip(out, out[1:], strict=False)) <= 1.0 + 1e-9
        n = 40
        ring = [(math.cos(t) * r, math.sin(t) * r) for i in range(n) for t, r in [(i / n * 2 * math.pi, rnd.uniform(5, 9))]]
        out = G.simplify_ring([*ring, ring[0]], 3.0)
        assert len(out) >= 4 and out[0] == out[-1] and not G._crosses(out)


def _distance(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    n = d[0] ** 2 + d[1] ** 2
    t = 0 if not n else max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n))
    return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])


def test_repair():
    bow = ("Polygon", [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]])
    kind, polys = G.make_valid(bow)
    assert kind == "MultiPolygon" and sorted(G.area(p[0]) for p in polys) == [1, 1]
    hole = ("Polygon", [[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]])
    _, ((shell, inner),) = G.make_valid(hole)
    assert G.area(shell) == 81 and G.area(inner) == -1
    assert G.make_valid(("Point", (1, 1))) == ("MultiPolygon", [])
    assert G.snap(("Polygon", [[(0, 0), (0.1, 0), (0, 0.1), (0, 0)]]), 1.0) == ("MultiPolygon", [])
    assert G.snap(("LineString", [(0, 0), (0.2, 0.1), (3.4, 0)]), 1.0)[1] == [(0, 0), (3, 0)]
    assert len(G.segmentized([(0, 0), (10, 0)], 3)) == 5


def test_tiles():
    box = (0.0, 0.0, 100.0, 100.0)
    layer = mvt.LayerBuilder("a")
    shapes = [("Point", (50.0, 50.0)), ("LineString", [(0.0, 0.0), (100.0, 100.0)]), ("Polygon", [[(10.0, 10.0), (10.0, 90.0), (90.0, 90.0), (90.0, 10.0), (10.0, 10.0)], [(40.0, 40.0), (50.0, 40.0), (50.0, 50.0), (40.0, 50.0), (40.0, 40.0)]])]
    props = {"s": "é", "i": -5, "j": 7, "f": 1.5, "b": True, "n": None, "one": 1}
    for k, g in enumerate(shapes):
        assert layer.add(G.quantised(g, box, 4096, 0), props, k - 1)
    assert not layer.add(None, {})
    got = mvt.read(mvt.tile([layer, mvt.LayerBuilder("empty")]))
    assert list(got) == ["a"] and got["a"]["version"] == 2 and got["a"]["extent"] == 4096
    f = got["a"]["features"]
    assert [x["id"] for x in f] == [None, 0, 1] and f[0]["properties"] == {k: v for k, v in props.items() if v is not None}
    assert f[0]["geometry"] == ("MultiPoint", [(2048, 2048)]) and f[1]["geometry"][1] == [[(0, 4096), (4096, 0)]]
    ((shell, hole),) = f[2]["geometry"][1]
    assert G.area(shell) > 0 > G.area(hole)
    assert G.quantised(("Point", (101.0, 5.0)), box, 4096, 0) is None and G.quantised(("Point", (101.0, 5.0)), box, 4096, 64) is not None


def test_projection():
    x, y = transform([8.5], [47.4], 4326, 3857)
    assert abs(x[0] - 946215.67) < 1 and abs(y[0] - 6378137 * math.asinh(math.tan(math.radians(47.4)))) < 1e-6
    assert abs(transform(*transform([8.5], [47.4], 4326, 2056), 2056, 4326)[0][0] - 8.5) < 1e-5
    e, n = transform([7.438637], [46.951083], 4326, 2056)
    assert abs(e[0] - 2600000) < 3 and abs(n[0] - 1200000) < 3
    with pytest.raises(UnknownProjection):
        transform([0], [0], 4326, 25832)
    b = transform_box((2600000, 1200000, 2700000, 1250000), 2056, 3857, 1000)
    assert b[0] < b[2] and b[1] < b[3]


def test_geodesic(spark):
    dms = lambda d, m, s: d + m / 60 + s / 3600
    a = (dms(144, 25, 29.52440), -dms(37, 57, 3.72030))
    b = (dms(143, 55, 35.38390), -dms(37, 39, 10.15610))
    assert abs(G.geodesic_length([a, b]) - 54972.271) < 0.02
    assert G.geodesic_length([a]) == 0 and G.geodesic_length([a, a]) == 0
    assert 2.0e7 < G.geodesic_length([(0, 0), (179.99, 0.01)]) < 2.01e7
    df = spark.createDataFrame([(1, [a, b]), (2, [b]), (3, []), (4, [a, b, a])], "k long, p array<struct<x: double, y: double>>")
    got = {r.k: r.metres for r in df.mapInArrow(G.length_batches, "k long, metres double").collect()}
    assert abs(got[1] - 54972.271) < 0.02 and got[2] == got[3] == 0 and abs(got[4] - 2 * got[1]) < 1e-3


def _random_lines(seed):
    rnd = np.random.default_rng(seed)
    out = [[tuple(map(float, rnd.integers(-300, 1300, 2))) for _ in range(rnd.integers(2, 30))] for _ in range(200)]
    out += [[(5.0, 5.0), (5.0, 5.0)], [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0)], [(-500.0, 500.0), (1500.0, 500.0)], [(1.0, 1.0), (1.0, 1.0), (900.0, 1.0), (1.0, 1.0)]]
    return out


def test_lines_at_once_as_one_by_one():
    for seed in (1, 2):
        lines = _random_lines(seed)
        blobs = [wkb.encode(("LineString", l)) for l in lines]
        found = L.decoded(blobs)
        assert L.encoded(*found).to_pylist() == blobs
        assert list(zip(*(v.tolist() for v in L.envelopes(*found)), strict=True)) == [wkb.envelope(("LineString", l)) for l in lines]
        for tolerance in (0.0, 20.0, 400.0):
            cut = L.simplified(*found, tolerance) if tolerance else found
            if tolerance:
                assert [list(zip(cut[1][a:z].tolist(), cut[2][a:z].tolist(), strict=True)) for a, z in zip(cut[0], cut[0][1:], strict=False)] == [G.simplify_line(l, tolerance) for l in lines]
            for buffer in (None, 0, 64):
                box, want = (0.0, 0.0, 1000.0, 1000.0), []
                for l in lines:
                    g = G.quantised(G.simplify(("LineString", l), tolerance), box, 256, buffer)
                    want.append(b"".join(map(mvt._varint, mvt.commands(g)[1])) if g else b"")
                assert L.commands(*cut, box, 256, buffer) == want
    assert L.decoded([wkb.encode(("Point", (1.0, 2.0)))]) is None and L.decoded([]) is None


def test_merged_layers_keep_their_features():
    parts, want = [], []
    for part in range(3):
        b = mvt.LayerBuilder("l", 512)
        for i in range(200):
            props = {"n": i * 7 % (90 + part), "part": f"p{part}", "v": i / 4 if i % 3 else None, "on": i % 2 == 0} if i % 5 else {}
            g, fid = ("MultiLineString", [[(i, part), (i + 3, 9 - i)]]), (1000 * i if i % 4 else None)
            b.add(g, props, fid)
            want.append({"id": fid, "properties": {k: v for k, v in props.items() if v is not None}, "geometry": g})
        parts.append(b.encoded())
    whole = mvt.read(mvt._field(3, mvt.merged(parts)))["l"]
    assert whole["features"] == want and whole["extent"] == 512
    again = mvt.LayerBuilder("l", 512)
    for f in want:
        again.add(f["geometry"], f["properties"], f["id"])
    assert mvt.merged(parts) == again.encoded()
