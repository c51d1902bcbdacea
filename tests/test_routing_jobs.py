import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import jobs, processes, relational, routing


def graph(spark, seed):
    rnd = random.Random(seed)
    nodes = [(i, rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(40)]
    edges = [(rnd.randrange(40), rnd.randrange(40), rnd.uniform(0, 9)) for _ in range(60)] + [(0, 77, 1.0)]
    n = spark.createDataFrame(nodes, "id long, x double, y double")
    return n, routing.edges_from_table(spark.createDataFrame(edges, "source long, target long, cost double"), n)


def test_shortest(spark):
    for seed, local in ((0, 0), (1, 1000)):
        _, e = graph(spark, seed)
        flat = [tuple(r) for r in e.collect()]
        tree = routing.shortest(e, spark.createDataFrame([(0,), (5,)], "source long"), local_edges=local)
        got = {(r.source, r.node): r.cost for r in tree.collect()}
        for s in (0, 5):
            for t in range(40):
                try:
                    cost, nodes = routing.dijkstra(flat, s, t)
                except routing.NoRoute:
                    assert (s, t) not in got
                    continue
                assert got[s, t] == cost
        s, t = max(got, key=got.get)
        p = routing.path(tree, s, t)
        assert p == routing.path(tree, s, t, most=0)
        some = routing.shortest(e, spark.createDataFrame([(s,)], "source long"), {s: [t]}, local_edges=local)
        assert routing.path(some, s, t) == p and some.count() <= tree.where(F.col("source") == s).count()
        weight = {(a, b): w for a, b, w in flat}
        assert sum(weight[a, b] for a, b in zip(p, p[1:], strict=False)) == got[s, t]


def test_router(spark):
    lines = spark.createDataFrame([([(9.0, 47.0), (9.05, 47.1), (9.1, 47.0)],), ([(9.1, 47.0), (9.2, 47.0)],), ([(20.0, 1.0), (21.0, 1.0)],)], "points array<struct<x: double, y: double>>")
    nodes, edges = routing.edges_from_lines(lines)
    assert nodes.count() == 5 and edges.count() == 6
    round_ = routing.edges_from_lines(lines, ellipsoid=False)[1]
    pairs = edges.join(round_.withColumnRenamed("weight", "w"), ["src", "dst"]).collect()
    assert len(pairs) == 6 and all(0 < abs(r.weight - r.w) < 0.006 * r.w for r in pairs)
    r = routing.Router(nodes, edges)
    got = r.route([(9.01, 47.0), (9.19, 47.01)])
    assert got["features"][0]["geometry"]["coordinates"] == [[9.0, 47.0], [9.1, 47.0], [9.2, 47.0]]
    v = r.route([(9.01, 47.0), (9.19, 47.01)], "valhalla")["trip"]
    assert v["legs"][0]["shape"] == routing.encoded(spark, [(9.0, 47.0), (9.1, 47.0), (9.2, 47.0)]) and v["legs"][0]["summary"]["length"] == 1.0
    with pytest.raises(routing.NodeNotFound):
        r.route([(9.0, 47.0), (0.0, 0.0)])
    with pytest.raises(routing.NoRoute):
        r.route([(9.0, 47.0), (20.0, 1.0)])
    with pytest.raises(routing.RoutingError):
        r.route([(9.0, 47.0)])
    assert routing.request_points('{"locations": [{"lon": 1, "lat": 2}, {"lon": 3, "lat": 4}]}') == [(1, 2), (3, 4)]
    assert routing.request_points({"from_pos": [1, 2], "to_pos": [3, 4]}) == [(1, 2), (3, 4)]
    assert routing.request_points({"waypoints": {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}}) == [(1, 2), (3, 4)]
    with pytest.raises(routing.RoutingError):
        routing.request_points({})


def test_nearest(spark):
    rnd = random.Random(3)
    nodes = [(i, rnd.uniform(0, 3), rnd.uniform(0, 3)) for i in range(100)] + [(100, 0.5, 0.5), (101, 0.5, 0.5)]
    queries = [(i, rnd.uniform(-1, 4), rnd.uniform(-1, 4)) for i in range(60)] + [(60, 0.5, 0.5)]
    got = {r.qid: (r.id, r.d2) for r in routing.nearest(spark.createDataFrame(queries, "qid long, x double, y double"), spark.createDataFrame(nodes, "id long, x double, y double"), 0.04).collect()}
    for q, x, y in queries:
        d2, i = min(((nx - x) ** 2 + (ny - y) ** 2, n) for n, nx, ny in nodes)
        assert (q in got) == (d2 < 0.04) and (q not in got or (got[q][0] == i and abs(got[q][1] - d2) < 1e-12))


def test_events(spark):
    ev = "array<struct<type: string, message: string, description: string, metadata: array<struct<text: string>>>>"
    rows = [([("X", "no", None, None), ("ExecutionStepFailureEvent", "m", "d", [("t",)]), ("ExecutionStepFailureEvent", "z", None, None)],), ([("ExecutionStepFailureEvent", None, "d", None)],), ([],)]
    assert [r.f for r in spark.createDataFrame(rows, f"e {ev}").select(jobs.failure(F.col("e")).alias("f")).collect()] == ["m - d - t", "Unknown error - d - ", None]
    r = spark.createDataFrame([("a", None), (None, ["x", "y"]), (None, [])], "run_id string, errors array<string>").select(jobs.launch_reply(F.struct("run_id", "errors")).alias("r"))
    assert [tuple(x.r) for x in r.collect()] == [("accepted", None), ("failed", "x y"), ("no-such-process", None)]
    a = spark.createDataFrame([([([("p", "j")],), ([(None, "k"), ("q", None)],)],), ([],)], "a array<struct<metadata: array<struct<path: string, json: string>>>>")
    assert [x.r for x in a.select(jobs.last_result(F.col("a")).alias("r")).collect()] == ["k", None]
    t = spark.createDataFrame([("A: b\r\nX-metrics: a:1,b:2\nnone", "getprint")], "h string, k string")
    x = t.select(jobs.header_pairs(F.col("h")).alias("m"), jobs.priority(F.col("k")).alias("p"), jobs.with_upload(F.array(F.lit("z")), F.lit("n"), F.lit("/f")).alias("u")).first()
    assert x.m == {"A": "b", "X-metrics": "a:1,b:2"} and x.p == 0 and x.u == ["n", "/f", "z"]
    assert t.select(jobs.metrics_of(F.element_at(jobs.header_pairs(F.col("h")), "X-metrics")).alias("m")).first().m == {"a": "1", "b": "2"}
    p = spark.createDataFrame([("/q/sub/x.y.qgs",)], "p string").select(jobs.project_name(F.col("p"), "/q").alias("n")).first().n
    assert p == "sub_x.y"
    with pytest.raises(LookupError):
        jobs.find(spark.createDataFrame([("a",)], "job_id string"), "b")


def test_capabilities(spark):
    box = "<EX_GeographicBoundingBox><westBoundLongitude>1</westBoundLongitude><eastBoundLongitude>2</eastBoundLongitude><southBoundLatitude>3</southBoundLatitude><northBoundLatitude>4</northBoundLatitude></EX_GeographicBoundingBox>"
    xml = f"<WMS_Capabilities><Capability><Layer><Name>root</Name><CRS>a</CRS><CRS>b</CRS><Layer><Name>x</Name>{box}</Layer><Layer><Name>y</Name><Layer><Name>z</Name></Layer></Layer></Layer></Capability></WMS_Capabilities>"
    got = jobs.capability_layers(spark.createDataFrame([(xml,)], "xml string"))
    rows = {r.Name: r for r in got.collect()}
    assert {n: r.depth for n, r in rows.items()} == {"root": 0, "x": 1, "y": 1, "z": 2} and rows["root"].CRS == ["a", "b"] and rows["x"].ymax == 4
    layers = got.withColumn("seq", F.monotonically_increasing_id())
    assert tuple(jobs.first_real_box(layers).first()) == (1, 3, 2, 4)
    assert tuple(jobs.first_real_box(layers.where("depth = 2")).first()) == (-180, -90, 180, 90)


def test_joins(spark):
    rnd = random.Random(2)
    left = [(i, rnd.randrange(3), rnd.randrange(50)) for i in range(60)]
    right = [(rnd.randrange(3), rnd.randrange(50), i) for i in range(40)]
    l, r = spark.createDataFrame(left, "i long, k int, t int"), spark.createDataFrame(right, "k int, t int, v long")
    want = {i: max(((u, v) for kk, u, v in right if kk == k and u <= t), default=(None, None)) for i, k, t in left}
    assert {x.i: x.v for x in relational.asof(l, r, ["k"], "t", ["v"]).collect()} == {i: v for i, (_, v) in want.items()}
    near = {x.i: x.v for x in relational.asof(l, r, ["k"], "t", ["v"], within=3).collect()}
    assert near == {i: v if u is not None and t - u <= 3 else None for (i, k, t) in left for u, v in [want[i]]}
    spans = [(j, a, a + rnd.uniform(0, 9)) for j in range(30) for a in [rnd.uniform(-20, 20)]]
    pts = [(i, rnd.uniform(-25, 25)) for i in range(50)]
    got = relational.ranges(spark.createDataFrame(pts, "i long, p double"), spark.createDataFrame(spans, "j long, a double, b double"), "p", "a", "b", 3.0)
    assert sorted((x.i, x.j) for x in got.collect()) == sorted((i, j) for i, p in pts for j, a, b in spans if a <= p <= b)


def test_processes(spark):
    p = processes.Processes(spark)
    p.register("count", "Counts", lambda s, i: s.range(i["n"]).count())
    p.register("bad", "Fails", lambda s, i: 1 / 0)
    assert p.execute("count", {"n": 7}).result == 7 and p.list()["bad"] == "Fails"
    j = p.execute("count", {"n": 9}, background=True)
    assert p.result(j.job_id) == 9 and p.job(j.job_id).status == "successful"
    bad = p.execute("bad")
    assert bad.status == "failed"
    with pytest.raises(RuntimeError):
        p.result(bad.job_id)
    with pytest.raises(processes.NoSuchProcess):
        p.execute("none")
    with pytest.raises(processes.NoSuchJob):
        p.job("none")
    p.dismiss(j.job_id)
    assert p.job(j.job_id).status == "dismissed" and len(p.jobs()) == 3
