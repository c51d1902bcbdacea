"""Jobs, request dispatch, metrics and layer trees as relational transformations."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Run states of the scheduler and the job states that they stand for.
STATES = {
    "QUEUED": "accepted", "NOT_STARTED": "accepted", "MANAGED": "accepted", "STARTING": "accepted",
    "STARTED": "running", "SUCCESS": "successful", "FAILURE": "failed",
}
OTHER_STATE = "dismissed"
BOUNDS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)


def state(status: Column) -> Column:
    out = None
    for run, job in STATES.items():
        out = F.when(status == run, job) if out is None else out.when(status == run, job)
    return out.otherwise(OTHER_STATE)


def job_states(runs: DataFrame, status: str = "status") -> DataFrame:
    """Number of jobs in each state."""
    return runs.select(state(F.col(status)).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("jobs"))


def find(jobs: DataFrame, job_id: str) -> DataFrame:
    """A job's row; LookupError without one."""
    out = jobs.where(F.col("job_id") == job_id)
    if not out.take(1):
        raise LookupError(job_id)
    return out


def last_lines(log: DataFrame, job="job_id", seq="seq", line="line") -> DataFrame:
    """The last log line of each job."""
    return log.groupBy(job).agg(F.max_by(line, seq).alias("result"))


def last_result(assets: Column) -> Column:
    """Of an array of assets the last one's first metadata entry: its path, else its JSON."""
    entry = F.get(F.element_at(assets, -1)["metadata"], 0)
    return F.when(F.size(assets) > 0, F.coalesce(entry["path"], entry["json"]))


def failure(events: Column) -> Column:
    """Message, description and first metadata text of the first failure event, joined by ' - '; null without one."""
    first = F.get(F.filter(events, lambda e: e["type"] == "ExecutionStepFailureEvent"), 0)
    text = F.get(first["metadata"], 0)["text"]
    return F.when(first.isNotNull(), F.concat_ws(" - ", F.coalesce(first["message"], F.lit("Unknown error")), F.coalesce(first["description"], F.lit("")), F.coalesce(text, F.lit(""))))


def launch_reply(reply: Column) -> Column:
    """State and message of a launch: a run id is accepted, errors are joined, anything else is unknown."""
    return F.struct(
        F.when(reply["run_id"].isNotNull(), "accepted").when(F.size(reply["errors"]) > 0, "failed").otherwise("no-such-process").alias("state"),
        F.when(F.size(reply["errors"]) > 0, F.array_join(reply["errors"], " ")).alias("message"),
    )


def with_upload(inputs: Column, name: Column, path: Column) -> Column:
    """Inputs of a process after an uploaded file's name and place."""
    return F.concat(F.array(name, path), inputs)


def round_robin(log: DataFrame, pools: int, order: str) -> DataFrame:
    """The pool of each request in turn; the numbering runs in parallel blocks of the order."""
    block = F.floor(F.col(order) / 100_000)
    inside = Window.partitionBy("_block").orderBy(order)
    rows = log.withColumn("_block", block).withColumn("_n", F.row_number().over(inside) - 1)
    sizes = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_block").withColumn("pool", F.pmod(F.col("_start") + F.col("_n"), F.lit(pools)).cast("int")).drop("_block", "_n", "_start")


def sticky(log: DataFrame, pools: int, project: str, order: str) -> DataFrame:
    """project, pool: each project, when first seen, goes to the pool with the fewest projects.

    Projects arrive one by one and pools fill evenly, so the n-th new project goes to pool n mod
    the number of pools; only the projects are ordered, not the requests.
    """
    first = log.groupBy(project).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.orderBy("_first", project)) - 1
    return first.select(project, F.pmod(place, F.lit(pools)).cast("int").alias("pool"))


def random_pool(log: DataFrame, pools: int, order: str, seed: int = 0) -> DataFrame:
    """The pool of each request by chance: a hash of its number and a seed, so a run can be repeated."""
    return log.withColumn("pool", F.pmod(F.xxhash64(F.lit(seed), order), F.lit(pools)).cast("int"))


def split_pools(log: DataFrame, pools: int, project: str, order: str, kind: str) -> DataFrame:
    """The pool of each request: with over two pools the first is for printing, and the others hold the projects; with two or one, all hold them."""
    if pools <= 2:
        return log.join(sticky(log, pools, project, order), project)
    rest = log.where(priority(F.col(kind)) == 1)
    others = sticky(rest, pools - 1, project, order).select(F.col(project), (F.col("pool") + 1).alias("_pool"))
    out = log.join(others, project, "left")
    return out.withColumn("pool", F.when(priority(F.col(kind)) == 0, 0).otherwise(F.col("_pool"))).drop("_pool")


def priority(kind: Column) -> Column:
    """Printing has a pool of its own."""
    return F.when(F.lower(kind) == "getprint", 0).otherwise(1)


def histogram(values: DataFrame, value: str, bounds=BOUNDS) -> DataFrame:
    """bound, count: values up to each bound, and all under infinity."""
    edges = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    low = F.filter(edges, lambda b: F.col(value) <= b)[0]
    each = values.where(F.col(value).isNotNull()).groupBy(low.alias("bound")).agg(F.count(F.lit(1)).alias("n"))
    spark = values.sparkSession
    all_ = spark.createDataFrame([(float(b),) for b in bounds] + [(float("inf"),)], "bound double")
    total = Window.orderBy("bound").rowsBetween(Window.unboundedPreceding, 0)
    return all_.join(each, "bound", "left").select("bound", F.sum(F.coalesce("n", F.lit(0))).over(total).alias("count"))


def header_pairs(block: Column) -> Column:
    """Map of the ``key: value`` lines of a header block."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.instr(x, ":") > 0)
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"))
    return F.map_from_entries(F.transform(lines, pair))


def metrics_of(text: Column) -> Column:
    """Map of ``k:v`` pairs parted by commas."""
    return F.str_to_map(text, F.lit(","), F.lit(":"))


def project_name(path: Column, root: str) -> Column:
    """Name of a project file below root: folders joined by an underline, without suffix."""
    rest = F.regexp_replace(path, F.lit("^" + root.rstrip("/").replace(".", r"\.") + "/"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(rest, r"\.[^./]+$", ""), "/", "_")


def flatten_tree(nodes: DataFrame, node="id", parent="parent", name="name") -> DataFrame:
    """id, name, depth, path of each node of a tree of rows, by a recursive query."""
    rows = nodes.select(F.col(node).alias("id"), F.col(parent).alias("parent"), F.col(name).alias("name"))
    return nodes.sparkSession.sql(
        "WITH RECURSIVE t(id, name, depth, path) AS (SELECT id, name, 0, CAST(name AS STRING) FROM {rows} WHERE parent IS NULL "
        "UNION ALL SELECT n.id, n.name, t.depth + 1, concat(t.path, '/', n.name) FROM {rows} n JOIN t ON n.parent = t.id) SELECT * FROM t",
        rows=rows,
    )


def first_real_box(layers: DataFrame, order: str = "seq") -> DataFrame:
    """The first layer's box that has an area, else the world."""
    real = layers.where("xmax > xmin AND ymax > ymin").agg(F.min_by(F.struct("xmin", "ymin", "xmax", "ymax"), order).alias("b"))
    world = F.struct(F.lit(-180.0).alias("xmin"), F.lit(-90.0).alias("ymin"), F.lit(180.0).alias("xmax"), F.lit(90.0).alias("ymax"))
    return real.select(F.coalesce("b", world).alias("b")).select("b.*")


_CAPABILITY = "depth int, Name string, Title string, CRS array<string>, xmin double, ymin double, xmax double, ymax double"
_SIDES = ("westBoundLongitude", "southBoundLatitude", "eastBoundLongitude", "northBoundLatitude")


def capability_layers(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """depth, Name, Title, CRS and box of all layers of WMS capability documents, however deep; a document that is no XML has none."""

    def parse(batches):
        for b in batches:
            rows = [r for text in b.column(0).to_pylist() if text for r in _layers(text)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["depth", "Name", "Title", "CRS", "xmin", "ymin", "xmax", "ymax"])

    return docs.select(F.col(xml).cast("string")).mapInArrow(parse, _CAPABILITY)


def _layers(text: str) -> list[tuple]:
    """Layers in document order; a stack instead of recursion, so depth has no bound."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    plain = lambda e: e.tag.rsplit("}", 1)[-1]
    child = lambda e, name: next((c for c in e if plain(c) == name), None)
    word = lambda e: None if e is None else (e.text or "").strip()
    capability = child(root, "Capability")
    todo = [(0, e) for e in reversed(list(capability)) if plain(e) == "Layer"] if capability is not None else []
    out = []
    while todo:
        depth, e = todo.pop()
        box = child(e, "EX_GeographicBoundingBox")
        sides = [word(child(box, s)) if box is not None else None for s in _SIDES]
        names = [word(c) for c in e if plain(c) in ("CRS", "SRS")]
        out.append((depth, word(child(e, "Name")), word(child(e, "Title")), names or None, *[float(s) if s else None for s in sides]))
        todo += [(depth + 1, c) for c in reversed(list(e)) if plain(c) == "Layer"]
    return out
