"""Substring dedup over a compacted de Bruijn graph of token windows (operator 9).

1. Edges of the graph are windows of ``WINDOW`` words; a document is a path of edges.  A stretch of
   consecutive edges that share their least ``SEED``-word run (a super-k-mer, as sequence
   assemblers call it) travels as one row, keyed by that run, so equal edges meet however far apart
   they start.  At the key, edges are compared by 48 more bits over all their words; every edge
   but the one with the smallest source coordinate (doc_id, start) is repeated and is given the
   coordinate of its occurrence before.
2. Compaction: repeated edges that follow each other in their document and at their source don't branch
   and are one path.  Edges of one row are compacted where they are judged; Spark glues the
   paths of a document over the keys that they were cut at, so a span is a maximal path.
3. Verification: a span and its source coordinates are joined to their documents, and the words of
   both are compared by 128 bits of BLAKE2b.  Spans that differ at their source are left out.
4. Spans go back to their documents by a join and cover the words to remove.

Hot groups: edges that a block of documents holds before are settled inside the block, so a
passage that all documents share sends one row a block; runs of ``SEED`` words that are frequent
in the corpus are the last choice as keys.  The source of a copy is the copy before it, so no document is asked for all copies of a passage.

Defined results: null and empty texts have no words; documents below ``WINDOW`` words lose
nothing; of rows with equal (doc_id, start) and equal words none is earlier, so repeated rows of
the first document all stay; a null doc_id is smaller than any other.  Other columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions.checkpoints import checkpoint
from geoloom.llm import text as T
from geoloom.llm.hot import frequent, member

WINDOW = 20
SEED = 7
NULL_ID = -(1 << 63)
#: Bytes of an edge's hash that travel beside its key.
MARK = 6

#: A row that a block has settled has -n, and its source instead of marks.
_EDGE = "key long, doc long, part long, start int, n int, marks binary"
_PATH = "doc long, part long, start int, n int, from_doc long, from_part long, from_start int"
_SOURCE = np.dtype([("doc", "<i8"), ("part", "<i8"), ("start", "<i4")])


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs that begin where breaks is true."""
    at = np.flatnonzero(breaks)
    return at, np.diff(np.r_[at, len(breaks)])


def _before(order: np.ndarray, new: np.ndarray, same_place) -> tuple[np.ndarray, np.ndarray]:
    """(which are later, their occurrence before) of things in order, equal ones next to each other."""
    n = len(order)
    first = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    prior = np.r_[order[:1], order[:-1]]
    later = np.zeros(n, bool)
    source = np.zeros(n, np.int64)
    later[order] = ~same_place(order, first)
    source[order] = np.where(same_place(order, prior), first, prior)
    return later, source


def _edges(doc, part, words: T.Words, hot: np.ndarray, window: int, seed: int):
    """Of a block: paths that it settles itself, and rows for the rest."""
    h = words.hashes()
    edge = T.windows(h, window)
    if not len(edge):
        return None
    ok = np.flatnonzero(words.left()[: len(edge)] >= window)
    if not len(ok):
        return None
    of = np.repeat(np.arange(len(doc)), words.counts)[ok]
    start = ok - words.first[of]
    edge = edge[ok]
    seeds = T.windows(h, seed)
    lead = seeds[ok]

    # Earlier in the block: order by edge, document, place; equal by the edge's hash and that of its first words.
    rank = np.argsort(np.lexsort((part, doc)), kind="stable") if len(doc) > 1 else np.zeros(1, int)
    order = np.lexsort((start, rank[of], edge))
    new = np.r_[True, (edge[order][1:] != edge[order][:-1]) | (lead[order][1:] != lead[order][:-1])]
    later, source = _before(order, new, lambda a, b: (doc[of[a]] == doc[of[b]]) & (start[a] == start[b]))

    # The least seed in each window, frequent ones last.
    grade = seeds >> np.uint64(1) | (member(seeds, hot).astype(np.uint64) << np.uint64(63))
    best, at = grade[ok], ok.copy()
    for j in range(1, window - seed + 1):
        less = grade[ok + j] < best
        best[less] = grade[ok + j][less]
        at[less] = ok[less] + j
    from_ = ok[source]
    apart = np.r_[True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1) | (later[1:] != later[:-1])]
    turn = np.where(later[1:], (from_[1:] != from_[:-1] + 1) | (of[source][1:] != of[source][:-1]), at[1:] != at[:-1])
    first, n = _runs(apart | np.r_[True, turn])
    done = later[first]
    marks = edge.view(np.uint8).reshape(-1, 8)[:, :MARK][~later]
    sizes = np.where(done, _SOURCE.itemsize, n * MARK)
    key = np.where(done, T.mix(edge[first]), seeds[at[first]])
    offsets = np.r_[0, np.cumsum(sizes)]
    raw = np.empty(int(offsets[-1]), np.uint8)
    is_source = np.repeat(done, sizes)
    raw[~is_source] = np.ascontiguousarray(marks).ravel()
    src = np.empty(int(done.sum()), _SOURCE)
    place = source[first[done]]
    src["doc"], src["part"], src["start"] = doc[of[place]], part[of[place]], start[place]
    raw[is_source] = src.view(np.uint8)
    blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(doc[of[first]]), pa.array(part[of[first]]), pa.array(start[first].astype(np.int32)), pa.array(np.where(done, -n, n).astype(np.int32)), blob],
        ["key", "doc", "part", "start", "n", "marks"],
    )


def _raw(t: pa.Table, rows: np.ndarray) -> np.ndarray:
    """The bytes of marks in rows, one after the other."""
    marks = t["marks"].take(pa.array(rows)).combine_chunks()
    if isinstance(marks, pa.ChunkedArray):
        marks = pa.concat_arrays(marks.chunks) if marks.num_chunks else pa.array([], pa.binary())
    if not len(marks):
        return np.empty(0, np.uint8)
    offsets = np.frombuffer(marks.buffers()[1], np.int32)[marks.offset : marks.offset + len(marks) + 1]
    return np.frombuffer(marks.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _judge(t: pa.Table):
    """Paths of repeated edges among rows that hold all rows of their keys."""
    doc, part, start, n = (t[c].to_numpy() for c in ("doc", "part", "start", "n"))
    key = t["key"].to_numpy().view(np.uint64)
    done = n < 0
    src = _raw(t, np.flatnonzero(done)).view(_SOURCE)
    out = [(doc[done], part[done], start[done], -n[done], src["doc"], src["part"], src["start"])]
    live = np.flatnonzero(~done)
    order = live[np.argsort(key[live], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    live = np.sort(order[np.r_[False, same] | np.r_[same, False]]) if len(order) else live
    if len(live):
        count = n[live]
        total = int(count.sum())
        wide = np.zeros((total, 8), np.uint8)
        wide[:, :MARK] = _raw(t, live).reshape(total, MARK)
        row = np.repeat(np.arange(len(live)), count)
        step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        edge, of_key = wide.view(np.uint64).ravel(), key[live][row]
        d, s = doc[live][row], start[live][row] + step
        # Sorted by a mix of key and edge, and equal only if both are.
        order = np.lexsort((s, d, T.mix(edge + of_key * np.uint64(0x9E3779B97F4A7C15))))
        new = np.r_[True, (edge[order][1:] != edge[order][:-1]) | (of_key[order][1:] != of_key[order][:-1])]
        later, source = _before(order, new, lambda a, b: (d[a] == d[b]) & (s[a] == s[b]))
        p = part[live][row]
        turn = (row[1:] != row[:-1]) | (later[1:] != later[:-1])
        turn |= (s[source][1:] != s[source][:-1] + 1) | (d[source][1:] != d[source][:-1]) | (p[source][1:] != p[source][:-1])
        first, length = _runs(np.r_[True, turn])
        keep = later[first]
        first, length = first[keep], length[keep]
        at = source[first]
        out.append((d[first], p[first], s[first], length, d[at], p[at], s[at]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "part", "start", "n", "from_doc", "from_part", "from_start"])


def _whole_keys(batches, most_rows: int = 200_000):
    """Tables of sorted rows, cut only between keys."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most_rows:
            t = pa.Table.from_batches(held)
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield t.slice(0, cut)
                t = t.slice(cut)
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _prepared(docs: DataFrame) -> DataFrame:
    """doc, part, text; part tells rows apart that share an id, and is 0 where none do."""
    shared = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    part = F.xxhash64("text") if shared else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), part.alias("part"), "text")


def repeated_paths(rows: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc, part, start, n and source of runs of n consecutive repeated edges, cut at their keys; rows as of _prepared."""
    spark = rows.sparkSession
    hot = spark.sparkContext.broadcast(frequent(rows, seed))

    def edges(batches):
        for b in batches:
            doc, part = b.column("doc").to_numpy(), b.column("part").to_numpy()
            for w in T.blocks(b.column("text")):
                lo, hi = w.rows
                out = _edges(doc[lo:hi], part[lo:hi], w, hot.value, window, seed)
                if out is not None:
                    yield out

    def judge(batches):
        for t in _whole_keys(batches):
            out = _judge(t)
            if out.num_rows:
                yield out

    return rows.mapInArrow(edges, _EDGE).repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(judge, _PATH)


def compacted(paths: DataFrame) -> DataFrame:
    """Paths glued where one goes on from the other in its document and at its source."""
    of = Window.partitionBy("doc", "part").orderBy("start", "from_doc", "from_part", "from_start")
    before = lambda c: F.lag(c).over(of)
    goes_on = (
        (before(F.col("start") + F.col("n")) == F.col("start"))
        & (before(F.col("from_start") + F.col("n")) == F.col("from_start"))
        & (before("from_doc") == F.col("from_doc"))
        & (before("from_part") == F.col("from_part"))
    )
    span = F.sum(F.when(goes_on, 0).otherwise(1)).over(of.rowsBetween(Window.unboundedPreceding, 0))
    glued = paths.withColumn("span", span).groupBy("doc", "part", "span")
    return glued.agg(*[F.min(c).alias(c) for c in ("start", "from_doc", "from_part", "from_start")], F.sum("n").cast("int").alias("n")).drop("span")


def _digests(rows: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """doc, part, start, n and a digest (x, y) of the words, for each span and for its source."""
    span = F.struct("doc", "part", "start", "n")
    size = (F.col("n") + (window - 1)).alias("size")
    own = spans.select("doc", "part", F.col("start").alias("at"), size, span.alias("span"))
    source = spans.select(F.col("from_doc").alias("doc"), F.col("from_part").alias("part"), F.col("from_start").alias("at"), size, span.alias("span"))
    asked = own.unionAll(source).groupBy("doc", "part").agg(F.collect_list(F.struct("at", "size", "span")).alias("asked"))

    def digest(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                c = b.slice(k, 512)
                asked_of = c.column("asked").to_pylist()
                spans_, x, y = [], [], []
                for w in T.blocks(c.column("text")):
                    for i in range(w.rows[0], w.rows[1]):
                        a, z = int(w.first[i - w.rows[0]]), int(w.first[i - w.rows[0] + 1])
                        for q in asked_of[i]:
                            lo = a + q["at"]
                            p, r = _digest(w, lo, min(lo + q["size"], z))
                            spans_.append(q["span"])
                            x.append(p)
                            y.append(r)
                names = [(f, pa.int64() if f in ("doc", "part") else pa.int32()) for f in ("doc", "part", "start", "n")]
                yield pa.RecordBatch.from_arrays([*[pa.array([s[f] for s in spans_], k) for f, k in names], pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["doc", "part", "start", "n", "x", "y"])

    return rows.join(asked, ["doc", "part"]).select("text", "asked").mapInArrow(digest, "doc long, part long, start int, n int, x long, y long")


def _digest(w: T.Words, a: int, z: int) -> tuple[int, int]:
    """128 bits of the words from a to z."""
    d = hashlib.blake2b(_plain(w, a, z), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def verified(rows: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The spans whose words are those at their source."""
    key = ["doc", "part", "start", "n"]
    bad = _digests(rows, spans, window).groupBy(*key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    bad = bad.where("x0 <> x1 OR y0 <> y1").select(*[F.col(c).alias(f"_{c}") for c in key])
    return spans.join(bad, [F.col(c) == F.col(f"_{c}") for c in key], "left_anti")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by a space), a row per input row."""
    T.bound_batches(docs)
    rows = _prepared(docs)
    spans = checkpoint(compacted(repeated_paths(rows, window, seed)))
    # Both joins deal the rows alike, so the texts are shuffled once.
    paths = verified(rows, spans, window).groupBy("doc", "part").agg(F.collect_list(F.struct("start", "n")).alias("paths"))

    def cut(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                c = b.slice(k, 512)
                paths_of, doc = c.column("paths").to_pylist(), c.column("doc").to_pylist()
                n_words, n_removed, kept = [], [], []
                for w in T.blocks(c.column("text")):
                    for i in range(w.rows[1] - w.rows[0]):
                        a, z = int(w.first[i]), int(w.first[i + 1])
                        gone = np.zeros(z - a + 1, np.int64)
                        for p in paths_of[w.rows[0] + i] or ():
                            gone[p["start"]] += 1
                            gone[p["start"] + p["n"] + window - 1] -= 1
                        keep = np.cumsum(gone[:-1]) == 0
                        n_words.append(z - a)
                        n_removed.append(int((~keep).sum()))
                        kept.append(_joined(w, a, z, keep))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if d == NULL_ID else d for d in doc], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "text"],
                )

    return rows.join(paths, ["doc", "part"], "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")


_TO_SPACE = bytes(0x20 if c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D) else c for c in range(256))


def _plain(w: T.Words, a: int, z: int) -> bytes:
    """The words from a to z joined by a space."""
    if a >= z:
        return b""
    s, e = w.start[a:z], w.end[a:z]
    if int((e - s).sum()) + (z - a - 1) == e[-1] - s[0]:
        return w.data[s[0] : e[-1]].tobytes().translate(_TO_SPACE)
    return b" ".join(w.data[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True))


def _joined(w: T.Words, a: int, z: int, keep: np.ndarray) -> str:
    """The words from a to z that are kept, joined by a space."""
    edge = np.flatnonzero(np.diff(np.r_[False, keep, False].astype(np.int8)))
    return b" ".join(_plain(w, a + int(x), a + int(y)) for x, y in edge.reshape(-1, 2)).decode("utf-8", "replace")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
