"""Benchmark decontamination by CGK embedding, bit-sampling LSH and edit verification (operator 6).

Texts and items are sequences of words (A-Z lower-cased).  A document leaks an item of n words
if a stretch of it is within ``floor(n * EDITS / 100)`` word edits of the item.

1. Item-sized windows of a document and the items are embedded by shared random walks: each step
   writes the word at the walk's place and moves on if a random bit of (step, word) says so.
   Words at edit distance d become sequences at a Hamming distance that d bounds.
2. ``SAMPLES`` times on each of ``WALKS`` walks, ``BITS`` places are sampled; the values there are
   the key of an LSH bucket of (length, walk, sample).  The items that a window meets in a
   bucket are its candidates.  At these settings a leak at the limit is found with probability
   above 0.99 (see the tests).
3. Candidates are verified by the exact edit distance to the best stretch of their neighbourhood;
   neighbourhoods that overlap are one.

The distance of embeddings is bounded by the square of the edits, so an item of over ``SEGMENT``
words is cut in segments of about that size.  A leak of the item holds one of them at least
within 20 % edits; what a segment meets is verified as the whole item.

Embedding every window of every length of a corpus costs hundreds of steps a word.  Only windows
that can hold a leak are embedded: cut in one piece more than the edits allowed, a segment must
leave a piece whole, so a leak lies around a place with such a piece, from ``-e`` to ``+e`` words
off.  This loses nothing; which items a window meets is for the buckets alone to tell.

Items travel as texts in blocks of ``ITEM_BYTES`` and at most ``ITEM_BLOCK``; each Python worker
builds a block's buckets once.  Documents are scanned in place, once for ``SCAN_BLOCKS`` blocks,
and nothing is shuffled but the leaks.  Windows are embedded ``WINDOW_BYTES`` at a time.

Defined results: null and empty texts leak nothing and items without words are leaked by none;
repeated documents and items are judged alike and reported once for each pair of ids; a null
doc_id is reported as null.  Other columns are dropped by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import text as T

EDITS = 20
WALKS = 3
SAMPLES = 24
BITS = 4
STRETCH = 3
#: Longer items are embedded in segments of about so many words.
SEGMENT = 64
ITEM_BLOCK = 20_000
ITEM_BYTES = 8 << 20
SCAN_BLOCKS = 4
WINDOW_BYTES = 4 << 20
PAD = np.uint64(0)
_MASK = np.uint64((1 << 20) - 1)


def _walk_bits(words: np.ndarray, walk: int, step: int) -> np.ndarray:
    return T.mix(words ^ np.uint64((walk * 0x1F123BB5 + step * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))) & np.uint64(1)


@functools.cache
def samples(n: int) -> list[dict[int, list[int]]]:
    """For each walk over n words the samples that take a place, by place."""
    rng = np.random.default_rng(1000 + n)
    out = []
    for places in rng.integers(0, STRETCH * n, (WALKS, SAMPLES, BITS)):
        of: dict[int, list[int]] = {}
        for j, taken in enumerate(places.tolist()):
            for step in sorted(set(taken)):
                of.setdefault(step, []).append(j)
        out.append(of)
    return out


def buckets(windows: np.ndarray) -> np.ndarray:
    """The bucket keys of each row of words, WALKS * SAMPLES of them, by its embeddings to STRETCH times its length."""
    rows, n = windows.shape
    padded = np.concatenate([windows, np.full((rows, 1), PAD)], 1)
    line = np.arange(rows)
    keys = np.empty((WALKS * SAMPLES, rows), np.uint64)
    for walk, taken in enumerate(samples(n)):
        mine = keys[walk * SAMPLES : (walk + 1) * SAMPLES]
        mine[:] = T.mix(np.arange(walk * SAMPLES, (walk + 1) * SAMPLES, dtype=np.uint64) + np.uint64(n << 16))[:, None]
        at = np.zeros(rows, np.int64)
        for step in range(max(taken) + 1):
            x = padded[line, at]
            for j in taken.get(step, ()):
                mine[j] = mine[j] * np.uint64(0x9E3779B97F4A7C15) + x
            at = np.minimum(at + _walk_bits(x, walk, step).astype(np.int64), n)
    return T.mix(keys)


def stretch_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of item to a stretch of text, and where the first best stretch ends."""
    j = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        nxt = np.empty_like(row)
        nxt[0] = i
        nxt[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(nxt - j) + j
    end = int(np.argmin(row))
    return int(row[end]), end


class Items:
    """A block of items, ready to be met."""

    def __init__(self, ids: list, texts: list):
        self.ids: list = []
        self.words: list[np.ndarray] = []
        for w in T.blocks(pa.array(texts, pa.large_string())):
            h = w.hashes(lower=True) | np.uint64(1)
            for i in range(len(w.first) - 1):
                if w.first[i + 1] > w.first[i]:
                    self.ids.append(ids[w.rows[0] + i])
                    self.words.append(h[w.first[i] : w.first[i + 1]])
        self.edits = [len(x) * EDITS // 100 for x in self.words]
        self.item: list[int] = []  # of each segment its item and place in it
        self.offset: list[int] = []
        segments: list[np.ndarray] = []
        for k, x in enumerate(self.words):
            cuts = np.linspace(0, len(x), -(-len(x) // SEGMENT) + 1).astype(int)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                segments.append(x[a:z])
                self.item.append(k)
                self.offset.append(a)
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for x in segments:
            cuts = np.linspace(0, len(x), len(x) * EDITS // 100 + 2).astype(int)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(int(z - a), []).append((int(T.windows(x[a:z], int(z - a))[0]), len(x), int(a)))
        self.pieces = {}
        for q, found in pieces.items():
            found = sorted(set(found))
            h = np.array([f[0] for f in found], np.uint64)
            small = np.zeros(1 << 20, bool)
            small[h & _MASK] = True
            self.pieces[q] = (h, np.array([f[1] for f in found]), np.array([f[2] for f in found]), small)
        sizes = np.array([len(x) for x in segments], np.int64)
        self.buckets = {}
        for n in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == n)
            step = max(1, WINDOW_BYTES // (8 * n))
            keys = np.concatenate([buckets(np.stack([segments[k] for k in of[a : a + step]])) for a in range(0, len(of), step)], 1)
            segment = np.broadcast_to(of, keys.shape).ravel()
            keys = keys.ravel()
            order = np.argsort(keys, kind="stable")
            small = np.zeros(1 << 20, bool)
            small[keys & _MASK] = True
            self.buckets[n] = (keys[order], segment[order], small)

    def places(self, h: np.ndarray, left: np.ndarray) -> dict[int, np.ndarray]:
        """By length the words at which a segment that leaves one of its pieces here would begin."""
        sizes, at = [], []
        for q, (known, of, offset, small) in self.pieces.items():
            x = T.windows(h, q)
            hit = np.flatnonzero(small[x & _MASK] & (left[: len(x)] >= q))
            lo, hi = np.searchsorted(known, x[hit], "left"), np.searchsorted(known, x[hit], "right")
            n = hi - lo
            place = np.repeat(hit, n)
            which = np.repeat(lo, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            sizes.append(of[which])
            at.append(place - offset[which])
        if not sizes:
            return {}
        sizes, at = np.concatenate(sizes), np.concatenate(at)
        return {int(n): np.unique(at[sizes == n]) for n in np.unique(sizes)}

    def candidates(self, n: int, wins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, segment) of the windows and segments of n words that share a bucket."""
        known, segment, small = self.buckets[n]
        keys = buckets(wins)
        at = np.flatnonzero(small[(keys & _MASK).ravel()])
        x = keys.ravel()[at]
        lo, hi = np.searchsorted(known, x, "left"), np.searchsorted(known, x, "right")
        m = hi - lo
        window = np.repeat(at % len(wins), m)
        which = np.repeat(lo, m) + np.arange(len(window)) - np.repeat(np.cumsum(m) - m, m)
        pair = np.unique(segment[which] * np.int64(len(wins)) + window)
        return pair % len(wins), pair // len(wins)

    def leaks(self, w: T.Words):
        """(document of the block, item, start, distance), the best and first stretch of each pair."""
        h = w.hashes(lower=True) | np.uint64(1)
        if not len(h) or not self.words:
            return
        of_word = np.repeat(np.arange(len(w.first) - 1), w.counts)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        hits = []
        for n, starts in self.places(h, w.left()).items():
            e = n * EDITS // 100
            spots = np.unique(starts[:, None] + np.arange(-e, e + 1)[None, :])
            spots = spots[(spots > -n) & (spots < len(h))]
            turn = max(16, WINDOW_BYTES // (8 * n))
            for a in range(0, len(spots), turn):
                hits.append(self._windows(n, spots[a : a + turn], h, w, of_word))
        if hits:
            self._verify(*[np.concatenate(x) for x in zip(*hits, strict=True)], h, w, found)
        for (doc, k), (d, start) in found.items():
            yield doc, k, start, d

    def _windows(self, n, spots, h, w, of_word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(spot, document, segment) of the windows of n words at the spots that share a bucket with a segment."""
        grid = spots[:, None] + np.arange(n)[None, :]
        # A window belongs to the document that holds most of it: that of its middle word.
        doc = of_word[np.clip(spots + n // 2, 0, len(h) - 1)]
        inside = (grid >= w.first[doc][:, None]) & (grid < w.first[doc + 1][:, None])
        window, segment = self.candidates(n, np.where(inside, h[np.clip(grid, 0, len(h) - 1)], PAD))
        return spots[window], doc[window], segment

    def _verify(self, spot, doc, segment, h, w, found) -> None:
        """Neighbourhoods of an item in a document that overlap are verified as one, so none is left out."""
        item = np.array(self.item)[segment]
        spot = spot - np.array(self.offset)[segment]
        order = np.lexsort((spot, doc, item))
        spot, doc, item = spot[order], doc[order], item[order]
        if not len(spot):
            return
        size = np.array([len(x) for x in self.words])[item]
        # As far off as the item's edits and those of a segment can shift it.
        reach = np.array(self.edits)[item] + np.where(size > SEGMENT, SEGMENT * EDITS // 100, 0)
        lo, hi = np.maximum(spot - reach, w.first[doc]), np.minimum(spot + size + reach, w.first[doc + 1])
        cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])) + 1
        for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(spot)], strict=True):
            d, k = int(doc[a]), int(item[a])
            if (d, k) in found and found[d, k][0] == 0:
                continue
            dist, end = stretch_distance(self.words[k], h[lo[a] : hi[z - 1]])
            if dist <= self.edits[k]:
                start = int(lo[a]) + end - int(w.first[d])
                best = found.get((d, k))
                if best is None or (dist, start) < best:
                    found[d, k] = (dist, start)


_BUILT: dict[str, Items] = {}


def _built(name: str, ids: list, texts: list) -> Items:
    """The block of that name; a worker keeps those of one scan."""
    if name not in _BUILT:
        if len(_BUILT) >= SCAN_BLOCKS:
            _BUILT.clear()
        _BUILT[name] = Items(ids, texts)
    return _BUILT[name]


def _scan(docs: DataFrame, item_blocks: list[tuple[list, list]]) -> DataFrame:
    """doc_id, item_id, end_word (words of the document up to the stretch's end), distance."""
    T.bound_batches(docs)
    known = [docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ids, texts)) for ids, texts in item_blocks]

    def scan(batches):
        items = [_built(*b.value) for b in known]
        for b in batches:
            ids = b.column(0).to_pylist()
            for w in T.blocks(b.column(1)):
                rows = [(ids[w.rows[0] + d], it.ids[k], end, dist) for it in items for d, k, end, dist in it.leaks(w)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "end_word", "distance"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, item_id long, end_word long, distance long")


def leaks(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, end_word, distance: a row for each document and item that it leaks."""
    scans: list[list[tuple[list, list]]] = [[([], [])]]
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        n = len(r.text.encode())
        if size and (size + n > item_bytes or len(scans[-1][-1][0]) >= item_block):
            if len(scans[-1]) == SCAN_BLOCKS:
                scans.append([])
            scans[-1].append(([], []))
            size = 0
        scans[-1][-1][0].append(r.item_id)
        scans[-1][-1][1].append(r.text)
        size += n + 1
    out = None
    for blocks_ in scans:
        part = _scan(docs, blocks_)
        out = part if out is None else out.unionAll(part)
    best = F.min(F.struct("distance", "end_word")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.end_word").alias("end_word"), F.col("b.distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak nothing, with all their columns."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_leaking")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_leaking")), "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
