"""N-gram Jaccard self-join with vertical partitioning (operator 3).

1. Texts with equal shingle sets are one class, known by its least node.
2. The global order of shingles is cut in three: a quarter of the hash range (ordered by
   document frequency), the rest (by hash), and very frequent shingles (by hash).  Two sets can
   only reach the threshold if their prefixes in that order share a shingle.  A class whose
   prefix is filled by shingles that nobody shares has no partner; the others send their
   prefixes.  Classes that share a prefix shingle are a pair if parity bitmaps of their sets, which
   differ in no more bits than the sets differ in shingles, leave the threshold within reach;
   pairs are hung together in candidate groups.  Shingles of over ``PAIRED`` classes hang all of
   them together, and groups of several tiles are split again by the bitmaps of each tile, so
   chance runs don't chain a growing corpus to one group.
3. A group is cut into tiles of at most ``TILE`` x ``TILE`` classes, and the shingle order into
   ``FRAGMENTS`` fragments.  Each (tile, fragment) counts its partial overlaps alone; the counts
   are summed per pair, and pairs that reach the threshold are links.  Counts travel as one
   matrix a tile, never as a row a pair.
4. Linked classes form components.

Hot groups: copies collapse to one class before any pairing, a block of documents sends equal
sets once, frequent shingles are the last in the order, and large groups are spread by tile and
fragment, so no group is gathered in one task.  Shingles are compared by 64-bit hashes, sets by
128-bit digests.

Defined results: null texts and texts without words have 0 shingles and are linked with nothing;
fewer words than ``k`` are one shingle; a null doc_id counts as below all others and comes back
as null; rows that share a doc_id are separate texts; repeated rows are copies of each other and
linked.  Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions.checkpoints import checkpoint
from geoloom.llm import bloom
from geoloom.llm import text as T
from geoloom.llm.components import components
from geoloom.llm.hot import frequent, member

NULL_ID = -(1 << 63)
TILE = 256
TILE_SHINGLES = 200_000
FRAGMENTS = 4
#: Classes of a prefix shingle up to which they are compared in pairs.
PAIRED = 32
#: Hashes below this are the part of the order that is ranked by document frequency.
RANKED = np.uint64(1 << 62)


def prefix_length(n, percent: int):
    """Shingles of a set of n of which a partner must have one."""
    return n - -(-percent * n // 100) + 1


def _sets(w: T.Words, k: int):
    """The sorted distinct shingles of each document of a block."""
    h = w.hashes(lower=True)
    runs = T.windows(h, k)
    for i in range(len(w.first) - 1):
        a, z = int(w.first[i]), int(w.first[i + 1])
        if z - a >= k:
            s = np.sort(runs[a : z - k + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif z > a:
            whole = np.array([z - a], np.uint64)
            for x in h[a:z]:
                whole = T.mix(whole * np.uint64(0x9E3779B97F4A7C15) + x)
            yield whole
        else:
            yield np.empty(0, np.uint64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(T.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)), int(T.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64))


def _bitmap(s: np.ndarray) -> bytes:
    """Parities of the shingles that fall on each bit; a power of two of bits, about one or two a shingle."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    at = T.mix(s + np.uint64(0x27D4EB2F165667C5)) & np.uint64(size - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmaps: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of one size, a row each, folded to so many words: the bitmaps that the sets have at that size."""
    x = np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _reachable(n, m, differ, percent: int):
    """Whether sets of n and m that differ in so many shingles at least may be linked."""
    most = np.minimum((n + m - differ) // 2, np.minimum(n, m))
    return 100 * most >= percent * (n + m - most)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _nodes(docs: DataFrame, *more) -> DataFrame:
    """node, doc, text and more; a node is the doc_id where that is unique."""
    T.bound_batches(docs)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    shared = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    node = F.xxhash64(doc, "text") if shared else doc
    return docs.select(node.alias("node"), doc.alias("doc"), "text", *more)


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """node, doc, n, class, copies, a row per document, and the bitmap of a class on its own row."""

    def digests(batches):
        for b in batches:
            n, x, y, bits = [], [], [], []
            for w in T.blocks(b.column("text")):
                for s in _sets(w, k):
                    p, q = _digest(s)
                    n.append(len(s))
                    x.append(p)
                    y.append(q)
                    bits.append(_bitmap(s) if len(s) else None)
            node, doc = b.column("node"), b.column("doc")
            yield _batch({"node": node, "doc": doc, "n": pa.array(n, pa.int64()), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "bits": pa.array(bits, pa.binary())})

    d = checkpoint(rows.mapInArrow(digests, "node long, doc long, n long, x long, y long, bits binary"))
    # Texts without copies, and those without shingles, stand alone.
    key = ["n", "x", "y"]
    groups = d.where("n > 0").groupBy(*key).agg(F.min("node").alias("class"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    out = _salted(d, groups, key)
    named = F.coalesce("class", "node")
    return out.select("node", "doc", "n", named.alias("class"), F.coalesce("copies", F.lit(1)).alias("copies"), F.when(named == F.col("node"), F.col("bits")).alias("bits"))


#: Tasks that the rows of one key are dealt to.
SALTS = 16


def _salted(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left (with a column node) and what right has for its key, if anything; right's rows go to SALTS tasks each, so no task gets all rows of one key."""
    names = [c for c in right.columns if c not in key]
    many = right.select(*[F.col(c).alias(f"_{c}") for c in key], *names, F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("_salt"))
    rows = left.withColumn("_of", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int"))
    out = rows.join(many, [*[F.col(c) == F.col(f"_{c}") for c in key], F.col("_of") == F.col("_salt")], "left")
    return out.select(*left.columns, *names)


def _prefixes(rows: DataFrame, k: int, percent: int, hot: np.ndarray) -> DataFrame:
    """token, node, ranked: all ranked shingles, and of the others those that a prefix reaches.

    Of equal sets in a block the first is sent.  ``ranked`` is the number of ranked shingles of
    the set, or -1 on rows of the other parts.
    """
    bits = rows.sparkSession.sparkContext.broadcast(hot)

    def send(batches):
        for b in batches:
            node = b.column("node").to_numpy()
            for w in T.blocks(b.column("text")):
                seen, token, of, ranked = set(), [], [], []
                for i, s in enumerate(_sets(w, k)):
                    if not len(s) or (key := (len(s), *_digest(s))) in seen:
                        continue
                    seen.add(key)
                    late = member(s, bits.value)
                    first = s[(s < RANKED) & ~late]
                    token.append(first)
                    ranked.append(np.full(len(first), len(first), np.int32))
                    more = prefix_length(len(s), percent) - len(first)
                    if more > 0:
                        rest = np.r_[s[(s >= RANKED) & ~late], s[late]][:more]
                        token.append(rest)
                        ranked.append(np.full(len(rest), -1, np.int32))
                        of.append(np.full(len(first) + len(rest), node[w.rows[0] + i]))
                    else:
                        of.append(np.full(len(first), node[w.rows[0] + i]))
                if token:
                    yield _batch({"token": pa.array(np.concatenate(token).view(np.int64)), "node": pa.array(np.concatenate(of)), "ranked": pa.array(np.concatenate(ranked))})

    return rows.mapInArrow(send, "token long, node long, ranked int")


def _whole(batches, keys: list[str], most_rows: int):
    """Tables of rows sorted by keys, cut only where a key ends."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most_rows:
            t = pa.Table.from_batches(held)
            same = np.ones(t.num_rows, bool)
            for c in keys:
                x = t[c].to_numpy()
                same &= x == x[-1]
            cut = int(np.argmax(same))
            if cut:
                yield t.slice(0, cut)
                t = t.slice(cut)
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _shared(tokens: DataFrame) -> DataFrame:
    """The rows whose token has several nodes, with its document frequency."""

    def count(batches):
        for t in _whole(batches, ["token"], 100_000):
            token = t["token"].to_numpy()
            at = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            n = np.diff(np.r_[at, len(token)])
            df = np.repeat(n, n)
            keep = df > 1
            if keep.any():
                yield _batch({c: t[c].combine_chunks().filter(pa.array(keep)) for c in ("token", "node", "ranked")} | {"df": pa.array(df[keep])})

    return tokens.repartition(F.col("token")).sortWithinPartitions("token").mapInArrow(count, "token long, node long, ranked int, df long")


def candidates(rows: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """class, group: classes that may have a partner, by candidate group."""
    shared = _shared(_prefixes(rows, k, percent, frequent(rows, k, lower=True)))
    named = classes.select("node", "class", "n")
    mine = shared.join(named, "node").groupBy("class", "token").agg(F.first("n").alias("n"), F.max("ranked").alias("ranked"), F.max("df").alias("df"))
    # Of the ranked shingles those that nobody shares come first.
    by = Window.partitionBy("class")
    order = by.orderBy(F.col("ranked") < 0, "df", "token")
    mine = mine.withColumn("of_class", F.sum(F.when(F.col("ranked") >= 0, 1).otherwise(0)).over(by)).withColumn("size", F.max("ranked").over(by)).withColumn("place", F.row_number().over(order))
    reach = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    alone = F.greatest(F.col("size"), F.lit(0)) - F.col("of_class")
    kept = mine.where((F.col("ranked") < 0) | (F.col("place") <= reach - alone)).select("token", "class", "n")
    kept = checkpoint(kept)
    hubs = kept.groupBy("token").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("of")).where("of > 1")
    hung = kept.join(hubs, "token")
    hot = hung.where((F.col("of") > PAIRED) & (F.col("class") != F.col("hub"))).select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()
    bits = classes.where(F.col("node") == F.col("class")).select("class", "bits")
    edges = _pairs(hung.where(F.col("of") <= PAIRED), bits, percent).unionAll(hot)
    groups = components(edges).select(F.col("node").alias("class"), F.col("component").alias("group"))
    return _split(groups, classes, bits, percent)


def _pairs(hung: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """a, b: classes that share a token and that their lengths and bitmaps let be linked."""

    def compared(batches):
        for b in batches:
            n, m = (b.column(c).to_numpy() for c in ("n", "m"))
            x, y = (b.column(c).to_pylist() for c in ("x", "y"))
            go = np.zeros(len(n), bool)
            long = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)]).reshape(-1, 2)
            for lx, ly in np.unique(long, axis=0):
                at = np.flatnonzero((long[:, 0] == lx) & (long[:, 1] == ly))
                words = int(min(lx, ly)) // 8
                differ = np.bitwise_count(_folded([x[i] for i in at], words) ^ _folded([y[i] for i in at], words)).sum(1, dtype=np.int64)
                go[at] = _reachable(n[at], m[at], differ, percent)
            yield _batch({c: b.column(c).filter(pa.array(go)) for c in ("a", "b")})

    lists = hung.groupBy("token").agg(F.collect_list(F.struct("class", "n")).alias("l"))
    pairs = lists.select("l", F.explode("l").alias("p")).select("p", F.explode("l").alias("q")).where("p.class < q.class")
    near = (100 * F.col("p.n") >= percent * F.col("q.n")) & (100 * F.col("q.n") >= percent * F.col("p.n"))
    pairs = pairs.where(near).select(F.col("p.class").alias("a"), F.col("p.n").alias("n"), F.col("q.class").alias("b"), F.col("q.n").alias("m")).distinct()
    pairs = pairs.join(bits.select(F.col("class").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("class").alias("b"), F.col("bits").alias("y")), "b")
    return pairs.select("a", "n", "x", "b", "m", "y").mapInArrow(compared, "a long, b long")


def _split(groups: DataFrame, classes: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """class, group: groups of over a tile split to the classes that bitmaps let be linked."""
    large = groups.groupBy("group").count().where(F.col("count") > TILE).select("group")
    if not large.limit(1).count():
        return groups
    large = F.broadcast(checkpoint(large))
    sizes = classes.where(F.col("node") == F.col("class")).select("class", "n")
    tiles = _tiles(checkpoint(groups.join(large, "group").join(sizes, "class").select("class", "group", "n")), percent)
    tiles = tiles.join(bits, "class").select("group", F.explode("tiles").alias("t"), "class", "block", "n", "bits")
    tiles = tiles.select("group", "t.p", "t.q", "class", "block", "n", "bits")

    def compared(batches):
        for t in _whole(batches, ["group", "p", "q"], 2000):
            g, p, q = (t[c].to_numpy() for c in ("group", "p", "q"))
            cols = {c: t[c].to_numpy() for c in ("class", "block", "n")}
            bitmaps = t["bits"].to_pylist()
            at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            for a, z in zip(at.tolist(), [*at[1:].tolist(), len(g)], strict=True):
                cls, block, n = (cols[c][a:z] for c in ("class", "block", "n"))
                ok = _reachable_pairs(bitmaps[a:z], n, percent)
                if p[a] != q[a]:
                    ok &= block[:, None] != block[None, :]
                have = np.flatnonzero(ok.any(1))
                yield _batch({"a": pa.array(cls[have]), "b": pa.array(cls[_roots(ok)[have]])})

    keys = ["group", "p", "q"]
    edges = tiles.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, "class").mapInArrow(compared, "a long, b long")
    parts = components(edges).select(F.col("node").alias("class"), F.col("component").alias("group"))
    return groups.join(large, "group", "left_anti").select("class", "group").unionAll(parts)


def _reachable_pairs(bitmaps: list[bytes], n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets may be linked, as a matrix."""
    ok = np.zeros((len(n), len(n)), bool)
    long = np.array([len(x) for x in bitmaps])
    of = {k: np.flatnonzero(long == k) for k in np.unique(long).tolist()}
    for k, rows in of.items():
        x = _folded([bitmaps[i] for i in rows], k // 8)
        for k2, others in of.items():
            if k2 < k or 100 * n[rows].max() < percent * n[others].min():
                continue
            y = _folded([bitmaps[j] for j in others], k // 8)
            for i, mine in zip(rows, x, strict=True):
                differ = np.bitwise_count(y ^ mine).sum(1, dtype=np.int64)
                ok[i, others] = _reachable(n[i], n[others], differ, percent)
            ok[np.ix_(others, rows)] |= ok[np.ix_(rows, others)].T
    np.fill_diagonal(ok, False)
    return ok


def _roots(ok: np.ndarray) -> np.ndarray:
    """The least row that is reachable from each."""
    m = len(ok)
    root = np.arange(m)
    while True:
        low = np.minimum(root, np.where(ok, root[None, :], m).min(1, initial=m))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """class, copies, n, tiles: pairs of blocks of its group, at least as long as the threshold asks.

    Classes are dealt to blocks in order of size.  Only the sizes of a group are ordered, each
    with its number of classes; the many classes of one size are cut to blocks by hash.
    """
    sizes = members.groupBy("group", "n").agg(F.count(F.lit(1)).alias("of"))
    order = Window.partitionBy("group").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    shingles = F.col("of") * F.col("n")
    sizes = sizes.select(F.col("group").alias("of_group"), F.col("n").alias("of_n"), "of", before("of").alias("classes"), before(shingles).alias("shingles"))
    # Salted: the classes of one size meet its row in several tasks.
    salts = 16
    m = members.withColumn("salt", F.pmod(F.xxhash64("class", F.lit(2)), F.lit(salts)))
    sizes = sizes.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    m = m.join(sizes, (F.col("group") == F.col("of_group")) & (F.col("n") == F.col("of_n")) & (F.col("salt") == F.col("of_salt")))
    # A class's place among those of its size is its hash.
    place = F.pmod(F.xxhash64("class"), F.lit(1 << 20)) / (1 << 20) * F.col("of")
    block = F.floor((F.col("classes") + place) / TILE) + F.floor((F.col("shingles") + place * F.col("n")) / TILE_SHINGLES)
    m = m.withColumn("block", block.cast("int")).drop("of_group", "of_n", "of_salt", "salt", "of", "classes", "shingles")
    b = m.groupBy("group", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    c = b.select(F.col("group"), F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = b.join(c, "group").where((100 * F.col("hi2") >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * F.col("lo2")))
    pair = F.struct(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    tiles = near.groupBy("group", "block").agg(F.collect_list(pair).alias("tiles"))
    return m.join(tiles, ["group", "block"])


_PART = "group long, p int, q int, fragment int, class long, block int, n long, copies long, shingles binary"
_COUNTS = "group long, p int, q int, classes binary, blocks binary, ns binary, copies binary, counts binary"


def _partial(batches):
    """One matrix of partial overlaps for each (tile, fragment)."""
    for t in _whole(batches, ["group", "p", "q", "fragment"], 2000):
        g, p, q, f = (t[c].to_numpy() for c in ("group", "p", "q", "fragment"))
        at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (f[1:] != f[:-1])])
        blobs = t["shingles"].to_pylist()
        cols = {c: t[c].to_numpy() for c in ("class", "block", "n", "copies")}
        out = {c: [] for c in ("group", "p", "q", "classes", "blocks", "ns", "copies", "counts")}
        for a, z in zip(at, np.r_[at[1:], len(g)], strict=True):
            a, z = int(a), int(z)
            m = z - a
            sets = [np.frombuffer(x, np.uint64) for x in blobs[a:z]]
            counts = np.zeros((m, m), np.int32)
            if m == 2:
                counts[0, 1] = counts[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
            elif m > 2:
                flat = np.concatenate(sets)
                of = np.repeat(np.arange(m), [len(s) for s in sets])
                order = np.argsort(flat, kind="stable")
                flat, of = flat[order], of[order]
                new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.empty(0, bool)
                ids = np.cumsum(new) - 1
                many = np.bincount(ids)[ids] > 1 if len(ids) else np.empty(0, bool)
                ids, of = ids[many], of[many]
                if len(ids):
                    ids = np.unique(ids, return_inverse=True)[1]
                    for lo in range(0, int(ids[-1]) + 1, 4096):
                        s = slice(*np.searchsorted(ids, [lo, lo + 4096]))
                        x = np.zeros((m, min(4096, int(ids[-1]) + 1 - lo)), np.float32)
                        x[of[s], ids[s] - lo] = 1
                        counts += np.rint(x @ x.T).astype(np.int32)
            for c, v in (("group", int(g[a])), ("p", int(p[a])), ("q", int(q[a])), ("classes", cols["class"][a:z].astype(np.int64).tobytes()), ("blocks", cols["block"][a:z].astype(np.int32).tobytes()), ("ns", cols["n"][a:z].astype(np.int64).tobytes()), ("copies", cols["copies"][a:z].astype(np.int64).tobytes()), ("counts", counts.tobytes())):
                out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("group", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), *[(c, pa.binary()) for c in ("classes", "blocks", "ns", "copies", "counts")]]))


def _link(percent: int):
    def links(batches):
        for t in _whole(batches, ["group", "p", "q"], 16):
            out = {"a": [], "b": [], "links": []}
            rows = t.to_pylist()
            k = 0
            while k < len(rows):
                r = rows[k]
                m = len(r["classes"]) // 8
                total = np.zeros((m, m), np.int64)
                while k < len(rows) and (rows[k]["group"], rows[k]["p"], rows[k]["q"]) == (r["group"], r["p"], r["q"]):
                    total += np.frombuffer(rows[k]["counts"], np.int32).reshape(m, m)
                    k += 1
                cls, block, n, copies = (np.frombuffer(r[c], d) for c, d in (("classes", np.int64), ("blocks", np.int32), ("ns", np.int64), ("copies", np.int64)))
                ok = 100 * total >= percent * (n[:, None] + n[None, :] - total)
                np.fill_diagonal(ok, False)
                if r["p"] != r["q"]:
                    ok &= block[:, None] != block[None, :]
                root = _roots(ok)
                have = np.flatnonzero(ok.any(1))
                out["a"] += cls[have].tolist()
                out["b"] += cls[root[have]].tolist()
                out["links"] += (ok @ copies)[have].tolist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    return links


def verified(rows: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, links: of each tile a class, a class that it is connected with, and its linked texts."""
    tiled = _tiles(members, percent).withColumnRenamed("class", "node")

    def cut(batches):
        for b in batches:
            rest = {c: b.column(c).to_pylist() for c in ("group", "node", "block", "n", "copies", "tiles")}
            out = {c: [] for c in ("group", "p", "q", "fragment", "class", "block", "n", "copies", "shingles")}
            size = 0
            for w in T.blocks(b.column("text")):
                for i, s in enumerate(_sets(w, k), w.rows[0]):
                    cuts = np.searchsorted(s, np.array([f << 62 for f in range(1, FRAGMENTS)], np.uint64))
                    parts = [x.tobytes() for x in np.split(s, cuts)]
                    for x in rest["tiles"][i]:
                        for f, blob in enumerate(parts):
                            for c, v in (("group", rest["group"][i]), ("p", x["p"]), ("q", x["q"]), ("fragment", f), ("class", rest["node"][i]), ("block", rest["block"][i]), ("n", rest["n"][i]), ("copies", rest["copies"][i]), ("shingles", blob)):
                                out[c].append(v)
                        size += len(s)
                        if size > 1 << 19:
                            yield _part_batch(out)
                            size = 0
            yield _part_batch(out)

    # Texts of no candidate are left out before the shuffle; the join is what decides.
    bits = rows.sparkSession.sparkContext.broadcast(bloom.build(members.select(F.xxhash64("class").alias("h"))))

    def likely(batches):
        for b in batches:
            yield b.filter(pa.array(bloom.possible(bits.value, np.asarray(b.column("h")))))

    near = rows.select("node", F.xxhash64("node").alias("h"), "text").mapInArrow(likely, "node long, h long, text string").drop("h")
    parts = near.join(tiled, "node").mapInArrow(cut, _PART)
    keys = ["group", "p", "q", "fragment"]
    counts = parts.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, "class").mapInArrow(_partial, _COUNTS)
    keys = keys[:3]
    return counts.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys).mapInArrow(_link(percent), "a long, b long, links long")


def _part_batch(out: dict) -> pa.RecordBatch:
    kinds = [("group", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("fragment", pa.int32()), ("class", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("copies", pa.int64()), ("shingles", pa.binary())]
    b = pa.RecordBatch.from_pydict(out, schema=pa.schema(kinds))
    for v in out.values():
        v.clear()
    return b


def _judged(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """node, doc, n, links, component, a row per row; rows as of _nodes."""
    classes = checkpoint(_classes(rows, k))
    groups = candidates(rows, classes, k, percent)
    members = classes.where(F.col("node") == F.col("class")).select("class", "n", "copies").dropDuplicates(["class"]).join(groups, "class")
    # Equal rows have one node; a class must come once to its tiles.
    again = classes.groupBy("node").count().where("count > 1").limit(1).count()
    once = rows.dropDuplicates(["node"]) if again else rows
    links = checkpoint(verified(once, checkpoint(members), k, percent))
    parts = components(links).select(F.col("node").alias("class"), "component")
    degree = links.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("more"))
    out = _salted(classes, parts.join(degree, "class", "full"), ["class"])
    return out.select("node", "doc", "n", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "class").alias("component"))


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents it is linked with), a row per row."""
    out = _judged(_nodes(docs), k, percent)
    # Only components of several texts have another least document.
    least = out.groupBy("component").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("of")).where("of > 1").drop("of")
    out = _salted(out, least, ["component"]).withColumn("least", F.coalesce("least", "doc"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(null("doc").alias("doc_id"), F.col("n").alias("n_shingles"), null("least").alias("component_id"), F.col("links").alias("n_links"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all columns of docs."""
    rows = _nodes(docs)
    out = _judged(rows, k, percent).groupBy("component").agg(F.min(F.struct("doc", "node")).alias("least"))
    out = out.select(F.col("least.node").alias("node")).distinct()
    whole = _nodes(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Rows with one node are copies of each other; the others have nodes of their own.
    kept = whole.select("node", "row").join(out, "node", "left_semi")
    return kept.dropDuplicates(["node"]).select("row.*")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)
