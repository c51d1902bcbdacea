"""Tile archives: MBTiles and PMTiles, written from tile frames and read as Spark data sources.

Archives are single files, so one task writes each, from rows that arrive sorted; everything
before it is distributed.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geoloom.operators.tiles import deduplicated, in_curve_order

_TILE_SCHEMA = "z int, x long, y long, data binary"

# -- MBTiles ------------------------------------------------------------------------------

#: Tables and statements of the public layout of MBTiles with shared images.
_LAYOUT = """
CREATE TABLE IF NOT EXISTS map (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_id TEXT);
CREATE TABLE IF NOT EXISTS images (tile_data BLOB, tile_id TEXT);
CREATE TABLE IF NOT EXISTS metadata (name TEXT, value TEXT);
CREATE UNIQUE INDEX IF NOT EXISTS map_index ON map (zoom_level, tile_column, tile_row);
CREATE UNIQUE INDEX IF NOT EXISTS images_id ON images (tile_id);
CREATE UNIQUE INDEX IF NOT EXISTS metadata_name ON metadata (name);
CREATE VIEW IF NOT EXISTS tiles AS SELECT map.zoom_level AS zoom_level, map.tile_column AS tile_column, map.tile_row AS tile_row, images.tile_data AS tile_data
  FROM map JOIN images ON images.tile_id = map.tile_id;
"""


def metadata(name: str, form: str = "pbf", description: str = "", attribution: str = "", version: str = "2", bounds=(-180.0, -85.0511, 180.0, 85.0511), minzoom: int = 0, maxzoom: int = 0, layers: list | None = None) -> dict:
    """The keys of an archive's metadata."""
    x, y = (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2
    out = {
        "name": name, "format": form, "description": description, "attribution": attribution, "version": version,
        "bounds": ",".join(f"{b:g}" for b in bounds), "center": f"{x:g},{y:g},{minzoom}", "minzoom": str(minzoom), "maxzoom": str(maxzoom),
    }
    if layers is not None:
        out["json"] = json.dumps({"vector_layers": layers})
    return out


def init_mbtiles(path: str, meta: dict) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with sqlite3.connect(path) as db:
        db.executescript(_LAYOUT)
        db.executemany("INSERT OR REPLACE INTO metadata VALUES (?, ?)", sorted(meta.items()))
    db.close()


def write_mbtiles(tiles: DataFrame, path: str, meta: dict, batch: int = 200) -> None:
    """Images once and the map of tiles; rows counted from the bottom.  path must be shared."""
    init_mbtiles(path, meta)
    images, refs = deduplicated(tiles)
    sql = {
        "images": "INSERT OR IGNORE INTO images (tile_id, tile_data) VALUES (?, ?)",
        "map": "INSERT OR REPLACE INTO map (zoom_level, tile_column, tile_row, tile_id) VALUES (?, ?, ?, ?)",
    }

    def writer(kind: str):
        def write(rows: Iterator) -> None:
            db = sqlite3.connect(path, timeout=60)
            held: list = []

            def put():
                with db:
                    db.executemany(sql[kind], held)
                held.clear()

            for r in rows:
                held.append((r.tile_id, bytes(r.data)) if kind == "images" else (r.z, r.x, (1 << r.z) - 1 - r.y, r.tile_id))
                if len(held) >= batch:
                    put()
            put()
            db.close()

        return write

    images.coalesce(1).foreachPartition(writer("images"))
    refs.coalesce(1).foreachPartition(writer("map"))


def read_metadata(path: str) -> dict:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    out = dict(db.execute("SELECT name, value FROM metadata").fetchall())
    db.close()
    return out


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _MbtilesReader(DataSourceReader):
    def __init__(self, path: str, parts: int):
        self.path, self.parts = path, parts

    def _table(self, db) -> str:
        names = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
        if "map" in names and "images" in names:
            return "map JOIN images USING (tile_id)"
        if "tiles" in names:
            return "tiles"
        raise ValueError(f"{self.path} has no tiles")

    def partitions(self):
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        lo, hi = db.execute(f"SELECT min(tile_column), max(tile_column) FROM {self._table(db)}").fetchone()
        db.close()
        if lo is None:
            return [_Rows(0, 0)]
        step = max(1, -(-(hi + 1 - lo) // self.parts))
        return [_Rows(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition):
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        rows = db.execute(f"SELECT zoom_level, tile_column, tile_row, tile_data FROM {self._table(db)} WHERE tile_column >= ? AND tile_column < ?", (partition.lo, partition.hi))
        for z, x, row, data in rows:
            yield z, x, (1 << z) - 1 - row, data
        db.close()


class MbtilesSource(DataSource):
    """``spark.read.format("mbtiles").load(path)``: z, x, y (from the top), data."""

    @classmethod
    def name(cls):
        return "mbtiles"

    def schema(self):
        return _TILE_SCHEMA

    def reader(self, schema):
        return _MbtilesReader(self.options["path"], int(self.options.get("partitions", "8")))


# -- PMTiles ------------------------------------------------------------------------------

#: Fixed values of the archive specification, version 3.
_HEADER = 127
_GZIP, _NONE = 2, 1
_TYPES = {"pbf": 1, "mvt": 1, "png": 2, "jpg": 3, "jpeg": 3, "webp": 4, "avif": 5}


def tile_id(z: int, x: int, y: int) -> int:
    """Place of a tile on the Hilbert curves of all levels."""
    d, s = ((1 << 2 * z) - 1) // 3, 1 << z
    n = s >> 1
    while n:
        rx, ry = int(bool(x & n)), int(bool(y & n))
        d += n * n * ((3 * rx) ^ ry)
        x, y = x & (n - 1), y & (n - 1)
        if not ry:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        n >>= 1
    return d


def tile_of_id(d: int) -> tuple[int, int, int]:
    z = 0
    while ((1 << 2 * (z + 1)) - 1) // 3 <= d:
        z += 1
    t = d - ((1 << 2 * z) - 1) // 3
    x = y = 0
    n = 1
    while n < 1 << z:
        rx = t // 2 & 1
        ry = (t ^ rx) & 1
        if not ry:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        x, y = x + n * rx, y + n * ry
        t //= 4
        n <<= 1
    return z, x, y


def _varints(values) -> bytes:
    out = bytearray()
    for v in values:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Entries of (id, run, length, offset), in four columns."""
    ids = [e[0] for e in entries]
    steps = [b - a for a, b in zip([0, *ids], ids, strict=False)]
    offsets, after = [], None
    for _, _, length, offset in entries:
        offsets.append(0 if offset == after else offset + 1)
        after = offset + length
    return gzip.compress(_varints([len(entries), *steps, *[e[1] for e in entries], *[e[2] for e in entries], *offsets]), mtime=0)


def _read_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    raw, at = gzip.decompress(data), 0

    def varint():
        nonlocal at
        v = shift = 0
        while True:
            b = raw[at]
            at += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    n = varint()
    ids, last = [], 0
    for _ in range(n):
        last += varint()
        ids.append(last)
    runs, lengths = [varint() for _ in range(n)], [varint() for _ in range(n)]
    out: list = []
    for i in range(n):
        o = varint()
        out.append((ids[i], runs[i], lengths[i], out[-1][3] + out[-1][2] if o == 0 and i else o - 1))
    return out


class PmtilesWriter:
    """Takes tiles in order of their ids; equal tiles are stored once, runs of them as one entry."""

    def __init__(self, path: str):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self.path, self.spool = path, open(path + ".data", "wb")  # noqa: SIM115
        self.entries: list[list[int]] = []
        self.known: dict[bytes, tuple[int, int]] = {}
        self.size = self.addressed = 0

    def put(self, d: int, data: bytes) -> None:
        self.addressed += 1
        digest = hashlib.sha256(data).digest()
        if digest not in self.known:
            self.spool.write(data)
            self.known[digest] = (self.size, len(data))
            self.size += len(data)
        offset, length = self.known[digest]
        last = self.entries[-1] if self.entries else None
        if last and last[3] == offset and last[0] + last[1] == d:
            last[1] += 1
        else:
            self.entries.append([d, 1, length, offset])

    def finalize(self, meta: dict, compressed: bool = False) -> None:
        self.spool.close()
        entries = [tuple(e) for e in self.entries]
        root, leaves, size = _directory(entries), b"", 4096
        while len(root) > 16384 - _HEADER:
            tops, leaves = [], b""
            for k in range(0, len(entries), size):
                part = _directory(entries[k : k + size])
                tops.append((entries[k][0], 0, len(part), len(leaves)))
                leaves += part
            root, size = _directory(tops), size * 2
        info = gzip.compress(json.dumps(meta).encode(), mtime=0)
        at = [_HEADER, _HEADER + len(root)]
        at += [at[1] + len(info), at[1] + len(info) + len(leaves)]
        zs = [tile_of_id(entries[k][0])[0] for k in (0, -1)] if entries else [0, 0]
        b = [float(v) for v in meta.get("bounds", "-180,-85,180,85").split(",")]
        e7 = [round(v * 1e7) for v in b]
        head = struct.pack(
            "<7sB11Q6B4iB2i", b"PMTiles", 3, at[0], len(root), at[1], len(info), at[2], len(leaves), at[3], self.size,
            self.addressed, len(entries), len(self.known), 1, _GZIP, _GZIP if compressed else _NONE, _TYPES.get(meta.get("format", "pbf"), 0), *zs,
            *e7, zs[0], (e7[0] + e7[2]) // 2, (e7[1] + e7[3]) // 2,
        )
        with open(self.path, "wb") as out, open(self.path + ".data", "rb") as data:
            for part in (head, root, info, leaves):
                out.write(part)
            while chunk := data.read(1 << 20):
                out.write(chunk)
        os.remove(self.path + ".data")


def write_pmtiles(tiles: DataFrame, path: str, meta: dict, compressed: bool = False, partitions: int = 8) -> None:
    """Sorted along the curve by many tasks, written by one.  path must be shared."""

    def write(rows: Iterator) -> None:
        w = PmtilesWriter(path)
        for r in rows:
            w.put(r.curve, bytes(r.data))
        w.finalize(meta, compressed)

    in_curve_order(tiles, partitions).repartition(1).sortWithinPartitions("curve").foreachPartition(write)


class Pmtiles:
    """Random access to an archive."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            h = struct.unpack("<7sB11Q6B4iB2i", f.read(_HEADER))
            if h[0] != b"PMTiles" or h[1] != 3:
                raise ValueError(f"{path} is no archive of version 3")
            self.header = dict(zip(("root", "root_size", "meta", "meta_size", "leaf", "leaf_size", "data", "data_size", "addressed", "entries", "contents"), h[2:13], strict=True)) | {"minzoom": h[17], "maxzoom": h[18], "tile_compression": h[15]}
            f.seek(self.header["meta"])
            self.metadata = json.loads(gzip.decompress(f.read(self.header["meta_size"])) or b"{}")

    def _dir(self, f, offset: int, size: int):
        f.seek(offset)
        return _read_directory(f.read(size))

    def entries(self):
        """All (id, run, length, offset)."""
        with open(self.path, "rb") as f:
            for e in self._dir(f, self.header["root"], self.header["root_size"]):
                if e[1]:
                    yield e
                else:
                    yield from self._dir(f, self.header["leaf"] + e[3], e[2])

    def get(self, z: int, x: int, y: int) -> bytes | None:
        d = tile_id(z, x, y)
        with open(self.path, "rb") as f:
            entries = self._dir(f, self.header["root"], self.header["root_size"])
            for _ in range(4):
                e = max((e for e in entries if e[0] <= d), default=None)
                if e is None or (e[1] and d >= e[0] + e[1]):
                    return None
                if e[1]:
                    f.seek(self.header["data"] + e[3])
                    return f.read(e[2])
                entries = self._dir(f, self.header["leaf"] + e[3], e[2])
        return None


class _PmtilesReader(DataSourceReader):
    def __init__(self, path: str, parts: int):
        self.path, self.parts = path, parts

    def partitions(self):
        n = sum(1 for _ in Pmtiles(self.path).entries())
        step = max(1, -(-n // self.parts))
        return [_Rows(a, min(a + step, n)) for a in range(0, n, step)] or [_Rows(0, 0)]

    def read(self, partition):
        p = Pmtiles(self.path)
        with open(self.path, "rb") as f:
            for k, (d, run, length, offset) in enumerate(p.entries()):
                if partition.lo <= k < partition.hi:
                    f.seek(p.header["data"] + offset)
                    data = f.read(length)
                    for i in range(run):
                        yield (*tile_of_id(d + i), data)


class PmtilesSource(DataSource):
    """``spark.read.format("pmtiles").load(path)``: z, x, y, data."""

    @classmethod
    def name(cls):
        return "pmtiles"

    def schema(self):
        return _TILE_SCHEMA

    def reader(self, schema):
        return _PmtilesReader(self.options["path"], int(self.options.get("partitions", "8")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MbtilesSource)
    spark.dataSource.register(PmtilesSource)


def detect(path: str) -> str | None:
    """Kind of an archive by its suffix."""
    return {".mbtiles": "mbtiles", ".pmtiles": "pmtiles"}.get(os.path.splitext(path)[1].lower())


def tile_at(tiles: DataFrame, z: int, x: int, y: int) -> bytes | None:
    """Point lookup."""
    r = tiles.where((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)).select("data").take(1)
    return bytes(r[0].data) if r else None
