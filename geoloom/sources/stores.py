"""Where tiles go: folders, tables, archives, object stores or nowhere."""

from __future__ import annotations

import gzip
import os
import time
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor
from concurrent.futures import wait as futures_wait
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.tiles import deduplicated
from geoloom.sources import archives

#: File suffixes and the media types that they stand for.
MEDIA = {
    "pbf": "application/x-protobuf", "mvt": "application/x-protobuf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp",
    "gif": "image/gif", "json": "application/json", "geojson": "application/geo+json", "html": "text/html", "avif": "image/avif",
}


def media_type(suffix: str) -> str | None:
    return MEDIA.get(suffix.lower().lstrip("."))


def suffix_of(media: str) -> str | None:
    want = media.split(";")[0].strip().lower()
    return next((s for s, m in MEDIA.items() if m == want), None)


def negotiate(suffix: str | None, accept: str | None, default: str) -> str:
    """Format of a reply: the path's suffix, else the first known accepted type, else the source's."""
    if suffix and suffix.lower() in MEDIA:
        return suffix.lower()
    for part in (accept or "").split(","):
        s = suffix_of(part)
        if s and s != "avif":
            return s
    return default


def recoded(tiles: DataFrame, compress: bool) -> DataFrame:
    """Tile data gzipped or plain, whatever it was; equal data gives equal bytes."""
    names = [c for c in tiles.columns if c != "data"]

    def one(b: bytes | None) -> bytes | None:
        if b is None:
            return None
        zipped = b[:2] == b"\x1f\x8b"
        if compress:
            return b if zipped else gzip.compress(b, 1, mtime=0)
        return gzip.decompress(b) if zipped else b

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("r"), pa.array([one(x) for x in b.column("data").to_pylist()], pa.binary())], ["r", "data"])

    rows = tiles.select(F.struct(*names).alias("r"), "data")
    return rows.mapInArrow(run, f"r {rows.schema['r'].dataType.simpleString()}, data binary").select("r.*", "data")


def write_files(tiles: DataFrame, folder: str, suffix: str = "pbf", dedup: bool = True) -> None:
    """``folder/z/x/y.suffix``; tiles that occur more than once are hard links to one shared file.

    folder must be shared by all executors.  Writing is idempotent: a task that runs again
    replaces its files.
    """

    def place(r) -> str:
        return f"{folder}/{r.z}/{r.x}/{r.y}.{suffix}"

    def put(path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{path}.{os.getpid()}"
        with open(temp, "wb") as f:
            f.write(data)
        os.replace(temp, path)

    def single(rows) -> None:
        for r in rows:
            put(place(r), bytes(r.data))

    if not dedup:
        tiles.select("z", "x", "y", "data").foreachPartition(single)
        return
    named = tiles.withColumn("tile_id", F.sha2("data", 256))
    many = named.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tile_id")
    named.join(many, "tile_id", "left_anti").select("z", "x", "y", "data").foreachPartition(single)

    def shared(rows) -> None:
        for r in rows:
            put(f"{folder}/shared/{r.tile_id}", bytes(r.data))

    def linked(rows) -> None:
        for r in rows:
            path = place(r)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            temp = f"{path}.{os.getpid()}"
            os.link(f"{folder}/shared/{r.tile_id}", temp)
            os.replace(temp, path)
            if os.path.exists(temp):  # the two were links to one file already
                os.remove(temp)

    images, refs = deduplicated(tiles)
    images.join(many, "tile_id", "left_semi").foreachPartition(shared)
    refs.join(many, "tile_id", "left_semi").foreachPartition(linked)


def read_files(spark: SparkSession, folder: str, suffix: str = "pbf") -> DataFrame:
    """z, x, y, data of a tile folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(folder)
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return df.select(part(-3).cast("int").alias("z"), part(-2).cast("long").alias("x"), F.substring_index(part(-1), ".", 1).cast("long").alias("y"), F.col("content").alias("data"))


#: Uploads that a task has under way at once.
UPLOADS = 32


def write_objects(tiles: DataFrame, url: str, suffix: str = "pbf", retries: int = 3, uploads: int = UPLOADS, wait: float = 1.0) -> None:
    """One object a tile, ``url/z/x/y.suffix``, by pyarrow's file systems.

    A task uploads ``uploads`` objects at once and holds no more than twice as many; one that
    fails is tried again after ``wait`` seconds, then twice as long, and so on.  What still fails
    fails the task, which Spark tries again.
    """
    if "://" not in url:
        raise ValueError(f"no bucket in {url!r}")

    def put(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(url)

        def upload(r) -> None:
            path = f"{base.rstrip('/')}/{r.z}/{r.x}/{r.y}.{suffix}"
            for k in range(retries + 1):
                try:
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(path) as f:
                        f.write(bytes(r.data))
                    return
                except OSError:
                    if k == retries:
                        raise
                    time.sleep(wait * 2**k)

        with ThreadPoolExecutor(uploads) as pool:
            under_way: set = set()
            for r in rows:
                under_way.add(pool.submit(upload, r))
                if len(under_way) >= 2 * uploads:
                    done, under_way = futures_wait(under_way, return_when=FIRST_COMPLETED)
                    for f in done:
                        f.result()
            for f in under_way:
                f.result()

    tiles.select("z", "x", "y", "data").foreachPartition(put)


def encoding(data: Column) -> Column:
    """The encoding header that goes with a stored tile: gzip, zstd or none."""
    head = F.substring(data, 1, 4)
    return F.when(F.substring(head, 1, 2) == F.unhex(F.lit("1F8B")), "gzip").when(head == F.unhex(F.lit("28B52FFD")), "zstd")


def write_table(tiles: DataFrame, path: str) -> None:
    """A tile table: dealt by zoom, sorted along the curve, so that lookups skip row groups."""
    from geoloom.operators.tiles import in_curve_order

    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_curve_order(tiles, n).write.mode("overwrite").partitionBy("z").parquet(path)


@dataclass(frozen=True)
class Store:
    """kind: files, mbtiles, pmtiles, objects, table or none."""

    kind: str
    path: str = ""
    suffix: str = "pbf"
    dedup: bool = True
    compress: bool = False
    metadata: dict = field(default_factory=dict)

    @classmethod
    def of(cls, path: str | None, **more) -> Store:
        """By the form of the path; no path stores nothing."""
        if not path:
            return cls("none", **more)
        if "://" in path and not path.startswith("file://"):
            return cls("objects", path, **more)
        return cls(archives.detect(path) or "files", path, **more)

    def write(self, tiles: DataFrame) -> None:
        tiles = recoded(tiles, self.compress) if self.kind != "none" else tiles
        meta = self.metadata or archives.metadata(os.path.basename(self.path) or "tiles")
        if self.kind == "files":
            write_files(tiles, self.path, self.suffix, self.dedup)
        elif self.kind == "mbtiles":
            archives.write_mbtiles(tiles, self.path, meta)
        elif self.kind == "pmtiles":
            archives.write_pmtiles(tiles, self.path, meta, self.compress)
        elif self.kind == "objects":
            write_objects(tiles, self.path, self.suffix)
        elif self.kind == "table":
            write_table(tiles, self.path)
        elif self.kind == "none":
            tiles.write.format("noop").mode("overwrite").save()
        else:
            raise ValueError(self.kind)

    def read(self, spark: SparkSession) -> DataFrame:
        if self.kind == "files":
            return read_files(spark, self.path, self.suffix)
        if self.kind in ("mbtiles", "pmtiles"):
            archives.register(spark)
            return spark.read.format(self.kind).load(self.path)
        if self.kind == "table":
            return spark.read.parquet(self.path).select("z", "x", "y", "data")
        raise ValueError(f"{self.kind} can't be read")


