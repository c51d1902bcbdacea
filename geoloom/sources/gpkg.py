"""GeoPackage files: metadata, scans and a Spark data source that reads row ranges in parallel."""

from __future__ import annotations

import os
import re
import sqlite3
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from geoloom.functions import wkb
from geoloom.operators.features import Collection, Inventory


@dataclass(frozen=True)
class Table:
    name: str
    title: str
    description: str
    extent: tuple[float, float, float, float] | None
    srid: int
    geometry: str
    geometry_type: str
    key: str | None


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def key_of(db: sqlite3.Connection, table: str) -> str | None:
    """The key column, if the key is a single one."""
    keys = [r[1] for r in db.execute(f"PRAGMA table_info({_quoted(table)})") if r[5]]
    return keys[0] if len(keys) == 1 else None


def tables(path: str) -> list[Table]:
    """The feature tables of a file."""
    db = _open(path)
    rows = db.execute(
        "SELECT c.table_name, coalesce(c.identifier, c.table_name), coalesce(c.description, ''), c.min_x, c.min_y, c.max_x, c.max_y, s.organization_coordsys_id, g.column_name, g.geometry_type_name "
        "FROM gpkg_contents c JOIN gpkg_spatial_ref_sys s ON s.srs_id = c.srs_id JOIN gpkg_geometry_columns g ON g.table_name = c.table_name WHERE c.data_type = 'features' ORDER BY c.table_name"
    ).fetchall()
    out = [Table(r[0], r[1], r[2], tuple(r[3:7]) if None not in r[3:7] else None, r[7], r[8], r[9], key_of(db, r[0])) for r in rows]
    db.close()
    return out


class _Span(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str | None, sql: str | None, schema: StructType, parts: int):
        self.path, self.table, self.sql, self.columns, self.parts = path, table, sql, schema, parts

    def partitions(self):
        if self.sql:
            return [_Span(0, 0)]
        db = _open(self.path)
        lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        db.close()
        if lo is None:
            return [_Span(0, 0)]
        step = max(1, -(-(hi + 1 - lo) // self.parts))
        return [_Span(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition):
        db = _open(self.path)
        names = ", ".join(_quoted(f.name) for f in self.columns)
        if self.sql:
            rows = db.execute(f"SELECT {names} FROM ({self.sql})")
        else:
            rows = db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.lo, partition.hi))
        kinds = [f.dataType for f in self.columns]
        for r in rows:
            yield tuple(None if v is None else int(v) if isinstance(k, LongType) else float(v) if isinstance(k, DoubleType) else bytes(v) if isinstance(k, BinaryType) else str(v) for v, k in zip(r, kinds, strict=True))
        db.close()


class GpkgSource(DataSource):
    """``spark.read.format("gpkg").option("table", t).load(path)``, or option ``sql``."""

    @classmethod
    def name(cls):
        return "gpkg"

    def schema(self):
        db = _open(self.options["path"])
        if sql := self.options.get("sql"):
            cur = db.execute(f"SELECT * FROM ({sql}) LIMIT 1")
            names, row = [c[0] for c in cur.description], cur.fetchone()
            kinds = [LongType() if isinstance(v, int) else DoubleType() if isinstance(v, float) else BinaryType() if isinstance(v, bytes) else StringType() for v in (row or [None] * len(names))]
        else:
            info = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
            geometries = {r[0] for r in db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (self.options["table"],))}
            names = [r[1] for r in info]
            kinds = [BinaryType() if r[1] in geometries else _kind(r[2]) for r in info]
        db.close()
        return StructType([StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("table"), self.options.get("sql"), schema, int(self.options.get("partitions", "8")))


def _kind(declared: str):
    d = declared.upper()
    if "INT" in d or d == "BOOLEAN":
        return LongType()
    if d.startswith(("REAL", "DOUBLE", "FLOAT")):
        return DoubleType()
    return BinaryType() if d.startswith("BLOB") else StringType()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GpkgSource)


def read(spark: SparkSession, path: str, table: str | None = None, sql: str | None = None, geometry: str | None = None) -> DataFrame:
    """A table or a query, with GeoJSON and envelope columns of its geometry."""
    register(spark)
    reader = spark.read.format("gpkg")
    df = (reader.option("sql", sql) if sql else reader.option("table", table)).load(path)
    if not geometry:
        return df
    names = [c for c in df.columns if c != geometry]

    def run(batches):
        for b in batches:
            shapes = [wkb.decode_gpkg(bytes(x))[0] if x is not None else None for x in b.column("g").to_pylist()]
            boxes = [wkb.envelope(s) for s in shapes]
            sides = [pa.array([x[k] if x else None for x in boxes], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("r"), pa.array([wkb.geojson(s) for s in shapes], pa.string()), *sides], ["r", "g", "xmin", "ymin", "xmax", "ymax"])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col(f"`{geometry}`").alias("g"))
    kind = rows.schema["r"].dataType.simpleString()
    out = rows.mapInArrow(run, f"r {kind}, g string, xmin double, ymin double, xmax double, ymax double")
    return out.select("r.*", F.col("g").alias(geometry), "xmin", "ymin", "xmax", "ymax")


def collection(spark: SparkSession, path: str, t: Table) -> Collection:
    df = read(spark, path, t.name, geometry=t.geometry)
    plain = tuple(f.name for f in df.schema if f.name not in (t.geometry, t.key, "xmin", "ymin", "xmax", "ymax") and isinstance(f.dataType, (LongType, DoubleType, StringType)))
    return Collection(t.name, df, t.key, envelope=("xmin", "ymin", "xmax", "ymax"), geometry=t.geometry, queryable=plain, title=t.title, description=t.description, srid=t.srid)


def search(folder: str, suffix: str = ".gpkg") -> list[str]:
    """Files below a folder."""
    return sorted(os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f.lower().endswith(suffix))


def common_folder(paths: list[str]) -> str:
    """The longest folder that all paths lie in; a single path is its own."""
    if len(paths) < 2:
        return paths[0] if paths else ""
    parts = [p.split("/") for p in paths]
    n = 0
    while all(len(p) > n for p in parts) and len({p[n] for p in parts}) == 1:
        n += 1
    return "/".join(parts[0][:n]) or ("/" if paths[0].startswith("/") else "")


def scan(spark: SparkSession, folder: str, inventory: Inventory) -> None:
    """Add the feature tables of all files below a folder; what fails is kept as a warning."""
    found: dict[str, tuple[str, Table]] = {}
    for path in search(folder):
        try:
            found |= {t.name: (path, t) for t in tables(path)}
        except sqlite3.Error as e:
            inventory.warnings.append(f"{path}: {e}")
    inventory.scan(found, lambda _, s: collection(spark, *s))


def write(path: str, name: str, rows: list[tuple], columns: list[tuple[str, str]], geometry_type: str, srid: int = 4326) -> None:
    """A small file for tests: columns are (name, type); rows end with a geometry (kind, coordinates)."""
    db = sqlite3.connect(path)
    db.executescript(
        "CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);"
        "CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);"
        "CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);"
    )
    if not re.fullmatch(r"\w+", name):
        raise ValueError(name)
    db.execute("INSERT OR REPLACE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, '', '')", (str(srid), srid, srid))
    boxes = [b for r in rows if (b := wkb.envelope(r[-1]))]
    extent = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (None,) * 4
    db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', '', ?, ?, ?, ?, ?)", (name, name, *extent, srid))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (name, geometry_type, srid))
    db.execute(f"CREATE TABLE {name} ({', '.join(f'{_quoted(n)} {k}' for n, k in columns)}, geom BLOB)")
    db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (len(columns) + 1))})", [(*r[:-1], wkb.encode_gpkg(r[-1], srid) if r[-1] else None) for r in rows])
    db.commit()
    db.close()
