"""Tile matrix sets as small frames, tile arithmetic, covers and zoom steps."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.columns import HALF, power_of_two

#: Metres of a pixel in the OGC definition of a scale.
PIXEL = 0.00028
#: Share of a tile by which rounding may be out.
EDGE = 1e-9


@dataclass(frozen=True)
class Level:
    z: int
    cell: float
    scale: float
    left: float
    top: float
    tile_width: int
    tile_height: int
    columns: int
    rows: int


@dataclass(frozen=True)
class Grid:
    """A tile matrix set; levels in order of zoom."""

    name: str
    srid: int
    levels: tuple[Level, ...]
    title: str = ""

    @property
    def minzoom(self) -> int:
        return self.levels[0].z

    @property
    def maxzoom(self) -> int:
        return self.levels[-1].z

    def level(self, z: int) -> Level:
        for v in self.levels:
            if v.z == z:
                return v
        raise ValueError(f"{self.name} has no level {z}")

    def valid(self, z: int, x: int, y: int) -> bool:
        return self.minzoom <= z <= self.maxzoom and 0 <= x < self.level(z).columns and 0 <= y < self.level(z).rows

    def bounds(self, z: int, x: int, y: int) -> tuple[float, float, float, float]:
        if not self.valid(z, x, y):
            raise ValueError(f"no tile {z}/{x}/{y} in {self.name}")
        v = self.level(z)
        w, h = v.cell * v.tile_width, v.cell * v.tile_height
        return v.left + x * w, v.top - (y + 1) * h, v.left + (x + 1) * w, v.top - y * h

    def pixel_width(self, z: int, tile_size: int) -> float:
        v = self.level(z)
        return v.cell * v.tile_width / tile_size


def web_mercator(maxzoom: int = 24) -> Grid:
    levels = []
    for z in range(maxzoom + 1):
        cell = 2 * HALF / 256 / 2**z
        levels.append(Level(z, cell, cell / PIXEL, -HALF, HALF, 256, 256, 2**z, 2**z))
    return Grid("WebMercatorQuad", 3857, tuple(levels), "Google Maps Compatible for the World")


def world_wgs84(maxzoom: int = 17) -> Grid:
    metres = 111319.49079327358  # of a degree at the equator
    levels = [Level(z, 180 / 256 / 2**z, 180 / 256 / 2**z * metres / PIXEL, -180.0, 90.0, 256, 256, 2 ** (z + 1), 2**z) for z in range(maxzoom + 1)]
    return Grid("WorldCRS84Quad", 4326, tuple(levels), "CRS84 for the World")


def from_json(doc: dict | str | Path) -> Grid:
    """A grid from an OGC tile matrix set document or its file."""
    if not isinstance(doc, dict):
        doc = json.loads(Path(doc).read_text())
    flipped = [a.lower() for a in doc.get("orderedAxes", [])][:1] in (["lat"], ["n"], ["y"])
    levels = []
    for k, m in enumerate(doc["tileMatrices"]):
        a, b = m["pointOfOrigin"]
        left, top = (b, a) if flipped else (a, b)
        z = int(m["id"]) if str(m["id"]).isdigit() else k
        levels.append(Level(z, float(m["cellSize"]), float(m["scaleDenominator"]), float(left), float(top), int(m["tileWidth"]), int(m["tileHeight"]), int(m["matrixWidth"]), int(m["matrixHeight"])))
    crs = doc["crs"] if isinstance(doc["crs"], str) else doc["crs"].get("uri", "")
    code = crs.rstrip("/").rsplit("/", 1)[-1].rsplit(":", 1)[-1]
    srid = 4326 if code == "CRS84" else int(code)
    return Grid(doc["id"], srid, tuple(sorted(levels, key=lambda v: v.z)), doc.get("title", ""))


def to_json(g: Grid) -> dict:
    return {
        "id": g.name,
        "title": g.title,
        "crs": f"http://www.opengis.net/def/crs/EPSG/0/{g.srid}",
        "tileMatrices": [
            {
                "id": str(v.z), "scaleDenominator": v.scale, "cellSize": v.cell, "cornerOfOrigin": "topLeft", "pointOfOrigin": [v.left, v.top],
                "tileWidth": v.tile_width, "tileHeight": v.tile_height, "matrixWidth": v.columns, "matrixHeight": v.rows,
            }
            for v in g.levels
        ],
    }


class Grids:
    """Grids by name, with the built-in ones."""

    def __init__(self):
        self._all = {g.name: g for g in (web_mercator(), world_wgs84())}

    def add(self, g: Grid) -> None:
        self._all[g.name] = g

    def get(self, name: str = "WebMercatorQuad") -> Grid:
        return self._all[name]

    def names(self) -> list[str]:
        return sorted(self._all)


def level_frame(spark: SparkSession, g: Grid) -> DataFrame:
    """A row for each level."""
    rows = [(v.z, v.cell, v.scale, v.left, v.top, v.tile_width, v.tile_height, v.columns, v.rows) for v in g.levels]
    return spark.createDataFrame(rows, "z int, cell double, scale double, `left` double, top double, tile_width int, tile_height int, columns long, rows long")


def tiles(spark: SparkSession, g: Grid, minzoom: int, maxzoom: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """z, x, y and bounds of all tiles of the levels, or of those that touch a box in the grid's units.

    Columns of a level are exploded, then rows, so the enumeration is spread over tasks.
    """
    v = level_frame(spark, g).where(F.col("z").between(minzoom, maxzoom))
    w, h = F.col("cell") * F.col("tile_width"), F.col("cell") * F.col("tile_height")
    span = [F.lit(0).cast("long"), F.col("columns") - 1, F.lit(0).cast("long"), F.col("rows") - 1]
    if box:
        x0, y0, x1, y1 = (F.lit(float(b)) for b in box)
        span = [
            F.greatest(span[0], (F.ceil((x0 - F.col("left")) / w) - 1).cast("long")),
            F.least(span[1], F.floor((x1 - F.col("left")) / w).cast("long")),
            F.greatest(span[2], (F.ceil((F.col("top") - y1) / h) - 1).cast("long")),
            F.least(span[3], F.floor((F.col("top") - y0) / h).cast("long")),
        ]
    v = v.select("*", *[s.alias(n) for s, n in zip(span, ("c0", "c1", "r0", "r1"), strict=True)]).where("c0 <= c1 AND r0 <= r1")
    v = v.withColumn("x", F.explode(F.sequence("c0", "c1"))).withColumn("y", F.explode(F.sequence("r0", "r1")))
    left, top = F.col("left"), F.col("top")
    return v.select(
        "z", "x", "y",
        (left + F.col("x") * w).alias("xmin"), (top - (F.col("y") + 1) * h).alias("ymin"), (left + (F.col("x") + 1) * w).alias("xmax"), (top - F.col("y") * h).alias("ymax"),
    )


def one_tile(spark: SparkSession, g: Grid, z: int, x: int, y: int) -> DataFrame:
    """z, x, y and bounds of a tile."""
    b = g.bounds(z, x, y)
    return spark.range(1).select(F.lit(z).alias("z"), F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"), *[F.lit(float(v)).alias(n) for v, n in zip(b, ("xmin", "ymin", "xmax", "ymax"), strict=True)])


def by_level(g: Grid, z: Column, value) -> Column:
    """What value tells of the level that a column names; null beyond the grid's levels."""
    at = {v.z: value(v) for v in g.levels}
    first = g.minzoom
    held = F.array(*[F.lit(at.get(k)) for k in range(first, g.maxzoom + 1)])
    return F.get(held, z.cast("int") - first)


def cover(df: DataFrame, z: Column, envelope=("xmin", "ymin", "xmax", "ymax"), buffer: float = 0.0, keep=None, grid: Grid | None = None) -> DataFrame:
    """A row for each tile that a feature's closed envelope touches: z, x, y and the kept columns.

    Tiles are those of a grid, in whose units the envelopes are, or of Web Mercator.  ``buffer``
    is a share of a tile.  Rows without an envelope go.
    """
    x0, y0, x1, y1 = (F.col(c) for c in envelope)
    if grid is None:
        w = F.lit(2 * HALF) / F.pow(F.lit(2.0), F.col("_z"))
        last = power_of_two(F.col("_z")) - 1
        level = {"_w": w, "_h": w, "_left": F.lit(-HALF), "_top": F.lit(HALF), "_cn": last, "_rn": last}
    else:
        of = lambda value: by_level(grid, F.col("_z"), value)
        level = {
            "_w": of(lambda v: float(v.cell * v.tile_width)), "_h": of(lambda v: float(v.cell * v.tile_height)), "_left": of(lambda v: float(v.left)),
            "_top": of(lambda v: float(v.top)), "_cn": of(lambda v: v.columns - 1).cast("long"), "_rn": of(lambda v: v.rows - 1).cast("long"),
        }
    share = F.lit(float(buffer))
    left, top, w, h = (F.col(c) for c in ("_left", "_top", "_w", "_h"))
    # A little wide, for rounding; the exact test on the tiles' bounds follows.
    sides = {"_x0": x0 - w * share, "_y0": y0 - h * share, "_x1": x1 + w * share, "_y1": y1 + h * share}
    lo = lambda v: F.greatest(F.lit(0).cast("long"), (F.ceil(v - EDGE) - 1).cast("long"))
    hi = lambda v, n: F.least(F.col(n), F.floor(v + EDGE).cast("long"))
    span = {
        "_c0": lo((F.col("_x0") - left) / w),
        "_c1": hi((F.col("_x1") - left) / w, "_cn"),
        "_r0": lo((top - F.col("_y1")) / h),
        "_r1": hi((top - F.col("_y0")) / h, "_rn"),
    }
    names = list(keep) if keep is not None else [c for c in df.columns if c not in ("z", "x", "y")]
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(names)]
    out = df.where(x0.isNotNull() & y0.isNotNull()).withColumn("_z", z.cast("int")).withColumns(level).where("_w IS NOT NULL")
    out = out.withColumns(sides).withColumns(span).where("_c0 <= _c1 AND _r0 <= _r1")
    out = out.select("_z", *level, *sides, "_r0", "_r1", *kept, F.explode(F.sequence("_c0", "_c1")).alias("_x"))
    out = out.where((left + F.col("_x") * w <= F.col("_x1")) & (left + (F.col("_x") + 1) * w >= F.col("_x0")))
    out = out.withColumn("_y", F.explode(F.sequence("_r0", "_r1")))
    out = out.where((top - (F.col("_y") + 1) * h <= F.col("_y1")) & (top - F.col("_y") * h >= F.col("_y0")))
    return out.select(F.col("_z").alias("z"), F.col("_x").alias("x"), F.col("_y").alias("y"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)])


def zoom_steps(queries: list[tuple[int, int | None]], grids: list[tuple[int, int]] = (), minzoom: int | None = None) -> list[int]:
    """Zooms at which the query or the grid changes.

    queries: (minzoom, maxzoom) of each; grids: (minzoom, maxzoom) of each, if there are several.
    """
    first = minzoom if minzoom is not None else min([q for q, _ in queries], default=0)
    steps = {first} | {q for q, _ in queries}
    if len(grids) > 1:
        for lo, hi in grids:
            steps |= {lo, hi + 1} if hi < max(h for _, h in grids) else {lo}
    return sorted(s for s in steps if s >= first)


def step_of(steps: list[int], z: int) -> int | None:
    """The greatest step that is no greater than z."""
    return max((s for s in steps if s <= z), default=None)


def grid_of(grids: list[Grid], z: int, last: bool = False) -> Grid | None:
    fit = [g for g in grids if g.minzoom <= z <= g.maxzoom]
    return (fit[-1] if last else fit[0]) if fit else None


def cache_age(spans: list[tuple[int, int | None, int]], z: int) -> int | None:
    """max-age of the last (minzoom, maxzoom, seconds) that holds z."""
    fit = [a for lo, hi, a in spans if lo <= z and (hi is None or z <= hi)]
    return fit[-1] if fit else None
