"""Vector layers: queries by zoom, templates with variables, and the rows of a tile."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from geoloom.functions.columns import shifted
from geoloom.functions.projection import transform_box
from geoloom.operators.grids import Grid

VARIABLES = ("bbox", "bbox_unbuffered", "zoom", "x", "y", "z", "pixel_width", "scale_denominator")
_VAR = re.compile(r"!(\w+)!")


class MissingFilter(Exception):
    pass


@dataclass(frozen=True)
class TileQuery:
    minzoom: int = 0
    maxzoom: int | None = None
    sql: str | None = None
    simplify: bool | None = None
    tolerance: str | None = None

    def covers(self, z: int) -> bool:
        return self.minzoom <= z and (self.maxzoom is None or z <= self.maxzoom)


@dataclass(frozen=True)
class Layer:
    name: str
    table: str | None = None
    geometry: str | None = None
    geometry_type: str = "GEOMETRY"
    srid: int = 3857
    fid: str | None = None
    queries: tuple[TileQuery, ...] = ()
    minzoom: int | None = None
    maxzoom: int | None = None
    tile_size: int = 4096
    buffer: int | None = None
    simplify: bool = False
    tolerance: str = "!pixel_width!/2"
    make_valid: bool = False
    shift_longitude: bool = False
    limit: int | None = None
    x: str = "x"
    y: str = "y"
    envelope: tuple[str, str, str, str] | None = None
    time: str = "ts"
    fields: tuple[str, ...] = field(default_factory=tuple)

    def query(self, z: int, attribute: str = "sql"):
        """The attribute of the covering query with the highest minzoom that has it."""
        fit = sorted((q for q in self.queries if q.covers(z) and getattr(q, attribute) is not None), key=lambda q: q.minzoom)
        return getattr(fit[-1], attribute) if fit else None

    def simplified(self, z: int) -> bool:
        own = self.query(z, "simplify")
        return self.simplify if own is None else own

    def tolerance_at(self, z: int, pixel_width: float) -> float:
        """The tolerance's arithmetic with its variables replaced."""
        text = _VAR.sub(lambda m: {"pixel_width": repr(pixel_width), "zoom": str(z)}[m[1]], self.query(z, "tolerance") or self.tolerance)
        if not re.fullmatch(r"[\d.eE+\-*/() ]+", text):
            raise ValueError(f"tolerance: {text!r}")
        return float(eval(text, {"__builtins__": {}}))  # noqa: S307  only numbers and arithmetic

    def visible(self, z: int) -> bool:
        lows = [q.minzoom for q in self.queries]
        lo = self.minzoom if self.minzoom is not None else min(lows, default=0)
        return lo <= z and (self.maxzoom is None or z <= self.maxzoom)


@dataclass(frozen=True)
class Bound:
    """A template ready for Spark: named parameters and their values."""

    sql: str
    args: dict
    spatial: bool


def bind(sql: str, grid: Grid, layer: Layer, z: int, x: int, y: int, filters: dict | None = None) -> Bound:
    """Variables become named parameters, each once however often it is used.

    A box becomes four of them.  Other names are filters, which must be given.
    """
    width = grid.pixel_width(z, layer.tile_size)
    plain = grid.bounds(z, x, y)
    pad = width * (layer.buffer or 0)
    box = (plain[0] - pad, plain[1] - pad, plain[2] + pad, plain[3] + pad)
    values = {"zoom": z, "z": z, "x": x, "y": y, "pixel_width": width, "scale_denominator": grid.level(z).scale}
    args: dict = {}
    used = set(_VAR.findall(sql))

    def one(m: re.Match) -> str:
        name = m[1]
        if name in ("bbox", "bbox_unbuffered"):
            b = transform_box(box if name == "bbox" else plain, grid.srid, layer.srid, width)
            for k, v in zip(("xmin", "ymin", "xmax", "ymax"), b, strict=True):
                args[f"{name}_{k}"] = float(v)
            return ", ".join(f":{name}_{k}" for k in ("xmin", "ymin", "xmax", "ymax"))
        if name in values:
            args[name] = values[name]
        elif filters and name in filters:
            args[name] = filters[name]
        else:
            raise MissingFilter(name)
        return f":{name}"

    text = _VAR.sub(one, sql)
    spatial = "bbox" not in used and not ({"x", "y"} <= used and used & {"zoom", "z"})
    return Bound(text, args, spatial)


def source_sql(layer: Layer, z: int) -> str:
    return layer.query(z) or f"SELECT * FROM {layer.table}"


def variables(sql: str) -> set[str]:
    return set(_VAR.findall(sql))


def bind_zoom(sql: str, grid: Grid, layer: Layer, z: int, box: tuple[float, float, float, float] | None = None) -> Bound:
    """A template for all tiles of a zoom: boxes become that of the grid's level, or what of it box (in the grid's units) holds.

    For templates that use the box to filter; those that use x and y are for ``placed``.
    """
    v = grid.level(z)
    width = grid.pixel_width(z, layer.tile_size)
    pad = width * (layer.buffer or 0)
    whole = (v.left, v.top - v.rows * v.cell * v.tile_height, v.left + v.columns * v.cell * v.tile_width, v.top)
    if box:
        # Tiles that touch the box reach over its sides.
        w, h = v.cell * v.tile_width, v.cell * v.tile_height
        whole = (max(whole[0], box[0] - w), max(whole[1], box[1] - h), min(whole[2], box[2] + w), min(whole[3], box[3] + h))
    wide = transform_box((whole[0] - pad, whole[1] - pad, whole[2] + pad, whole[3] + pad), grid.srid, layer.srid, v.cell * v.tile_width / 4)
    values = {"zoom": z, "z": z, "pixel_width": width, "scale_denominator": v.scale}
    args: dict = {}

    def one(m: re.Match) -> str:
        name = m[1]
        if name in ("bbox", "bbox_unbuffered"):
            for k, b in zip(("xmin", "ymin", "xmax", "ymax"), wide, strict=True):
                args[f"bbox_{k}"] = float(b)
            return ", ".join(f":bbox_{k}" for k in ("xmin", "ymin", "xmax", "ymax"))
        if name not in values:
            raise MissingFilter(name)
        args[name] = values[name]
        return f":{name}"

    return Bound(_VAR.sub(one, sql), args, True)


def placed(spark: SparkSession, sql: str, addresses: DataFrame, grid: Grid, layer: Layer) -> DataFrame:
    """_z, _x, _y and the rows of a template that places itself, for all addresses (z, x, y, bounds in the grid's units) in one lateral join."""
    level = {v.z: v for v in grid.levels}
    first = min(level)
    named = lambda value: "element_at(array(" + ", ".join(repr(value(level[z])) + "D" if z in level else "NULL" for z in range(first, max(level) + 1)) + f"), t.z - {first - 1})"
    width = named(lambda v: float(v.cell * v.tile_width / layer.tile_size))
    pad = f"{float(layer.buffer or 0)}D * {width}"
    if layer.srid != grid.srid:
        raise ValueError(f"{layer.name}: a template with x and y needs a layer in the grid's frame")
    of = {
        "x": "t.x", "y": "t.y", "z": "t.z", "zoom": "t.z", "pixel_width": width, "scale_denominator": named(lambda v: float(v.scale)),
        "bbox": f"t.xmin - {pad}, t.ymin - {pad}, t.xmax + {pad}, t.ymax + {pad}", "bbox_unbuffered": "t.xmin, t.ymin, t.xmax, t.ymax",
    }

    def one(m: re.Match) -> str:
        if m[1] not in of:
            raise MissingFilter(m[1])
        return of[m[1]]

    own = _VAR.sub(one, sql).replace("{", "{{").replace("}", "}}")
    return spark.sql(f"SELECT t.z AS _z, t.x AS _x, t.y AS _y, q.* FROM {{addresses}} AS t, LATERAL ({own}) AS q", addresses=addresses)


def layer_rows(spark: SparkSession, layer: Layer, grid: Grid, z: int, x: int, y: int, filters: dict | None = None) -> DataFrame:
    """Rows of a layer for one tile; a box test is added unless the template places itself."""
    b = bind(source_sql(layer, z), grid, layer, z, x, y, filters)
    df = spark.sql(b.sql, args=b.args)
    if b.spatial:
        width = grid.pixel_width(z, layer.tile_size)
        g = grid.bounds(z, x, y)
        pad = width * (layer.buffer or 0)
        box = transform_box((g[0] - pad, g[1] - pad, g[2] + pad, g[3] + pad), grid.srid, layer.srid, width)
        sides = layer.envelope or (layer.x, layer.y, layer.x, layer.y)
        xs = [shifted(F.col(c)) if layer.shift_longitude else F.col(c) for c in (sides[0], sides[2])]
        df = df.where((xs[0] <= box[2]) & (xs[1] >= box[0]) & (F.col(sides[1]) <= box[3]) & (F.col(sides[3]) >= box[1]))
    if not layer.limit:
        return df
    # The first by id, as in seeding.
    return (df.orderBy(layer.fid) if layer.fid else df).limit(layer.limit)


_PROPERTIES = (t.StringType, t.CharType, t.VarcharType, t.FloatType, t.DoubleType, t.ShortType, t.IntegerType, t.LongType, t.BooleanType, t.ByteType)


def property_columns(df: DataFrame, layer: Layer) -> list:
    """Columns that a tile can hold: decimals as doubles, others of unfit types left out."""
    out = []
    skip = {layer.geometry, layer.fid, layer.x, layer.y, *(layer.envelope or ())}
    for f in df.schema:
        if f.name in skip:
            continue
        if isinstance(f.dataType, t.DecimalType):
            out.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        elif isinstance(f.dataType, _PROPERTIES):
            out.append(F.col(f"`{f.name}`"))
    return out


def field_types(layer: Layer, spark: SparkSession, grid: Grid) -> dict[str, str]:
    """Name and kind of the fields over all queries, without the feature id."""
    kinds = {t.StringType: "String", t.BooleanType: "Boolean"}
    out: dict[str, str] = {}
    zooms = sorted({q.minzoom for q in layer.queries} | {layer.minzoom or 0})
    for z in zooms:
        sql = source_sql(layer, z)
        names = {v: "" for v in _VAR.findall(sql) if v not in VARIABLES}
        b = bind(sql, grid, layer, z, 0, 0, names)
        df = spark.sql(b.sql, args=b.args)
        for c in df.select(*property_columns(df, layer)).schema:
            out[c.name] = kinds.get(type(c.dataType), "Number")
    return out
