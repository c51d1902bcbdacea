"""Tilesets: layers, grid, store and cache rules in one place; single tiles, seeding, documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import mvt, wkb
from geoloom.functions.projection import transform_geometry
from geoloom.operators import grids, seed
from geoloom.operators.features import FilterParams, parse_temporal
from geoloom.operators.layers import Layer, MissingFilter, bind_zoom, field_types, layer_rows, placed, property_columns, source_sql, variables
from geoloom.plans import documents
from geoloom.sources import archives, wms
from geoloom.sources.stores import Store


class TileNotFound(LookupError):
    pass


@dataclass(frozen=True)
class ArchiveOrigin:
    """Tiles of an archive or another store, as they are."""

    store: Store

    def tiles(self, spark: SparkSession, wanted: DataFrame, grid: grids.Grid) -> DataFrame:
        return self.store.read(spark).select("z", "x", "y", "data").join(wanted.select("z", "x", "y"), ["z", "x", "y"])


@dataclass(frozen=True)
class RequestOrigin:
    """Tiles of a map service: ``fetch`` gets bytes (or None) of a URL; it runs in the tasks and may try again."""

    base: str
    layers: str
    fetch: Callable[[str], bytes | None]
    size: int = 256
    form: str = "image/png"
    version: str = "1.3.0"
    extra: dict | None = None

    def tiles(self, spark: SparkSession, wanted: DataFrame, grid: grids.Grid) -> DataFrame:
        urls = wms.map_urls(wanted, self.base, self.layers, grid.srid, self.size, self.form, self.version, self.extra)
        fetch = self.fetch

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("z", "x", "y")] + [pa.array([fetch(u) for u in b.column("url").to_pylist()], pa.binary())], ["z", "x", "y", "data"])

        return urls.mapInArrow(run, "z int, x long, y long, data binary").where("data IS NOT NULL")


@dataclass
class Tileset:
    name: str
    layers: list[Layer] = field(default_factory=list)
    grid: grids.Grid = field(default_factory=grids.web_mercator)
    store: Store = field(default_factory=lambda: Store("none"))
    minzoom: int = 0
    maxzoom: int = 22
    cached: tuple[int, int] | None = None  # zooms that are stored
    ages: list[tuple[int, int | None, int]] = field(default_factory=list)
    attribution: str = ""
    diagnostics: bool = False
    bounds: tuple[float, float, float, float] = documents.WORLD
    #: Where tiles come from if not from layers: an archive, or requests to a map service.
    origin: ArchiveOrigin | RequestOrigin | None = None
    #: Grids of zoom spans (first, last or None, grid); the last that holds a zoom is used before ``grid``.
    grids: list[tuple[int, int | None, grids.Grid]] = field(default_factory=list)

    def grid_at(self, z: int) -> grids.Grid:
        fit = [g for lo, hi, g in self.grids if lo <= z and (hi is None or z <= hi)]
        return fit[-1] if fit else self.grid

    def spans(self, lo: int, hi: int) -> list[tuple[int, int, grids.Grid]]:
        """Spans of zooms with one grid."""
        out: list[tuple[int, int, grids.Grid]] = []
        for z in range(lo, hi + 1):
            g = self.grid_at(z)
            if out and out[-1][2] is g:
                out[-1] = (out[-1][0], z, g)
            else:
                out.append((z, z, g))
        return out

    def tile(self, spark: SparkSession, z: int, x: int, y: int, params: FilterParams | None = None) -> bytes:
        """One vector tile from the layers' rows; an empty tile is no bytes."""
        grid = self.grid_at(z)
        if not grid.valid(z, x, y):
            raise TileNotFound(f"{z}/{x}/{y}")
        if self.origin:
            rows = self.origin.tiles(spark, grids.one_tile(spark, grid, z, x, y), grid).collect()
            return bytes(rows[0].data) if rows and rows[0].data is not None else b""
        p = params or FilterParams()
        out, sizes = [], []
        for layer in sorted(self.layers, key=lambda l: l.name):
            if not layer.visible(z):
                continue
            rows = layer_rows(spark, layer, grid, z, x, y, p.filters)
            built = self._encode(layer, self._in_time(rows, p, layer), grid, z, x, y)
            if built.features:
                out.append(built)
                sizes.append((layer.name, len(built.features), len(built.encoded())))
        if self.diagnostics:
            out.append(diagnostics_layer(z, x, y, sizes))
        return mvt.tile(out)

    @staticmethod
    def _in_time(rows: DataFrame, p: FilterParams, layer: Layer) -> DataFrame:
        span = parse_temporal(p.datetime)
        if not span:
            return rows
        if layer.time not in rows.columns:
            raise MissingFilter(f"{layer.name} has no column {layer.time} for a datetime")
        begin, end, instant = span
        at = F.col(layer.time).cast("timestamp")
        if instant:
            return rows.where(at == F.lit(begin))
        rows = rows.where(at >= F.lit(begin)) if begin else rows
        return rows.where(at <= F.lit(end)) if end else rows

    def _tolerance(self, layer: Layer, grid: grids.Grid, z: int) -> float:
        """In the grid's units."""
        return layer.tolerance_at(z, grid.pixel_width(z, layer.tile_size)) if layer.simplified(z) else 0.0

    def _encode(self, layer: Layer, rows: DataFrame, grid: grids.Grid, z: int, x: int, y: int) -> mvt.LayerBuilder:
        """The rows of one tile come to the driver, as one Arrow table."""
        fid = F.col(layer.fid).cast("long") if layer.fid else F.lit(None).cast("long")
        properties = property_columns(rows, layer)
        if not layer.geometry:
            rows = seed.points_wkb(rows, layer.x, layer.y, "_g")
        else:
            rows = rows.where(F.col(layer.geometry).isNotNull()).withColumn("_g", F.col(layer.geometry))
        table = rows.select(fid.alias("_fid"), "_g", (F.struct(*properties) if properties else F.lit(None).cast("string")).alias("_p")).toArrow().combine_chunks()
        blobs = table["_g"].to_pylist()
        if layer.srid != grid.srid:
            blobs = [wkb.encode(transform_geometry(seed._geometry(b), layer.srid, grid.srid)) for b in blobs]
        props = pa.concat_arrays(table["_p"].chunks) if properties and table["_p"].num_chunks else None
        return seed.encode_layer(layer.name, 4096, z, grid.bounds(z, x, y), blobs, props, table["_fid"].to_pylist(), layer.buffer, self._tolerance(layer, grid, z), layer.make_valid)

    def tile_cached(self, spark: SparkSession, z: int, x: int, y: int, params: FilterParams | None = None, put: Callable[[bytes], None] | None = None) -> bytes:
        """From the store; made, and given to ``put``, where it isn't there.

        Requests with filters go past the store, which knows only addresses.
        """
        plain = not params or not (params.filters or params.datetime)
        held = plain and self.store.kind != "none" and (self.cached is None or self.cached[0] <= z <= self.cached[1])
        if held:
            found = archives.tile_at(self.store.read(spark), z, x, y)
            if found is not None:
                return found
        made = self.tile(spark, z, x, y, params)
        if held and put:
            put(made)
        return made

    def max_age(self, z: int) -> int | None:
        return grids.cache_age(self.ages, z)

    def sources(self, spark: SparkSession, lo: int, hi: int, grid: grids.Grid | None = None, extent=None) -> list[seed.Source]:
        """Each layer's query at each of its zoom spans as a seeding source.

        A query without variables is one source for its span; one with variables of the zoom or a
        box is a source for each zoom; one that places itself by x and y is joined to the addresses.
        """
        grid = grid or self.grid
        out = []
        for l in self.layers:
            low, high = max(lo, l.minzoom or 0, grid.minzoom), min(hi, grid.maxzoom, l.maxzoom if l.maxzoom is not None else hi)
            z = low
            while z <= high:
                sql = source_sql(l, z)
                used = variables(sql)
                last = z
                while not used and last < high and source_sql(l, last + 1) == sql:
                    last += 1
                if l.visible(z):
                    if {"x", "y"} <= used:
                        out.append(self._placed(spark, sql, l, grid, z, extent))
                    else:
                        b = bind_zoom(sql, grid, l, z, extent)
                        out.append(self._source(spark.sql(b.sql, args=b.args), l, grid, z, last))
                z = last + 1
        return out

    def _source(self, df: DataFrame, l: Layer, grid: grids.Grid, lo: int, hi: int, skip: tuple[str, ...] = ()) -> seed.Source:
        names = tuple(c.name for c in df.select(*property_columns(df, l)).schema if c.name not in skip)
        frame = seed.with_envelope(df, l.geometry) if l.geometry else seed.points_wkb(df, l.x, l.y, "_geom")
        tolerances = {z: self._tolerance(l, grid, z) for z in range(lo, hi + 1)}
        return seed.Source(l.name, frame, l.geometry or "_geom", fid=l.fid, properties=names, minzoom=lo, maxzoom=hi, buffer=l.buffer or 0, make_valid=l.make_valid, limit=l.limit or 0, tolerances=tolerances, srid=l.srid)

    def _placed(self, spark: SparkSession, sql: str, l: Layer, grid: grids.Grid, z: int, extent) -> seed.Source:
        """A template with x and y may give a feature to one tile only; its rows keep their tile."""
        rows = placed(spark, sql, grids.tiles(spark, grid, z, z, extent), grid, l)
        return replace(self._source(rows, l, grid, z, z, ("_z", "_x", "_y")), address=("_z", "_x", "_y"))

    def made(self, spark: SparkSession, lo: int, hi: int, extent=None, known: DataFrame | None = None) -> DataFrame:
        """z, x, y, data, features of all tiles of the zooms that hold something and aren't known."""
        out = None
        for a, z, grid in self.spans(lo, hi):
            if self.origin:
                wanted = grids.tiles(spark, grid, a, min(z, grid.maxzoom), extent)
                wanted = wanted if known is None else wanted.join(known, ["z", "x", "y"], "left_anti")
                part = self.origin.tiles(spark, wanted, grid).where("length(data) > 0").withColumn("features", F.lit(None).cast("long"))
            else:
                found = self.sources(spark, a, z, grid, extent)
                if not found:
                    continue
                part = seed.seed(found, a, z, extent, grid, known)
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no layer is visible in these zooms")
        return out

    def seed(self, spark: SparkSession, minzoom: int | None = None, maxzoom: int | None = None, extent=None, overwrite: bool = True) -> DataFrame:
        """Make and store all tiles of the zooms; extent is in the grid's units.  Returns the stored tiles, or the made ones where there is no store."""
        lo, hi = self.minzoom if minzoom is None else minzoom, self.maxzoom if maxzoom is None else maxzoom
        stored = self.store.kind != "none"
        known = self.store.read(spark).select("z", "x", "y") if stored and not overwrite else None
        tiles = self.made(spark, lo, hi, extent, known)
        if not stored:
            return tiles
        self.store.write(tiles.select("z", "x", "y", "data"))
        return self.store.read(spark)

    def tilejson(self, spark: SparkSession, url: str) -> dict:
        fields = {l.name: field_types(l, spark, self.grid) for l in self.layers}
        return documents.tilejson(self.name, self.layers, fields, url, self.minzoom, self.maxzoom, self.bounds, attribution=self.attribution)

    def stylejson(self, url: str) -> dict:
        return documents.style(self.name, self.layers, url)

    def metadata(self, spark: SparkSession) -> dict:
        layers = [{"id": l.name, "fields": field_types(l, spark, self.grid)} for l in self.layers]
        return archives.metadata(self.name, attribution=self.attribution, bounds=self.bounds, minzoom=self.minzoom, maxzoom=self.maxzoom, layers=layers)


def diagnostics_layer(z: int, x: int, y: int, sizes: list[tuple[str, int, int]], reference: int = 1_000_000, most: int = 5) -> mvt.LayerBuilder:
    """The tile's frame and a label with its address, bytes and largest layers."""
    out = mvt.LayerBuilder("diagnostics", 4096)
    total = sum(s for *_, s in sizes)
    props = {"zxy": f"{z}/{x}/{y}", "bytes": total, "percent": round(100.0 * total / reference, 2)}
    for k, (name, features, size) in enumerate(sorted(sizes, key=lambda s: (-s[2], s[0]))[:most], 1):
        props |= {f"layer{k}": name, f"layer{k}_features": features, f"layer{k}_bytes": size}
    out.add(("MultiPolygon", [[[(0, 0), (4096, 0), (4096, 4096), (0, 4096), (0, 0)]]]), props)
    out.add(("MultiPoint", [(2048, 2048)]), props)
    return out
