"""Seeding: vector tiles of all zooms of a grid from one scan a layer.

Geometries are brought to the grid's frame first.  Each feature's envelope is exploded to the
tiles of all zooms that it touches, features meet by tile in one shuffle, and an Arrow function
encodes them.  A feature that touches many tiles at a zoom is first cut to the tiles of a coarser
level, so that what travels to a tile is no larger than what lies near it.  Tiles are encoded in
two steps: parts of at most ``PART`` features of a layer, then the tile of its parts, so a crowded
tile of a low zoom is no single group of all features.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import lines as L
from geoloom.functions import mvt, wkb
from geoloom.functions.projection import transform, transform_geometry
from geoloom.operators.grids import Grid, by_level, cover, web_mercator
from geoloom.operators.tiles import first_features

PART = 5000
#: Tiles of a feature at one zoom beyond which it is cut to parents first.
WIDE = 256


@dataclass(frozen=True)
class Source:
    """Features of one layer: WKB geometry in a frame, envelope columns in the same, properties."""

    name: str
    frame: DataFrame
    geometry: str = "geom"
    envelope: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax")
    fid: str | None = None
    properties: tuple[str, ...] = ()
    minzoom: int = 0
    maxzoom: int = 24
    buffer: int = 64
    extent: int = 4096
    tolerance: float | None = None  # in tile units
    tolerances: dict | None = None  # by zoom, in the grid's units; before tolerance
    srid: int = 3857
    address: tuple[str, str, str] | None = None  # columns of z, x, y, where rows are placed already
    make_valid: bool = False
    limit: int = 0
    options: dict = field(default_factory=dict)


def with_envelope(df: DataFrame, geometry: str = "geom") -> DataFrame:
    """Envelope columns of a WKB column."""
    names = [c for c in df.columns if c != geometry]

    def run(batches):
        for b in batches:
            blobs = b.column("g").to_pylist()
            lines = L.decoded(blobs)
            if lines is not None and (np.diff(lines[0]) > 0).all():
                sides = [pa.array(v) for v in L.envelopes(*lines)]
            else:
                boxes = [wkb.envelope(wkb.decode_gpkg(x)[0]) if x is not None else None for x in blobs]
                sides = [pa.array([x[k] if x else None for x in boxes], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("g"), *sides], ["r", "g", "xmin", "ymin", "xmax", "ymax"])

    rows = df.select(F.struct(*names).alias("r") if names else F.struct(F.lit(1).alias("_one")).alias("r"), F.col(geometry).alias("g"))
    kind = rows.schema["r"].dataType.simpleString()
    out = rows.mapInArrow(run, f"r {kind}, g binary, xmin double, ymin double, xmax double, ymax double")
    return out.select("r.*", F.col("g").alias(geometry), "xmin", "ymin", "xmax", "ymax") if names else out.select(F.col("g").alias(geometry), "xmin", "ymin", "xmax", "ymax")


def _points(blobs: list) -> tuple[np.ndarray, np.ndarray] | None:
    """Coordinates, if all blobs are plain points."""
    if not blobs or any(len(x) != 21 for x in blobs):
        return None
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 21)
    if not (raw[:, :5] == np.array([1, 1, 0, 0, 0], np.uint8)).all():
        return None
    at = np.ascontiguousarray(raw[:, 5:]).view("<f8")
    return (at[:, 0], at[:, 1]) if np.isfinite(at).all() else None


def _point_blobs(x: np.ndarray, y: np.ndarray) -> pa.Array:
    raw = np.zeros((len(x), 21), np.uint8)
    raw[:, 0], raw[:, 1] = 1, 1
    raw[:, 5:13] = np.ascontiguousarray(x, "<f8").view(np.uint8).reshape(-1, 8)
    raw[:, 13:] = np.ascontiguousarray(y, "<f8").view(np.uint8).reshape(-1, 8)
    offsets = (np.arange(len(x) + 1) * 21).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _geometry(blob: bytes) -> wkb.Geometry:
    return wkb.decode_gpkg(blob)[0] if blob[:2] == b"GP" else wkb.decode(blob)


def reprojected(s: Source, srid: int) -> Source:
    """The source with its geometry and envelopes in another frame."""
    if s.srid == srid:
        return s
    names, source = [c for c in s.frame.columns if c not in (s.geometry, *s.envelope)], s.srid

    def run(batches):
        for b in batches:
            blobs = b.column("g").to_pylist()
            at = _points(blobs)
            if at is not None:
                x, y = transform(*at, source, srid)
                yield pa.RecordBatch.from_arrays([b.column("r"), _point_blobs(x, y), *[pa.array(v) for v in (x, y, x, y)]], ["r", "g", "xmin", "ymin", "xmax", "ymax"])
                continue
            shapes = [transform_geometry(_geometry(x), source, srid) for x in blobs]
            boxes = [wkb.envelope(g) for g in shapes]
            sides = [pa.array([x[k] if x else None for x in boxes], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("r"), pa.array([wkb.encode(g) for g in shapes], pa.binary()), *sides], ["r", "g", "xmin", "ymin", "xmax", "ymax"])

    held = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(1).alias("_one"))
    rows = s.frame.where(F.col(s.geometry).isNotNull()).select(held.alias("r"), F.col(s.geometry).alias("g"))
    kind = rows.schema["r"].dataType.simpleString()
    out = rows.mapInArrow(run, f"r {kind}, g binary, xmin double, ymin double, xmax double, ymax double")
    frame = out.select(*[F.col(f"r.`{c}`").alias(c) for c in names], F.col("g").alias(s.geometry), *[F.col(a).alias(b) for a, b in zip(("xmin", "ymin", "xmax", "ymax"), s.envelope, strict=True)])
    return replace(s, frame=frame, srid=srid)


def prepared(g: wkb.Geometry, tolerance: float, make_valid: bool) -> wkb.Geometry:
    """Repaired and simplified by a tolerance in the geometry's units: polygons by snapping, others by leaving out points."""
    polygon = g[0] in ("Polygon", "MultiPolygon")
    if make_valid and polygon:
        g = G.make_valid(g)
    if tolerance and g is not None:
        g = G.snap(g, tolerance) if polygon else G.simplify(g, tolerance)
    return g


def _cut(grid: Grid, share: float):
    """Pieces of features at the coarser tiles that they touch; a little wider than these, for the tiles on their sides."""

    def run(batches):
        for b in batches:
            out = []
            for z, x, y, to, g in zip(*(b.column(c).to_pylist() for c in ("z", "x", "y", "to", "g")), strict=True):
                box, v = grid.bounds(z, x, y), grid.level(to)
                px, py = v.cell * v.tile_width * (1 + share), v.cell * v.tile_height * (1 + share)
                piece = G.clip(_geometry(g), (box[0] - px, box[1] - py, box[2] + px, box[3] + py))
                out.append((wkb.encode(piece), *wkb.envelope(piece)) if piece else (None,) * 5)
            sides = [pa.array([o[k] for o in out], pa.float64()) for k in range(1, 5)]
            names = ["z", "x", "y", "to", "id", "p"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array([o[0] for o in out], pa.binary()), *sides], [*[f"c{c}" if c in "zxy" else c for c in names], "g", "xmin", "ymin", "xmax", "ymax"])

    return run


def _flipped(g: wkb.Geometry) -> wkb.Geometry:
    """With rows counted upwards."""

    def turn(v):
        return (v[0], -v[1]) if isinstance(v, tuple) else [turn(x) for x in v]

    return g[0], turn(g[1])


def encode_layer(name: str, extent: int, z: int, box: G.Box, blobs: list, properties: pa.StructArray | None, fids: list, buffer: int | None, tolerance: float = 0.0, make_valid: bool = False, repair: bool = False, scaled: bool = True) -> mvt.LayerBuilder:
    """Features (WKB in the grid's units) of one tile and layer.

    With ``repair`` polygons are cut first and made valid after; without ``scaled`` geometries
    are in the tile's own coordinates, rows downwards, and are written as they are.
    """
    layer = mvt.LayerBuilder(name, extent)
    if not scaled:
        box, buffer = (0.0, -float(extent), float(extent), 0.0), None
        blobs = [wkb.encode(_flipped(_geometry(b))) for b in blobs]
    at = _points(blobs)
    columns = {f.name: properties.field(i) for i, f in enumerate(properties.type)} if properties is not None else {}
    if at is not None:
        w, h = box[2] - box[0], box[3] - box[1]
        x, y = at
        go = np.ones(len(x), bool)
        if buffer is not None:
            bx, by = w * buffer / extent, h * buffer / extent
            go = (x >= box[0] - bx) & (x <= box[2] + bx) & (y >= box[1] - by) & (y <= box[3] + by)
        px, py = np.rint((x - box[0]) / w * extent).astype(np.int64)[go], np.rint((box[3] - y) / h * extent).astype(np.int64)[go]
        mask = pa.array(go)
        layer.add_points(px.tolist(), py.tolist(), {k: c.filter(mask) for k, c in columns.items()}, [f for f, g in zip(fids, go.tolist(), strict=True) if g])
        return layer
    rows = properties.to_pylist() if properties is not None else [None] * len(blobs)
    lines = L.decoded(blobs)
    if lines is not None and (np.diff(lines[0]) > 0).all():
        if tolerance > 0:
            lines = L.simplified(*lines, tolerance)
        for packed, props, fid in zip(L.commands(*lines, box, extent, buffer), rows, fids, strict=True):
            if packed:
                layer.add_packed(mvt.LINE, packed, props or {}, fid)
        return layer
    for blob, props, fid in zip(blobs, rows, fids, strict=True):
        g = prepared(_geometry(blob), tolerance, make_valid)
        if repair and buffer is not None and g is not None and g[0] in ("Polygon", "MultiPolygon"):
            bx, by = (box[2] - box[0]) * buffer / extent, (box[3] - box[1]) * buffer / extent
            g = G.clip(g, (box[0] - bx, box[1] - by, box[2] + bx, box[3] + by))
            g = G.make_valid(g) if g is not None else None
        layer.add(G.quantised(g, box, extent, buffer), props or {}, fid)
    return layer


def _coarser(grid: Grid, z: int) -> int | None:
    """The finest level whose tiles are about eight times as wide."""
    wide = grid.level(z).cell * grid.level(z).tile_width * 7.9
    return max((v.z for v in grid.levels if v.z < z and v.cell * v.tile_width >= wide), default=None)


def layer_features(s: Source, zooms: list[int], grid: Grid) -> DataFrame:
    """z, x, y, id, p (properties), g (WKB) of each tile and feature at the zooms."""
    props = F.struct(*[F.col(f"`{c}`").cast("double").alias(c) if t.startswith("decimal") else F.col(f"`{c}`") for c, t in s.frame.dtypes if c in s.properties]) if s.properties else F.struct(F.lit(None).cast("string").alias("_"))
    fid = F.col(s.fid).cast("long") if s.fid else F.lit(None).cast("long")
    base = s.frame.where(F.col(s.geometry).isNotNull()).select(fid.alias("id"), props.alias("p"), F.col(s.geometry).alias("g"), *[F.col(c).alias(n) for c, n in zip(s.envelope, ("xmin", "ymin", "xmax", "ymax"), strict=True)])
    if s.address:
        z, x, y = (F.col(c) for c in s.address)
        rows = s.frame.where(F.col(s.geometry).isNotNull() & z.isin(zooms)).select(z.cast("int").alias("z"), x.cast("long").alias("x"), y.cast("long").alias("y"), fid.alias("id"), props.alias("p"), F.col(s.geometry).alias("g"))
        return first_features(rows, ["z", "x", "y"], s.limit, "id")
    base = base.withColumn("to", F.explode(F.array(*[F.lit(z) for z in zooms])))
    share = s.buffer / s.extent
    to = F.col("to")
    w, h = by_level(grid, to, lambda v: float(v.cell * v.tile_width)), by_level(grid, to, lambda v: float(v.cell * v.tile_height))
    coarse = {z: _coarser(grid, z) for z in zooms}
    many = ((F.col("xmax") - F.col("xmin")) / w + 1) * ((F.col("ymax") - F.col("ymin")) / h + 1) > WIDE
    above = by_level(grid, to, lambda v: coarse.get(v.z))
    keep = ("to", "id", "p", "g")
    if all(c is None for c in coarse.values()):
        out = cover(base, to, buffer=share, keep=keep, grid=grid)
    else:
        many = F.coalesce(many, F.lit(False)) & above.isNotNull()
        kind = base.schema["p"].dataType.simpleString()
        wide = cover(base.where(many), above, buffer=share, keep=keep, grid=grid)
        pieces = wide.mapInArrow(_cut(grid, share), f"cz int, cx long, cy long, to int, id long, p {kind}, g binary, xmin double, ymin double, xmax double, ymax double").where("g IS NOT NULL")
        pieces = cover(pieces, to, buffer=share, keep=(*keep, "cz", "cx", "cy"), grid=grid)
        # A tile takes the piece of the coarser tile that holds its middle.
        of = lambda z, value: by_level(grid, F.col(z), value)

        def within(place: str, start: str, size: str, count: str, sign: int):
            middle = of("z", lambda v: float(getattr(v, start))) + sign * (F.col(place) + 0.5) * of("z", lambda v: float(v.cell * getattr(v, size)))
            at = F.floor(sign * (middle - of("cz", lambda v: float(getattr(v, start)))) / of("cz", lambda v: float(v.cell * getattr(v, size))))
            return F.greatest(F.lit(0), F.least(at, of("cz", lambda v: getattr(v, count) - 1))) == F.col(f"c{place}")

        pieces = pieces.where(within("x", "left", "tile_width", "columns", 1) & within("y", "top", "tile_height", "rows", -1)).drop("cz", "cx", "cy")
        out = cover(base.where(~many), to, buffer=share, keep=keep, grid=grid).unionByName(pieces)
    return first_features(out.drop("to"), ["z", "x", "y"], s.limit, "id")


def layer_parts(s: Source, zooms: list[int], grid: Grid, known: DataFrame | None = None) -> DataFrame:
    """z, x, y, name, part, layer (encoded), features; not of the known tiles."""
    rows = layer_features(s, zooms, grid)
    if known is not None:
        rows = rows.join(known, ["z", "x", "y"], "left_anti")
    counted = rows.withColumn("part", F.pmod(F.xxhash64("id", "g"), F.lit(1 << 20)))
    sizes = counted.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    # A tile of all features is no key of a shuffle; crowded tiles are few.
    counted = counted.join(F.broadcast(sizes), ["z", "x", "y"], "left").withColumn("part", F.when(F.col("n").isNotNull(), F.pmod("part", F.ceil(F.col("n") / PART))).otherwise(0).cast("long")).drop("n")
    kind = "z int, x long, y long, part long, layer binary, features long"
    name, extent, buffer, make_valid, has = s.name, s.extent, s.buffer, s.make_valid, bool(s.properties)
    tolerances = {z: (s.tolerances or {}).get(z, (s.tolerance or 0.0) * grid.level(z).cell * grid.level(z).tile_width / s.extent) for z in zooms}

    def encode(table: pa.Table) -> pa.Table:
        z, x, y, part = (table[c][0].as_py() for c in ("z", "x", "y", "part"))
        table = table.combine_chunks()
        props = pa.concat_arrays(table["p"].chunks) if has else None
        layer = encode_layer(name, extent, z, grid.bounds(z, x, y), table["g"].to_pylist(), props, table["id"].to_pylist(), buffer, tolerances[z], make_valid)
        rows = [(z, x, y, part, layer.encoded(), len(layer.features))] if layer.features else []
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["z", "x", "y", "part", "layer", "features"])

    return counted.groupBy("z", "x", "y", "part").applyInArrow(encode, kind).select("z", "x", "y", F.lit(s.name).alias("name"), "part", "layer", "features")


def _joined(table: pa.Table) -> pa.Table:
    """A tile of its layers' parts; parts of one layer are merged under one dictionary."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["name"], r["part"]))
    layers: dict[str, list[bytes]] = {}
    for r in rows:
        layers.setdefault(r["name"], []).append(r["layer"])
    # Layers of one part first, as they are.
    single = [v[0] for v in layers.values() if len(v) == 1]
    out = b"".join(mvt._field(3, v) for v in [*single, *(mvt.merged(v) for v in layers.values() if len(v) > 1)])
    z, x, y = rows[0]["z"], rows[0]["x"], rows[0]["y"]
    return pa.table({"z": pa.array([z], pa.int32()), "x": pa.array([x], pa.int64()), "y": pa.array([y], pa.int64()), "data": pa.array([out], pa.binary()), "features": pa.array([sum(r["features"] for r in rows)], pa.int64())})


def seed(sources: list[Source], minzoom: int, maxzoom: int, extent: tuple[float, float, float, float] | None = None, grid: Grid | None = None, known: DataFrame | None = None) -> DataFrame:
    """z, x, y, data (vector tile), features of all tiles of a grid (Web Mercator) that hold something.

    extent is in the grid's units; tiles with an address (z, x, y) in known are left out before anything is made.
    """
    grid = grid or web_mercator()
    parts = None
    for s in sources:
        zooms = [v.z for v in grid.levels if max(minzoom, s.minzoom) <= v.z <= min(maxzoom, s.maxzoom)]
        if not zooms:
            continue
        s = reprojected(s, grid.srid)
        if extent:
            x0, y0, x1, y1 = s.envelope
            s = replace(s, frame=s.frame.where((F.col(x0) <= extent[2]) & (F.col(x1) >= extent[0]) & (F.col(y0) <= extent[3]) & (F.col(y1) >= extent[1])))
        p = layer_parts(s, zooms, grid, known)
        parts = p if parts is None else parts.unionByName(p)
    if parts is None:
        raise ValueError("no layer is visible in these zooms")
    return parts.groupBy("z", "x", "y").applyInArrow(_joined, "z int, x long, y long, data binary, features long")


def points_wkb(df: DataFrame, x: str, y: str, name: str = "geom") -> DataFrame:
    """A WKB point column and envelope columns of coordinate columns; a whole batch at a time."""
    names = df.columns

    def run(batches):
        for b in batches:
            blob = _point_blobs(*[b.column(c).to_numpy(zero_copy_only=False) for c in ("px", "py")])
            yield pa.RecordBatch.from_arrays([b.column("r"), blob], ["r", "g"])

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.struct(*names).alias("r"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    kind = rows.schema["r"].dataType.simpleString()
    out = rows.mapInArrow(run, f"r {kind}, g binary").select("r.*", F.col("g").alias(name))
    return out.withColumns({"xmin": F.col(x), "ymin": F.col(y), "xmax": F.col(x), "ymax": F.col(y)})


def lines_wkb(df: DataFrame, points: str, name: str = "geom") -> DataFrame:
    """A WKB line column of an array of (x, y)."""
    names = df.columns

    def run(batches):
        for b in batches:
            v = b.column("v")
            flat, n = v.flatten(), pc.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if flat.null_count or any(flat.field(c).null_count for c in ("x", "y")):
                raise ValueError("a point of a line is null")
            x, y = (flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([b.column("r"), L.encoded(np.r_[0, np.cumsum(n)], x, y)], ["r", "g"])

    rows = df.select(F.struct(*names).alias("r"), F.col(points).alias("v"))
    kind = rows.schema["r"].dataType.simpleString()
    return rows.mapInArrow(run, f"r {kind}, g binary").select("r.*", F.col("g").alias(name))


