"""Column expressions over coordinates, tiles and bytes: all stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the Web Mercator circumference, its earth radius, the mean earth radius (metres).
HALF = 20037508.342789244
MERCATOR_RADIUS = 6378137.0
MEAN_RADIUS = 6371008.8


def _left(v: Column, n) -> Column:
    return F.call_function("shiftleft", v, n if isinstance(n, Column) else F.lit(n))


def power_of_two(n: Column) -> Column:
    return _left(F.lit(1).cast("long"), n.cast("int"))


def _right(v: Column, n) -> Column:
    return F.call_function("shiftright", v, n if isinstance(n, Column) else F.lit(n))


def boxes_meet(xmin, ymin, xmax, ymax, box: tuple[float, float, float, float]) -> Column:
    """Closed overlap of envelope columns and a constant box, as range tests that reach the scan."""
    b = [F.lit(float(v)) for v in box]
    return (F.col(xmin) <= b[2]) & (F.col(xmax) >= b[0]) & (F.col(ymin) <= b[3]) & (F.col(ymax) >= b[1])


def shifted(lon: Column) -> Column:
    """Longitudes of 0..360 degrees."""
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def mercator_x(lon: Column) -> Column:
    return lon * F.lit(HALF / 180.0)


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan((lat + 90.0) * F.pi() / 360.0)) * F.lit(MERCATOR_RADIUS)


def longitude(x: Column) -> Column:
    return x * F.lit(180.0 / HALF)


def latitude(y: Column) -> Column:
    return F.atan(F.exp(y / F.lit(MERCATOR_RADIUS))) * 360.0 / F.pi() - 90.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * F.lit(MEAN_RADIUS) * F.asin(F.sqrt(a))


def line_length(points: Column) -> Column:
    """Great-circle metres along an array of (x, y) degrees."""
    steps = F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: haversine(a["x"], a["y"], b["x"], b["y"]),
    )
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def tile_width(z: Column) -> Column:
    return F.lit(2 * HALF) / F.pow(F.lit(2.0), z)


def tile_of(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Half-open tile address of a point: column, row from the top."""
    w = tile_width(z)
    return F.floor((x + HALF) / w).cast("long"), F.floor((F.lit(HALF) - y) / w).cast("long")


def tile_bounds(z: Column, x: Column, y: Column) -> list[Column]:
    w = tile_width(z)
    return [x * w - HALF, F.lit(HALF) - (y + 1) * w, (x + 1) * w - HALF, F.lit(HALF) - y * w]


def flip_row(z: Column, y: Column) -> Column:
    """Rows from the bottom for rows from the top, and back."""
    return power_of_two(z) - 1 - y


def snap(v: Column, step: float) -> Column:
    return F.round(v / F.lit(float(step))) * F.lit(float(step))


def snapped(points: Column, step: float) -> Column:
    """Points on the grid, without repeats of the one before."""
    moved = F.transform(points, lambda p: F.struct(snap(p["x"], step).alias("x"), snap(p["y"], step).alias("y")))
    return F.transform(F.array(moved), lambda a: F.filter(a, lambda p, i: (i == 0) | (F.get(a, i - 1) != p)))[0]


def hilbert(z: Column, x: Column, y: Column) -> Column:
    """Place of a tile on the Hilbert curve of its level, after all tiles of lower levels."""
    first = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def turn(s, k):
        side = power_of_two(z - 1 - k)
        rx = F.when(s["x"].bitwiseAND(side) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ry = F.when(s["y"].bitwiseAND(side) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        px = F.when((ry == 0) & (rx == 1), side - 1 - s["x"].bitwiseAND(side - 1)).otherwise(s["x"].bitwiseAND(side - 1))
        py = F.when((ry == 0) & (rx == 1), side - 1 - s["y"].bitwiseAND(side - 1)).otherwise(s["y"].bitwiseAND(side - 1))
        d = s["d"] + side * side * ((3 * rx).bitwiseXOR(ry))
        return F.struct(F.when(ry == 0, py).otherwise(px).alias("x"), F.when(ry == 0, px).otherwise(py).alias("y"), d.alias("d"))

    steps = F.when(z > 0, F.sequence(F.lit(0), z.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    below = ((power_of_two(2 * z) - 1) / 3).cast("long")
    return F.aggregate(steps, first, turn, lambda s: s["d"]) + below


def sniffed(data: Column) -> Column:
    """(format, encoding) of tile bytes by their first ones; null where unknown."""
    starts = lambda h: F.substring(F.hex(F.substring(data, 1, 12)), 1, len(h)) == h
    riff = starts("52494646") & (F.substring(F.hex(F.substring(data, 1, 12)), 17, 8) == "57454250")
    form = F.when(starts("1F8B") | starts("789C") | starts("78DA") | starts("7801"), "mvt").when(starts("89504E470D0A1A0A"), "png")
    form = form.when(starts("474946383961") | starts("474946383761"), "gif").when(starts("FFD8FF"), "jpg").when(riff, "webp").when(starts("7B"), "json")
    code = F.when(starts("1F8B"), "gzip").when(starts("789C") | starts("78DA") | starts("7801"), "deflate").when(form.isNotNull(), "none")
    return F.struct(form.alias("format"), code.alias("encoding"))


def polyline(points: Column, digits: int = 6) -> Column:
    """Encoded polyline (latitude first) of an array of (x, y)."""
    scale = F.lit(10.0**digits)
    whole = F.flatten(F.transform(points, lambda p: F.array(F.round(p["y"] * scale).cast("long"), F.round(p["x"] * scale).cast("long"))))

    def deltas(a):
        return F.transform(a, lambda v, i: v - F.coalesce(F.get(a, i - 2), F.lit(0)))

    def digits_of(v):
        u = F.when(v < 0, -2 * v - 1).otherwise(2 * v)
        fives = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: _right(u, 5 * k))
        live = F.filter(fives, lambda x, i: (i == 0) | (x > 0))
        return F.array_join(F.transform(live, lambda x, i: F.char((x.bitwiseAND(F.lit(31)) + F.when(i < F.size(live) - 1, 32).otherwise(0) + 63).cast("int"))), "")

    return F.array_join(F.transform(F.transform(F.array(whole), deltas)[0], digits_of), "")


def bucket_counts(value: str, bounds: tuple[float, ...]) -> list[Column]:
    """Aggregates of a cumulative histogram: one for each bound, and one for all."""
    return [F.sum(F.when(F.col(value) <= F.lit(float(b)), 1).otherwise(0)).alias(f"le_{b:g}") for b in bounds] + [F.count(value).alias("le_inf")]


def truncated(text: Column, length: int = 255, end: str = "...") -> Column:
    """A text cut to a length, its end marked."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, max(0, length - len(end))), F.lit(end))).otherwise(text)


def opacity_byte(share: Column) -> Column:
    """An opacity from 0 to 1 as a whole number to 255."""
    return F.round(share * 255).cast("int")


def whole_scale(scale: Column) -> Column:
    """A scale's denominator as a whole number."""
    return F.round(scale).cast("long")
