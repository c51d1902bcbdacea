"""Projections in closed form: geographic, Web Mercator and the Swiss frame."""

from __future__ import annotations

import numpy as np

HALF = 20037508.342789244
RADIUS = 6378137.0
KNOWN = (4326, 3857, 2056)


class UnknownProjection(ValueError):
    pass


def _to_swiss(lon, lat):
    """Approximation formulas of the Swiss survey (about a metre)."""
    b, l = (lat * 3600 - 169028.66) / 10000, (lon * 3600 - 26782.5) / 10000
    e = 2600072.37 + 211455.93 * l - 10938.51 * l * b - 0.36 * l * b**2 - 44.54 * l**3
    n = 1200147.07 + 308807.95 * b + 3745.25 * l**2 + 76.63 * b**2 - 194.56 * l**2 * b + 119.79 * b**3
    return e, n


def _from_swiss(e, n):
    y, x = (e - 2600000) / 1e6, (n - 1200000) / 1e6
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x**2 - 0.0436 * y**3
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y**2 - 0.002528 * x**2 - 0.0447 * y**2 * x - 0.0140 * x**3
    return lon * 100 / 36, lat * 100 / 36


def transform(x, y, source: int, target: int):
    """Arrays of coordinates from one frame to another."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    for s in (source, target):
        if s not in KNOWN:
            raise UnknownProjection(f"EPSG:{s}")
    if source == target:
        return x, y
    if source == 3857:
        x, y = x * 180 / HALF, np.degrees(2 * np.arctan(np.exp(y / RADIUS))) - 90
    elif source == 2056:
        x, y = _from_swiss(x, y)
    if target == 3857:
        lat = np.clip(y, -89.99999, 89.99999)
        return x * HALF / 180, np.log(np.tan(np.radians(lat + 90) / 2)) * RADIUS
    return _to_swiss(x, y) if target == 2056 else (x, y)


def transform_geometry(g, source: int, target: int):
    """A (kind, coordinates) geometry in another frame; all its points at once."""
    if g is None or source == target or g[1] is None:
        return g
    kind, c = g
    if kind == "GeometryCollection":
        return kind, [transform_geometry(part, source, target) for part in c]
    points: list = []

    def gather(v) -> None:
        if isinstance(v, tuple):
            points.append(v)
        else:
            for part in v:
                gather(part)

    gather(c)
    if not points:
        return g
    xs, ys = transform([p[0] for p in points], [p[1] for p in points], source, target)
    moved = iter(zip(xs.tolist(), ys.tolist(), strict=True))

    def rebuilt(v):
        return next(moved) if isinstance(v, tuple) else [rebuilt(part) for part in v]

    return kind, rebuilt(c)


def dense_ring(box, step: float, most: int = 10_000):
    """Points along a box's sides, no further apart than step."""
    x0, y0, x1, y1 = box
    nx = int(np.clip(np.ceil((x1 - x0) / step), 1, most)) if step > 0 else 1
    ny = int(np.clip(np.ceil((y1 - y0) / step), 1, most)) if step > 0 else 1
    xs, ys = np.linspace(x0, x1, nx + 1), np.linspace(y0, y1, ny + 1)
    x = np.concatenate([xs, np.full(ny + 1, x1), xs[::-1], np.full(ny + 1, x0)])
    y = np.concatenate([np.full(nx + 1, y0), ys, np.full(nx + 1, y1), ys[::-1]])
    return x, y


def transform_box(box, source: int, target: int, step: float) -> tuple[float, float, float, float]:
    """Envelope of a box's dense ring in another frame."""
    if source == target or target <= 0:
        return tuple(map(float, box))
    x, y = transform(*dense_ring(box, step), source, target)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())
