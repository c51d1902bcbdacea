"""Geometry operations that SQL expressions can't give: clip, simplify, snap, repair, quantise."""

from __future__ import annotations

import numpy as np

from geoloom.functions.wkb import Geometry

Box = tuple[float, float, float, float]


def segmentized(line, step: float):
    """The line with points no further apart than step."""
    out = [line[0]] if line else []
    for a, b in zip(line, line[1:], strict=False):
        n = max(1, int(np.ceil(np.hypot(b[0] - a[0], b[1] - a[1]) / step)))
        out += [(a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n) for k in range(1, n)] + [b]
    return out


def clip_line(line, box: Box) -> list[list]:
    """Pieces of a line inside a box, by parameters along each segment."""
    x0, y0, x1, y1 = box
    out: list[list] = []
    for a, b in zip(line, line[1:], strict=False):
        dx, dy = b[0] - a[0], b[1] - a[1]
        lo, hi = 0.0, 1.0
        for d, q0, q1 in ((dx, x0 - a[0], x1 - a[0]), (dy, y0 - a[1], y1 - a[1])):
            if d == 0:
                if q0 > 0 or q1 < 0:
                    lo, hi = 1.0, 0.0
            else:
                t0, t1 = sorted((q0 / d, q1 / d))
                lo, hi = max(lo, t0), min(hi, t1)
        if lo > hi:
            continue
        p = a if lo == 0 else (a[0] + lo * dx, a[1] + lo * dy)
        q = b if hi == 1 else (a[0] + hi * dx, a[1] + hi * dy)
        if out and out[-1][-1] == p:
            out[-1].append(q)
        else:
            out.append([p, q])
    return [x for x in out if len(x) > 1 and any(p != x[0] for p in x)]


def clip_ring(ring, box: Box) -> list:
    """A closed ring cut to a box, side by side; empty if nothing is left."""
    pts = list(ring[:-1]) if ring and ring[0] == ring[-1] else list(ring)
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for i, p in enumerate(pts):
            q = pts[i - 1]
            pin, qin = sign * (p[axis] - limit) >= 0, sign * (q[axis] - limit) >= 0
            if pin != qin:
                t = (limit - q[axis]) / (p[axis] - q[axis])
                c = [q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])]
                c[axis] = limit
                out.append(tuple(c))
            if pin:
                out.append(p)
        pts = out
        if not pts:
            return []
    pts = [p for i, p in enumerate(pts) if p != pts[i - 1]]
    return [*pts, pts[0]] if len(pts) >= 3 and area([*pts, pts[0]]) else []


def area(ring) -> float:
    """Signed area of a closed ring; positive counterclockwise where y points up."""
    p = np.asarray(ring, float)
    p = p - p[0]
    return float(np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]) / 2)


def clip(g: Geometry | None, box: Box) -> Geometry | None:
    """The geometry inside a box, as a multi one; None if nothing is left."""
    if g is None:
        return None
    kind, c = g
    inside = lambda p: p is not None and box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3]
    if kind in ("Point", "MultiPoint"):
        out = [p for p in ([c] if kind == "Point" else c) if inside(p)]
        return ("MultiPoint", out) if out else None
    if kind in ("LineString", "MultiLineString"):
        out = [x for l in ([c] if kind == "LineString" else c) for x in clip_line(l, box)]
        return ("MultiLineString", out) if out else None
    if kind in ("Polygon", "MultiPolygon"):
        out = []
        for poly in [c] if kind == "Polygon" else c:
            rings = [clip_ring(r, box) for r in poly]
            if rings and rings[0]:
                out.append([r for r in rings if r])
        return ("MultiPolygon", out) if out else None
    parts = [x for x in (clip(x, box) for x in c) if x]
    return ("GeometryCollection", parts) if parts else None


def simplify_line(line, tolerance: float) -> list:
    """Points whose loss would move the line by more than tolerance; the ends stay."""
    p = np.asarray(line, float)
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        v = p[a + 1 : b] - p[a]
        n = float(d @ d)
        t = np.clip(v @ d / n, 0, 1) if n else np.zeros(len(v))
        far = np.hypot(*(v - t[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return [line[i] for i in np.flatnonzero(keep)]


def _crosses(ring) -> bool:
    """Whether two sides of a closed ring that aren't neighbours meet."""
    p = np.asarray(ring, float)
    a, b = p[:-1], p[1:]
    n = len(a)
    side = lambda o, q, r: np.sign((q[..., 0] - o[..., 0]) * (r[..., 1] - o[..., 1]) - (q[..., 1] - o[..., 1]) * (r[..., 0] - o[..., 0]))
    for i in range(n - 2):
        j = np.arange(i + 2, n if i else n - 1)
        if not len(j):
            continue
        s1, s2 = side(a[i], b[i], a[j]), side(a[i], b[i], b[j])
        s3, s4 = side(a[j], b[j], a[i][None]), side(a[j], b[j], b[i][None])
        if ((s1 * s2 < 0) & (s3 * s4 < 0)).any():
            return True
    return False


def simplify_ring(ring, tolerance: float) -> list:
    """As a line, but a ring keeps four points at least and no sides that cross."""
    while True:
        far = max(range(len(ring)), key=lambda i: (ring[i][0] - ring[0][0]) ** 2 + (ring[i][1] - ring[0][1]) ** 2)
        out = simplify_line(ring[: far + 1], tolerance)[:-1] + simplify_line(ring[far:], tolerance) if 0 < far < len(ring) - 1 else list(ring)
        if len(out) >= 4 and not _crosses(out):
            return out
        if tolerance < 1e-12 or len(ring) <= 4:
            return list(ring)
        tolerance /= 2


def simplify(g: Geometry | None, tolerance: float) -> Geometry | None:
    if g is None or tolerance <= 0:
        return g
    kind, c = g
    if kind == "LineString":
        return kind, simplify_line(c, tolerance)
    if kind == "MultiLineString":
        return kind, [simplify_line(x, tolerance) for x in c]
    if kind == "Polygon":
        return kind, [simplify_ring(r, tolerance) for r in c]
    if kind == "MultiPolygon":
        return kind, [[simplify_ring(r, tolerance) for r in p] for p in c]
    return g


def snap_points(line, step: float) -> list:
    out = []
    for x, y in line:
        p = (round(x / step) * step, round(y / step) * step)
        if not out or out[-1] != p:
            out.append(p)
    return out


def snap(g: Geometry | None, step: float) -> Geometry:
    """Points on a grid; parts that collapse go, and nothing left is an empty multi polygon."""
    if g is None:
        return "MultiPolygon", []
    kind, c = g
    ring = lambda r: x if len(x := snap_points(r, step)) >= 4 and area(x) else []
    if kind == "Point":
        return kind, snap_points([c], step)[0]
    if kind == "MultiPoint":
        return kind, list(dict.fromkeys(p for q in c for p in snap_points([q], step)))
    if kind == "LineString":
        return kind, snap_points(c, step)
    if kind == "MultiLineString":
        return kind, [x for x in (snap_points(l, step) for l in c) if len(x) > 1]
    polys = []
    for p in [c] if kind == "Polygon" else c:
        rings = [x for x in map(ring, p) if x]
        if rings and ring(p[0]):
            polys.append(rings)
    return "MultiPolygon", polys


def make_valid(g: Geometry | None) -> Geometry:
    """Polygons by the even-odd rule: rings split at points that they touch twice, then nested anew.

    Sides that cross without a common point are first cut where they cross.
    """
    if g is None or g[0] not in ("Polygon", "MultiPolygon"):
        return "MultiPolygon", []
    loops = []
    for poly in [g[1]] if g[0] == "Polygon" else g[1]:
        for r in poly:
            loops += [x for x in _loops(_noded(r)) if len(x) >= 4 and area(x)]
    loops.sort(key=lambda r: -abs(area(r)))
    depth, shells = [], []
    for i, r in enumerate(loops):
        inside = [j for j in range(i) if _holds(loops[j], r)]
        depth.append(len(inside))
        ccw = r if area(r) > 0 else r[::-1]
        if len(inside) % 2 == 0:
            shells.append((i, [ccw]))
        else:
            parent = max((j for j in inside if depth[j] % 2 == 0), key=lambda j: depth[j], default=None)
            for j, poly in shells:
                if j == parent:
                    poly.append(ccw[::-1])
    return "MultiPolygon", [p for _, p in shells]


def _noded(ring) -> list:
    """The ring with a point wherever two of its sides cross."""
    p = [tuple(map(float, x)) for x in ring]
    cuts: dict[int, list] = {}
    for i in range(len(p) - 1):
        (ax, ay), (bx, by) = p[i], p[i + 1]
        for j in range(i + 2, len(p) - 1):
            (cx, cy), (dx, dy) = p[j], p[j + 1]
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if den == 0:
                continue
            t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
            u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
            if 0 < t < 1 and 0 < u < 1:
                at = (ax + t * (bx - ax), ay + t * (by - ay))
                cuts.setdefault(i, []).append((t, at))
                cuts.setdefault(j, []).append((u, at))
    out = []
    for i, q in enumerate(p):
        if not out or out[-1] != q:
            out.append(q)
        out += [x for _, x in sorted(cuts.get(i, []))]
    return out


def _loops(ring) -> list[list]:
    """Simple loops of a ring that may come back to its points."""
    out, trail, seen = [], [], {}
    for p in ring:
        if p in seen:
            k = seen[p]
            out.append([*trail[k:], p])
            for q in trail[k + 1 :]:
                seen.pop(q, None)
            trail = trail[: k + 1]
        else:
            seen[p] = len(trail)
            trail.append(p)
    return out


def _holds(outer, inner) -> bool:
    """Whether the middle of inner's first side lies in outer."""
    x, y = (inner[0][0] + inner[1][0]) / 2, (inner[0][1] + inner[1][1]) / 2
    odd = False
    for (ax, ay), (bx, by) in zip(outer, outer[1:], strict=False):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def quantised(g: Geometry | None, box: Box, extent: int = 4096, buffer: int | None = None) -> Geometry | None:
    """Whole tile coordinates, rows downwards; cut ``buffer`` units beyond the tile if that is given."""
    if g is None:
        return None
    w, h = box[2] - box[0], box[3] - box[1]
    if buffer is not None:
        bx, by = w * buffer / extent, h * buffer / extent
        g = clip(g, (box[0] - bx, box[1] - by, box[2] + bx, box[3] + by))
        if g is None:
            return None

    def line(pts):
        out = []
        for x, y in pts:
            p = (round((x - box[0]) / w * extent), round((box[3] - y) / h * extent))
            if not out or out[-1] != p:
                out.append(p)
        return out

    kind, c = g
    if kind in ("Point", "MultiPoint"):
        out = [p for q in ([c] if kind == "Point" else c) if q for p in line([q])]
        return ("MultiPoint", out) if out else None
    if kind in ("LineString", "MultiLineString"):
        out = [x for x in map(line, [c] if kind == "LineString" else c) if len(x) > 1]
        return ("MultiLineString", out) if out else None
    if kind in ("Polygon", "MultiPolygon"):
        polys = []
        for p in [c] if kind == "Polygon" else c:
            rings = [x for x in map(line, p) if len(x) >= 4 and area(x)]
            if rings and len(line(p[0])) >= 4 and area(line(p[0])):
                # Outer rings turn the positive way in tile space, holes the other.
                polys.append([r if (area(r) > 0) == (i == 0) else r[::-1] for i, r in enumerate(rings)])
        return ("MultiPolygon", polys) if polys else None
    return None


#: Semi-major axis and flattening of WGS 84.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563


def geodesic(lon1, lat1, lon2, lat2):
    """Metres along the ellipsoid between arrays of points, by Vincenty's inverse formula.

    Nearly antipodal pairs, for which it doesn't settle, get the great-circle length.
    """
    b = AXIS * (1 - FLATTENING)
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(np.asarray(v, float)))) for v in (lat1, lat2))
    length = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = length.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0.0)
            ca = 1 - sa**2
            cm = np.where(ca > 0, cs - 2 * s1 * s2 / ca, 0.0)
            k = FLATTENING / 16 * ca * (4 + FLATTENING * (4 - 3 * ca))
            new = length + (1 - k) * FLATTENING * sa * (sigma + k * ss * (cm + k * cs * (2 * cm**2 - 1)))
            moved = np.abs(new - lam)
            lam = new
            if (moved < 1e-12).all():
                break
        q = ca * (AXIS**2 - b**2) / b**2
        big = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
        small = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
        d = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        out = b * big * (sigma - d)
    h = np.sin((np.radians(np.asarray(lat2, float) - np.asarray(lat1, float))) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(length / 2) ** 2
    return np.where((moved < 1e-9) & np.isfinite(out), out, 2 * 6371008.8 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))


def geodesic_length(line) -> float:
    """Metres along a line of (lon, lat)."""
    if len(line) < 2:
        return 0.0
    p = np.asarray(line, float)
    return float(geodesic(p[:-1, 0], p[:-1, 1], p[1:, 0], p[1:, 1]).sum())


def length_batches(batches):
    """Arrow batches of (key, points) to (key, metres along the ellipsoid): for mapInArrow; a batch is one calculation."""
    import pyarrow as pa

    for b in batches:
        lines = b.column(1)
        offsets = lines.offsets.to_numpy()
        flat = lines.values
        x, y = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y"))
        d = geodesic(x[:-1], y[:-1], x[1:], y[1:]) if len(x) > 1 else np.zeros(0)
        total = np.r_[0.0, np.cumsum(d)]
        last = len(total) - 1
        out = [float(total[min(z - 1, last)] - total[min(a, last)]) if z - a > 1 else 0.0 for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=[b.schema.names[0], "metres"])
