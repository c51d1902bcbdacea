"""Many lines at once: WKB, envelopes, simplifying, cutting and tile commands, as the functions of one line do them.

Lines are (offsets, x, y): line i has the points offsets[i] to offsets[i + 1].
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Head of a plain little-endian line.
HEAD = b"\x01\x02\x00\x00\x00"


def decoded(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The lines, if all blobs are plain ones of finite points."""
    if not blobs or not all(x is not None and x[:5] == HEAD and len(x) % 16 == 9 for x in blobs):
        return None
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    start = np.cumsum(size) - size
    head = start[:, None] + np.arange(9)
    n = (size - 9) // 16
    if (np.ascontiguousarray(raw[head[:, 5:]]).view("<u4").ravel() != n).any():
        return None
    body = np.ones(len(raw), bool)
    body[head.ravel()] = False
    at = raw[body].view("<f8").reshape(-1, 2)
    if not np.isfinite(at).all():
        return None
    return np.r_[0, np.cumsum(n)], np.ascontiguousarray(at[:, 0]), np.ascontiguousarray(at[:, 1])


def encoded(offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
    """WKB; null for a line without points."""
    n = np.diff(offsets)
    has = n > 0
    size = np.where(has, 9 + 16 * n, 0)
    ends = np.cumsum(size)
    raw = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    head = (ends - size)[has][:, None] + np.arange(9)
    raw[head[:, :5]] = np.frombuffer(HEAD, np.uint8)
    raw[head[:, 5:]] = np.ascontiguousarray(n[has], "<u4").view(np.uint8).reshape(-1, 4)
    body = np.ones(len(raw), bool)
    body[head.ravel()] = False
    raw[body] = np.stack([x, y], 1).astype("<f8").view(np.uint8).ravel()
    if len(raw) >= 1 << 31:
        raise ValueError("a batch of lines is over 2 GB")
    valid = None if has.all() else pa.py_buffer(np.packbits(has, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(n), [valid, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(raw)])


def envelopes(offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """xmin, ymin, xmax, ymax of lines that all have points."""
    at = offsets[:-1]
    return [f.reduceat(v, at) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]


def simplified(offsets: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: float):
    """As geometry.simplify_line of each: the segments of all lines are cut in rounds."""
    keep = np.zeros(len(x), bool)
    has = np.diff(offsets) > 0
    a, b = offsets[:-1][has], offsets[1:][has] - 1
    keep[a] = keep[b] = True
    while True:
        todo = b - a >= 2
        a, b = a[todo], b[todo]
        if not len(a):
            break
        n = b - a - 1
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(of)) - first[of] + a[of] + 1
        dx, dy = (x[b] - x[a])[of], (y[b] - y[a])[of]
        vx, vy = x[at] - x[a][of], y[at] - y[a][of]
        long = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(long > 0, np.clip((vx * dx + vy * dy) / long, 0, 1), 0.0)
        far = np.hypot(vx - t * dx, vy - t * dy)
        most = np.maximum.reduceat(far, first)
        best = np.minimum.reduceat(np.where(far == most[of], at, len(x)), first)
        go = most > tolerance
        a, b, best = a[go], b[go], best[go]
        keep[best] = True
        a, b = np.r_[a, best], np.r_[best, b]
    return np.r_[0, np.cumsum(keep)][offsets], x[keep], y[keep]


def _clipped(offsets: np.ndarray, x: np.ndarray, y: np.ndarray, box):
    """line, first of a piece, x, y of the points of the pieces inside a box, as geometry.clip_line of each."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    i = np.flatnonzero(of[1:] == of[:-1])
    ax, ay, bx, by = x[i], y[i], x[i + 1], y[i + 1]
    dx, dy = bx - ax, by - ay
    lo, hi = np.zeros(len(i)), np.ones(len(i))
    with np.errstate(divide="ignore", invalid="ignore"):
        for d, q0, q1 in ((dx, box[0] - ax, box[2] - ax), (dy, box[1] - ay, box[3] - ay)):
            t0, t1 = q0 / d, q1 / d
            flat, out = d == 0, (q0 > 0) | (q1 < 0)
            lo = np.where(flat, np.where(out, 1.0, lo), np.maximum(lo, np.minimum(t0, t1)))
            hi = np.where(flat, np.where(out, 0.0, hi), np.minimum(hi, np.maximum(t0, t1)))
    go = lo <= hi
    line, lo, hi, ax, ay, bx, by, dx, dy = (v[go] for v in (of[i], lo, hi, ax, ay, bx, by, dx, dy))
    px, py = np.where(lo == 0, ax, ax + lo * dx), np.where(lo == 0, ay, ay + lo * dy)
    qx, qy = np.where(hi == 1, bx, ax + hi * dx), np.where(hi == 1, by, ay + hi * dy)
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (px[1:] != qx[:-1]) | (py[1:] != qy[:-1])
    # A segment gives its end, and its start where a piece begins.
    take = np.stack([new, np.ones(len(new), bool)], 1).ravel()
    both = lambda u, v: np.stack([u, v], 1).ravel()[take]
    return both(line, line), both(new, np.zeros(len(new), bool)), both(px, qx), both(py, qy)


def varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of unsigned numbers one after the other, and the number of bytes of each."""
    v = v.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        at = size > k
        out[start[at] + k] = (v[at] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def commands(offsets: np.ndarray, x: np.ndarray, y: np.ndarray, box, extent: int, buffer: int | None) -> list[bytes]:
    """Packed tile commands of each line, cut and in whole tile coordinates; empty where nothing is left."""
    lines = len(offsets) - 1
    w, h = box[2] - box[0], box[3] - box[1]
    if buffer is None:
        line = np.repeat(np.arange(lines), np.diff(offsets))
        first = np.zeros(len(x), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
    else:
        bx, by = w * buffer / extent, h * buffer / extent
        line, first, x, y = _clipped(offsets, x, y, (box[0] - bx, box[1] - by, box[2] + bx, box[3] + by))
    px, py = np.rint((x - box[0]) / w * extent).astype(np.int64), np.rint((box[3] - y) / h * extent).astype(np.int64)
    go = first.copy()
    go[1:] |= (px[1:] != px[:-1]) | (py[1:] != py[:-1])
    line, first, px, py = line[go], first[go], px[go], py[go]
    # Pieces of one point go.
    at = np.flatnonzero(first)
    n = np.diff(np.r_[at, len(line)])
    go = np.repeat(n > 1, n)
    line, px, py = line[go], px[go], py[go]
    n = n[n > 1]
    if not len(n):
        return [b""] * lines
    place = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    begins = np.r_[True, line[1:] != line[:-1]]
    back = lambda v: v - np.where(begins, 0, np.r_[0, v[:-1]])
    zigzag = lambda d: np.where(d >= 0, 2 * d, -2 * d - 1)
    command = np.where(place == 0, 1 << 3 | 1, np.repeat(n - 1, n) << 3 | 2)
    stream = np.stack([command, zigzag(back(px)), zigzag(back(py))], 1)
    has = np.ones_like(stream, bool)
    has[:, 0] = place < 2
    raw, size = varints(stream[has])
    sums = np.zeros(lines, np.int64)
    np.add.at(sums, np.repeat(line, has.sum(1)), size)
    ends = np.cumsum(sums).tolist()
    raw = raw.tobytes()
    return [raw[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
