"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which for UTF-8 is the same as
the code-point class ``[^\\x20\\x09-\\x0D]+``.  All functions work on whole columns with numpy;
columns are cut into blocks of whole documents so that the temporary arrays stay bounded by
``BLOCK_BYTES`` (or one document, where a single one is larger).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch between the JVM and Python; Spark's own bound is 64 MB for each task and direction.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

U = np.uint64
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_MUL = [int(x) | 1 for x in _rng.integers(1, 1 << 62, 64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bound_batches(df: DataFrame) -> None:
    """Lower the session's bound of Arrow batches to BATCH_BYTES; a lower one stays."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", str(conf.get(_BATCH_KEY)))) > BATCH_BYTES:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a block of documents: byte ranges in ``data`` and, by document, word ranges."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # word offset of each document, one more than documents
    rows: tuple[int, int]  # the block's rows in the batch

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, U)
        data = _LOWER[self.data] if lower else self.data
        n = len(data)
        power = np.empty(n, U)
        power[0] = 1
        power[1:] = U(_R)
        np.cumprod(power, out=power)
        total = np.cumsum(_TABLE[data] * power)
        before = np.where(self.start > 0, total[self.start - 1], U(0))
        power[0] = 1
        power[1:] = U(_RINV)
        np.cumprod(power, out=power)
        h = (total[self.end - 1] - before) * power[self.start]
        return mix(h + (self.end - self.start).astype(U) * U(_MUL[0]))

    def left(self) -> np.ndarray:
        """For each word, the words from it to its document's end, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes; the last k - 1 entries are missing."""
    if len(h) < k:
        return np.empty(0, U)
    level, size, done, out, step = h, 1, 0, None, 1
    while True:
        if k & size:
            part = level[done : done + len(h) - k + 1]
            out = mix(part + U(_MUL[40])) if out is None else mix(out * U(_MUL[step]) + part)
            done += size
        if 2 * size > k:
            return out
        level = mix(level[:-size] * U(_MUL[step + 20]) + level[size:])
        size, step = 2 * size, step + 1


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Words]:
    """The words of a string column, a null counting as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        stop = min(stop, len(column))
        lo, hi = int(offsets[row]), int(offsets[stop])
        part, cuts = data[lo:hi], offsets[row : stop + 1] - lo
        space = _SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[cuts] = True
        begin, end = ~space, ~space
        if len(part):
            begin[1:] &= space[:-1] | edge[1:-1]
            end[:-1] &= space[1:] | edge[1:-1]
        start = np.flatnonzero(begin)
        yield Words(part, start, np.flatnonzero(end) + 1, np.searchsorted(start, cuts), (row, stop))
        row = stop
