"""A blocked Bloom filter of fixed size: 512-bit blocks, eight bits a key, each in its own word.

The size doesn't depend on the number of keys (32 MB), so a filter may be broadcast; one that is
too full only lets more keys through, and what it lets through always meets an exact join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 19
#: The multipliers of the public split block filter.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash and its mask of eight words."""
    block = (h >> np.uint64(32)) % np.uint64(BLOCKS)
    bit = (((h & np.uint64(0xFFFFFFFF))[:, None] * SALTS[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return block.astype(np.int64), np.uint64(1) << bit


def build(hashes: DataFrame) -> np.ndarray:
    """The filter of a column of long hashes; blocks are merged in Spark, so at most BLOCKS rows come back."""

    def masks(batches):
        for b in batches:
            block, mask = _places(np.asarray(b.column(0)).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(block), *[pa.array(mask[:, k].view(np.int64)) for k in range(8)]], ["block", *[f"w{k}" for k in range(8)]])

    words = ", ".join(f"w{k} long" for k in range(8))
    rows = hashes.mapInArrow(masks, f"block long, {words}")
    merged = rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)]).toArrow()
    out = np.zeros((BLOCKS, 8), np.uint64)
    if merged.num_rows:
        out[merged["block"].to_numpy()] = np.stack([merged[f"w{k}"].to_numpy() for k in range(8)], 1).view(np.uint64)
    return out


def possible(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    block, mask = _places(hashes.view(np.uint64))
    return ((bits[block] & mask) == mask).all(1)
