"""Frequent word runs, to keep them out of shuffle keys.

The list only guides which of several equally valid keys a row is dealt by; results never
depend on it.  It is counted over all texts: a block of documents reports the runs that it holds
often, Spark sums the reports, and the most frequent ``keep`` are taken, so the list that is
broadcast has a fixed bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import text as T


def frequent(docs: DataFrame, k: int, lower: bool = False, per_block: int = 6, keep: int = 1 << 16, at_least: int = 64) -> np.ndarray:
    """Sorted hashes of runs of k words."""

    def report(batches):
        for b in batches:
            for w in T.blocks(b.column(0)):
                h = T.windows(w.hashes(lower), k)
                h = np.sort(h[w.left()[: len(h)] >= k])
                if not len(h):
                    continue
                at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                n = np.diff(np.r_[at, len(h)])
                often = n >= per_block
                yield pa.RecordBatch.from_arrays([pa.array(h[at[often]].view(np.int64)), pa.array(n[often])], ["h", "n"])

    found = docs.select("text").mapInArrow(report, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)
    top = found.orderBy(F.desc("n"), "h").limit(keep).select("h").toArrow()
    return np.sort(top["h"].to_numpy().view(np.uint64))


def member(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)
    return sorted_set[at] == h
