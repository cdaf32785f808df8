"""Frequency-aware anchors for windows.

A window's anchor is its smallest k-mer by hash, and all windows of one anchor meet in one task. A
passage that stands in a large share of the documents, each time among other words, would send
every window that crosses its edge to the passage's own anchors. So k-mers that are frequent in a
bounded sample of documents rank last: a window takes one of them only if it has no other, that is,
if it lies inside the frequent passage, where all copies are equal and combine before the shuffle.
The order depends on the k-mer alone, so equal windows still have equal anchors, whatever the
sample holds; it decides where windows meet, never which ones are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

#: Documents in the sample, documents of it that make a k-mer frequent, and k-mers in the list at most.
SAMPLE_ROWS, LEAST, MOST = 4096, 4, 1 << 18
_BITS = np.uint64((1 << 20) - 1)


class Frequent:
    """A set of hashes with a bitmap before the search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.hashes & _BITS).astype(np.int64)] = True

    def has(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), bool)
        if len(self.hashes):
            maybe = np.flatnonzero(self.bitmap[(grams & _BITS).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, grams[maybe]), len(self.hashes) - 1)
            out[maybe] = self.hashes[at] == grams[maybe]
        return out


def positions(grams: np.ndarray, width: int, frequent: Frequent) -> np.ndarray:
    """For each window of `width` grams the place of its anchor: not frequent before frequent, then by hash, then leftmost."""
    key = (grams >> np.uint64(33) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)  # the same bits in every chunk
    key |= frequent.has(grams).astype(np.uint64) << np.uint64(63)
    return (tk.sliding_minimum(key, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def frequent_grams(docs: DataFrame, grams_of: Callable[[tk.Chunk], tuple[np.ndarray, np.ndarray]]) -> Frequent:
    """Frequent k-mers of a sample of `docs` (_id, text). grams_of: a chunk's hashes and their documents."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, chunk in tk.chunks(batch.column(0), 1 << 20):
                grams, document = grams_of(chunk)
                order = np.lexsort((document, grams))
                grams, document = grams[order], document[order]
                first = np.ones(len(grams), bool)
                first[1:] = (grams[1:] != grams[:-1]) | (document[1:] != document[:-1])
                found, n = np.unique(grams[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["gram", "n"])

    ids = docs.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    sample = docs.join(F.broadcast(ids), "_id").select("text")  # SAMPLE_ROWS ids at most
    counted = sample.mapInArrow(mapper, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    rows = counted.orderBy(F.desc("n"), "gram").limit(MOST).select("gram").toArrow()
    return Frequent(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))
