"""One shuffle of packed numpy records.

A mapper turns Arrow batches into rows (bucket, blob): each blob holds the records of one chunk
for one bucket, column by column, so the JVM moves a few large rows in place of millions of small
ones. A reducer gets every blob of its bucket. The number of buckets follows the size of the
input, so a bucket's records fit in a task at any scale; mappers combine equal keys inside a
chunk first, which leaves at most one record per chunk and key for a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "bucket int, blob binary"
#: Bytes of input that one bucket stands for at most.
BUCKET_BYTES = 32 << 20


def bucket_count(df: DataFrame) -> int:
    """At least the session's shuffle partitions; more if the input is large. Without statistics its texts are measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length in one blob; the bytes of equal weight stand together, for compression."""
    n = len(columns[0])
    parts = [np.int64(n).tobytes()]
    for c in columns:
        width = c.dtype.itemsize
        c = np.ascontiguousarray(c)
        parts.append(c.view(np.uint8).reshape(n, width).T.tobytes() if 1 < width and n else c.tobytes())
    return b"".join(parts)


def unpack(blob: bytes, dtypes: list[np.dtype]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for d in map(np.dtype, dtypes):
        raw = np.frombuffer(blob, np.uint8, n * d.itemsize, at)
        at += n * d.itemsize
        out.append(np.ascontiguousarray(raw.reshape(d.itemsize, n).T).view(d).reshape(n) if d.itemsize > 1 else raw.view(d))
    return out


def deal(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) for each bucket that has records."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    cut = np.flatnonzero(np.diff(ranked, prepend=ranked[0] - 1))
    columns = [c[order] for c in columns]
    for a, b in zip(cut, np.append(cut[1:], len(ranked)), strict=True):
        yield int(ranked[a]), pack([c[a:b] for c in columns])


def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Even buckets from the high bits of a hash (the low bits are compared later)."""
    return ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def exchange(df: DataFrame, mapper: Callable, reducer: Callable, schema: str, n: int) -> DataFrame:
    """mapper: batches -> (bucket, blob) batches. reducer: list of blobs of one bucket -> batches of `schema`."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # n buckets in n partitions: all blobs of a partition are of one bucket
        blobs = [blob for b in batches for blob in b.column(1).to_pylist()]
        if blobs:
            yield from reducer(blobs)

    return df.mapInArrow(mapper, PACKED).repartitionById(n, "bucket").mapInArrow(reduce, schema)
