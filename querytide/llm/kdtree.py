"""Exact top-k inner products over KD-trees, one tree per shard of the vectors.

1. Vectors. Components become whole numbers, floor(scale * x); a row gets a number of its own, so a query
   leaves out its own row and no other. Rows are dealt to shards of even size by that number.
2. Index. In each shard median splits along the widest side of a box cut the vectors into leaves. Every
   node keeps its tight bounding box. The trees are a table, one row per shard.
3. Search. Queries travel in blocks of `BLOCK` to bands of trees. A box's bound is the largest inner
   product that any point of it could have with the query. Each query walks a tree best box first, and
   ends at the first box whose bound is below its k-th score; the leaves that several queries open in
   one round are scored together.
4. Propagation. Each block is searched in one shard first. The k-th score found there goes with the
   query to all other shards, which return only what reaches it.
5. The few rows left for each query are ranked.

Scores are exact: products are made in float64 only where every sum stays below 2^53, else in int64.

Defined results: vectors that are null, or hold null or non-finite components, take no part. Shorter
vectors count as if zeros followed; an empty vector scores 0. A whole-number component beyond 2^27
counts as 2^27 (either sign), so that sums fit a long. Rows without vec_id are candidates after all
others of the same score, and no queries. Rows that share a vec_id are different rows: each is a query of
its own, with the others among its candidates. Fewer candidates than k give fewer rows, an empty
table none. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables

SCALE, K, EVERY = 256, 5, 50
#: Vectors of a shard and of a leaf at most, queries of a block, and blocks that meet a tree in one task.
SHARD, LEAF, BLOCK, BAND = 8192, 256, 512, 8
LIMIT = 1 << 27
#: Stands for a null vec_id, after all others.
NO_ID = (1 << 63) - 1
#: What a tree is stored as, and the parts of it in 32 bits.
TREE = ["row", "ids", "child", "nodes", "low", "high", "points"]
WIDE = {"low", "high", "points"}
FOUND = "query_row long, query_id long, vec_id long, score long"
_LOW = -(1 << 62)


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, vector) of the valid vectors of `vectors` (vec_id, embedding); written, so that row numbers stay."""
    x = F.col("embedding")
    valid = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cell = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))).cast("long")
    return tables.written(vectors.where(F.coalesce(valid, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, cell).alias("vector")), "vectors")


def matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors as rows, zeros after shorter ones."""
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), int(length.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Tree:
    """A KD-tree in arrays: of each node the place of its left child (0: a leaf; the right child follows), its vectors and its box."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> None:
        order, nodes, at = np.argsort(ids, kind="stable"), [(0, len(ids))], 0
        child, low, high = [], [], []
        while at < len(nodes):
            a, b = nodes[at]
            own = points[order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            child.append(0)
            if b - a > leaf:
                side = int(np.argmax(high[-1] - low[-1])) if own.shape[1] else 0
                middle = (b - a) // 2
                cut = np.argsort(own[:, side], kind="stable") if own.shape[1] else np.arange(b - a)
                here = order[a:b]
                # inside each half the order of the ids stays: ties are then found by place
                order[a:b] = np.concatenate([here[np.sort(cut[:middle])], here[np.sort(cut[middle:])]])
                child[-1] = len(nodes)
                nodes += [(a, a + middle), (a + middle, b)]
            at += 1
        self.child, self.nodes = np.array(child), np.array(nodes)
        self.low, self.high = np.array(low), np.array(high)
        self.row, self.ids, self.points = row[order], ids[order], points[order]

    def packed(self) -> dict[str, list[bytes]]:
        """The columns of TREE."""
        return {x: [np.ascontiguousarray(getattr(self, x), np.int32 if x in WIDE else np.int64).tobytes()] for x in TREE}

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> Tree:
        self = cls.__new__(cls)
        for x in TREE:
            setattr(self, x, np.frombuffer(row[x], np.int32 if x in WIDE else np.int64).astype(np.int64))
        self.nodes = self.nodes.reshape(-1, 2)
        self.low, self.high, self.points = (getattr(self, x).reshape(n, -1) for x, n in (("low", len(self.child)), ("high", len(self.child)), ("points", len(self.row))))
        return self

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the largest inner product that a point of the node's box can have."""
        return product(np.maximum(queries, 0), self.high) + product(np.minimum(queries, 0), self.low)

    def search(self, rows: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of each query, best first; scores of places that stay free or fall below `kth` are _LOW."""
        bound = self.bounds(queries)
        ids, scores = np.full((len(rows), k), NO_ID), np.full((len(rows), k), _LOW)
        children = self.child.tolist()
        heaps, bar = [[(-int(b), 0)] for b in bound[:, 0]], kth.copy()
        live = range(len(rows))
        while live:
            opened = defaultdict(list)
            for q in live:
                heap = heaps[q]
                while heap:
                    best, node = heapq.heappop(heap)
                    if -best < bar[q]:
                        heap.clear()
                    elif child := children[node]:
                        for x in (child, child + 1):
                            heapq.heappush(heap, (-int(bound[q, x]), x))
                    else:
                        opened[node].append(q)
                        break
            for node, asked in opened.items():
                a, b = self.nodes[node]
                who = np.array(asked)
                made = product(queries[who], self.points[a:b])
                made[rows[who][:, None] == self.row[a:b]] = _LOW
                top = np.argsort(-made, axis=1, kind="stable")[:, :k]
                new_ids = np.concatenate([ids[who], self.ids[a:b][top]], axis=1)
                new_scores = np.concatenate([scores[who], np.take_along_axis(made, top, axis=1)], axis=1)
                best = np.lexsort((new_ids, -new_scores), axis=1)[:, :k]
                ids[who], scores[who] = np.take_along_axis(new_ids, best, 1), np.take_along_axis(new_scores, best, 1)
                bar[who] = np.maximum(bar[who], scores[who, k - 1])
            live = [q for asked in opened.values() for q in asked]
        scores[scores < kth[:, None]] = _LOW
        return ids, scores


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact; the narrower side counts as followed by zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = max(int(np.abs(a).max(initial=0)), 1) * max(int(np.abs(b).max(initial=0)), 1) * max(width, 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype(np.int32)).tobytes()


def unblob(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(rows, -1).astype(np.int64)


def trees(vectors: DataFrame, shards: int, leaf: int = LEAF) -> DataFrame:
    """The index: one tree per shard, written."""

    def build(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].fill_null(NO_ID).to_numpy()
        return pa.table({"shard": table["shard"][:1]} | Tree(table["row"].to_numpy(), ids, matrix(table["vector"].combine_chunks()), leaf).packed())

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    return tables.written(dealt.groupBy("shard").applyInArrow(build, "shard int, " + ", ".join(f"{x} binary" for x in TREE)), "trees")


def blocks(queries: DataFrame, size: int = BLOCK) -> DataFrame:
    """Queries (row, vec_id, vector, kth) as rows (block, rows, ids, points, kth) of at most `size` queries each, written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                row, points = part.column(0).to_numpy(), matrix(part.column(2))
                yield pa.RecordBatch.from_pydict({"block": [int(row[0])], "rows": [row.tobytes()], "ids": [part.column(1).to_numpy().tobytes()], "points": [blob(points)], "kth": [part.column(3).to_numpy().tobytes()]}, schema=pa.schema([("block", pa.int64()), ("rows", pa.binary()), ("ids", pa.binary()), ("points", pa.binary()), ("kth", pa.binary())]))

    tables.small_batches(queries.sparkSession)
    return tables.written(queries.mapInArrow(pack, "block long, rows binary, ids binary, points binary, kth binary"), "blocks")


def searched(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """FOUND rows of `asked` (shard, band and the columns of a block), each searched in its shard's tree."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {x: [np.zeros(0, np.int64)] for x in ("query_row", "query_id", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            tree = Tree.unpacked(left.slice(0, 1).to_pylist()[0])
            for part in right.select(["rows", "ids", "points", "kth"]).to_pylist():
                rows, own = np.frombuffer(part["rows"], np.int64), np.frombuffer(part["ids"], np.int64)
                ids, scores = tree.search(rows, unblob(part["points"], len(rows)), np.frombuffer(part["kth"], np.int64), k)
                query, place = np.nonzero(scores > _LOW)
                for name, x in (("query_row", rows[query]), ("query_id", own[query]), ("vec_id", ids[query, place]), ("score", scores[query, place])):
                    out[name].append(x)
        return pa.table({name: np.concatenate(x) for name, x in out.items()})

    pairs = asked.select(F.col("shard").alias("tree"), F.col("band").alias("to")).distinct()
    many = index.join(pairs, F.col("shard") == F.col("tree")).select("tree", "to", *TREE)  # a tree for each band that asks it
    return many.groupBy("tree", "to").cogroup(asked.groupBy("shard", "band")).applyInArrow(search, FOUND)


def top_k(vectors: DataFrame, queries, k: int = K, scale: int = SCALE, shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` (vec_id, embedding) that the condition `queries` on vec_id takes, its k best others."""
    spark = vectors.sparkSession
    numbers = whole_numbers(vectors, scale)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-numbers.count() // shard))
    index = trees(numbers, shards, leaf)
    chosen = numbers.where(queries & F.col("vec_id").isNotNull())
    first = blocks(chosen.withColumn("kth", F.lit(_LOW + 1)), block)
    home = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")
    seeds = tables.written(searched(index, first.withColumns({"shard": home, "band": F.lit(0).cast("long")}), k), "seeds")
    bars = seeds.groupBy("query_row").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_row").alias("row"), "low")
    again = blocks(chosen.hint("merge").join(bars, "row", "left").select("row", "vec_id", "vector", F.coalesce("low", F.lit(_LOW + 1)).alias("kth")), block)
    for done in (numbers, first, seeds):
        tables.removed(done)
    everywhere = again.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("band", F.pmod(F.xxhash64("block"), F.greatest(F.lit(1), F.lit(-(-again.count() // BAND)))))
    found = searched(index, everywhere, k)
    best = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", best).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
