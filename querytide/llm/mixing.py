"""Mixing sources to target weights.

Each source's documents form one token stream, cut into blocks of `BLOCK` words; the last block of a
source may be shorter. A source that is to give T words of its n gives T div n whole passes over its
blocks, then as many whole blocks as fit in the rest, and the beginning of one more, so it meets its
target to the word whatever its size, and no document is taken more often than its target asks.

Output shards of `SLOTS` slots draw how many of their slots each source fills from a multinomial over
the sources' slots, each shard by its own seed on the executors. The draws' totals miss the sources'
numbers of slots a little, so the last slots of sources drawn too often go to those drawn too seldom,
by arithmetic on the totals. The slots of a source are numbered through all shards; slot j takes block
perm(j), where perm is the source's pseudorandom permutation of its block indexes (a keyed Feistel
network, walked until it falls inside the range), and the slots join the blocks by (source, index).
Nothing is materialised but positions: a document's place in the stream follows from per-bucket sums
(a fixed number of hash buckets per source), so a source that holds most rows is spread over all
tasks. The driver holds a few numbers for each source, never shards, documents or blocks.

Sources sort by code point with null last and weigh `weights` in turn. Defined results: documents
without words have size 0 and are never taken; a corpus without words has targets 0. Rows that
share a doc_id are separate rows of the stream, in the order of a hash of their text; which of two
equal rows comes first makes no difference to the rows returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables
from . import textkernel as tk

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 1024
SLOTS = 4096
PLACES = 4096
SEED = 20_240_601
#: Sources up to which their table is broadcast; a larger one is joined.
BROADCAST_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take from each source: by weight, none above `most` times its size, the excess reshared."""
    total = share * sum(sizes)
    out, open_, left = [0.0] * len(sizes), [k for k, n in enumerate(sizes) if n > 0], total
    while open_:
        whole = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / whole > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * weights[k] / whole
            break
        for k in full:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


class Plan:
    """What each source gives: whole passes, whole blocks, the beginning of one more; and its slots."""

    def __init__(self, sizes: list[int], wanted: list[float], block: int, seed: int) -> None:
        n, words = np.array(sizes, np.int64), np.rint(wanted).astype(np.int64)
        self.block, self.seed = block, seed
        self.blocks, self.full = -(-n // block), n // block
        self.passes = words // np.maximum(n, 1)
        rest = words % np.maximum(n, 1)
        self.last = rest % block
        self.slots = self.passes * self.blocks + rest // block + (self.last > 0)
        self.drawn = self.surplus = self.deficit = np.zeros(len(n) + 1, np.int64)

    def shards(self) -> int:
        return int(-(-self.slots.sum() // SLOTS))

    def draw(self, shard: int) -> np.ndarray:
        """Slots of each source in a shard."""
        total = int(self.slots.sum())
        return np.random.default_rng([self.seed, shard]).multinomial(min(SLOTS, total - shard * SLOTS), self.slots / total)

    def settle(self, drawn: np.ndarray) -> None:
        """Takes the draws' totals, from which every slot's final source follows."""
        self.drawn = drawn
        self.surplus = np.concatenate(([0], np.cumsum(np.maximum(drawn - self.slots, 0))))
        self.deficit = np.concatenate(([0], np.cumsum(np.maximum(self.slots - drawn, 0))))

    def final(self, source: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source and number of the slots that were drawn as number j of `source`."""
        rank = self.surplus[source] + j - self.slots[source]  # of a slot drawn too often, among all of these
        over = np.maximum(rank, 0)
        other = np.minimum(np.searchsorted(self.deficit, over, side="right") - 1, len(self.slots) - 1)
        own = j < self.slots[source]
        return np.where(own, source, other), np.where(own, j, self.drawn[other] + over - self.deficit[other])

    def takes(self, source: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and number of words (BLOCK: all of it) of slot j of each source."""
        turn, at = np.divmod(j, np.maximum(self.blocks[source], 1))
        whole = turn < self.passes[source]
        place = np.where(whole, at, j - self.passes[source] * self.blocks[source])
        size = np.where(whole, self.blocks[source], self.full[source])
        key = tk.joined(source.astype(np.uint64) + np.uint64(self.seed), turn.astype(np.uint64))
        tail = place >= size  # after all whole blocks, the short last one
        block = np.where(tail, self.full[source], permuted(np.where(tail, 0, place), np.maximum(size, 1), key))
        return block, np.where((j == self.slots[source] - 1) & (self.last[source] > 0), self.last[source], self.block)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1: four Feistel rounds over the least even number of bits that holds the size, walked until inside."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, live = index.astype(np.uint64), np.arange(len(index))
    while len(live):
        a, b = out[live] >> half[live], out[live] & mask[live]
        for r in range(1, 5):
            a, b = b, a ^ (tk.mix64(b + key[live] + np.uint64(r * 0x9E3779B1)) & mask[live])
        out[live] = (a << half[live]) | b
        live = live[out[live] >= size[live].astype(np.uint64)]
    return out.astype(np.int64)


def _draws(plan):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = plan.value.draw(shard)
                source = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard)), pa.array(source.astype(np.int32)), pa.array(counts[source])], names=["shard", "source_no", "count"])

    return mapper


def _slots(plan):
    """Rows (shard, source_no, first, count) to a row for each slot, with the block it takes."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, source, first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, j = plan.value.final(source, first + np.arange(count))
                block, words = plan.value.takes(own, j)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(block), pa.array(np.full(count, shard)), pa.array(j), pa.array(words)], names=["source_no", "block", "shard", "slot", "words"])

    return mapper


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros(0, np.int64)]
        for _, _, chunk in tk.chunks(batch.column(3), 4 << 20):
            found.append(np.diff(tk.spans(chunk, tk.WHITE)[2]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(found))], names=["_id", "_text", "source", "size"])


def _before(df: DataFrame, by: str, place: str, order: list[str], value: str) -> DataFrame:
    """Adds `before`, the sum of `value` over the rows of the same `by` that come earlier by (place, order), by way of sums per place."""
    sums = df.groupBy(by, place).agg(F.sum(value).alias("_held"))
    earlier = W.partitionBy(by).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(by, place, F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_base"))
    inside = W.partitionBy(by, place).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.join(sums.hint("merge"), [by, place]).withColumn("before", F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base")


class Mix:
    """A mix of the documents (doc_id, text, source)."""

    def __init__(self, documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, block: int = BLOCK) -> None:
        spark = documents.sparkSession
        tables.small_batches(spark)
        base = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(tables.NULL_ID)).alias("_id"), F.xxhash64("text").alias("_text"), F.col("source").cast("string").alias("source"), "text")
        sized = tables.written(base.mapInArrow(_sizes, "_id long, _text long, source string, size long"), "sizes")
        totals = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a number for each source
        totals = sorted(((r["source"], r["size"]) for r in totals), key=lambda r: (r[0] is None, r[0] or ""))
        size = [n for _, n in totals]
        self.block = block
        self.target = targets(size, [float(weights[k % len(weights)]) for k in range(len(size))], share, most)
        rows = [(x, k, n, t) for k, ((x, n), t) in enumerate(zip(totals, self.target, strict=True))]
        self.sources = spark.createDataFrame(rows, "source string, source_no int, source_size long, target double")
        if len(rows) <= BROADCAST_SOURCES:
            self.sources = F.broadcast(self.sources)
        plan = Plan(size, self.target, block, seed)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        drawn = spark.range(0, plan.shards(), 1, min(n, max(plan.shards(), 1))).mapInArrow(_draws(spark.sparkContext.broadcast(plan)), "shard long, source_no int, count long")
        drawn = tables.written(drawn, "draws")
        sums = np.zeros(len(size), np.int64)
        for r in drawn.groupBy("source_no").agg(F.sum("count").alias("n")).collect():  # a number for each source
            sums[r["source_no"]] = r["n"]
        plan.settle(sums)
        placed = _before(drawn.withColumn("place", F.expr("shard div 1024")), "source_no", "place", ["shard"], "count")
        spread = placed.select("shard", "source_no", F.col("before").alias("first"), "count").repartition(n, "shard", "source_no")
        self.slots = spread.mapInArrow(_slots(spark.sparkContext.broadcast(plan)), "source_no int, block long, shard long, slot long, words long")
        self.documents = self._placed(sized)

    def _placed(self, sized: DataFrame) -> DataFrame:
        """Adds the source's columns and the document's first word in its source's stream."""
        known = sized.join(self.sources, sized["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        known = known.withColumn("place", F.pmod(F.xxhash64("_id"), F.lit(PLACES)).cast("int"))
        return _before(known, "source_no", "place", ["_id", "_text"], "size").withColumnRenamed("before", "start").drop("place")

    def pieces(self) -> DataFrame:
        """The parts of blocks that lie in one document: block, words from the block's and the document's first, and count."""
        last = F.expr(f"(start + size - 1) div {self.block}")
        cut = self.documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {self.block}"), last)))
        low = F.greatest(F.col("block") * self.block, F.col("start"))
        high = F.least((F.col("block") + 1) * self.block, F.col("start") + F.col("size"))
        return cut.select("_id", "_text", "source_no", "block", "start", (low - F.col("block") * self.block).alias("inner"), (low - F.col("start")).alias("word"), (high - low).alias("count"))

    def taken(self) -> DataFrame:
        """Every document with the words that the mix takes of it."""
        whole = F.col("words") == self.block
        times = self.slots.groupBy("source_no", "block").agg(F.sum(whole.cast("long")).alias("times"), F.sum(F.when(whole, 0).otherwise(F.col("words"))).alias("part"))
        own = F.col("count") * F.col("times") + F.greatest(F.least("count", F.col("part") - F.col("inner")), F.lit(0))
        words = self.pieces().join(times.hint("merge"), ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(own).alias("words"))
        words = words.select("source_no", F.col("start").alias("at"), "words")
        found = self.documents.withColumn("at", F.when(F.col("size") > 0, F.col("start"))).join(words.hint("merge"), ["source_no", "at"], "left")
        return found.withColumn("taken", F.coalesce("words", F.lit(0)))

    def blocks(self) -> DataFrame:
        """shard, slot, source_no, block, start (of the document), _id, _text, word, count: the mix by its pieces."""
        both = self.slots.join(self.pieces().hint("merge"), ["source_no", "block"])
        return both.withColumn("count", F.least("count", F.col("words") - F.col("inner"))).where("count > 0").drop("words", "inner")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each taken piece, joined by single spaces."""
    names = ["doc_id", "source", "lang", "shard", "slot", "block", "word", "text"]
    for batch in batches:
        takes = batch.column(batch.schema.get_field_index("takes"))
        many = np.asarray(takes.value_lengths())
        first_take = np.concatenate(([0], np.cumsum(many)))
        shard, slot, block, word, count = (np.asarray(takes.flatten().field(k)) for k in range(5))
        for a, b, chunk in tk.chunks(batch.column(batch.schema.get_field_index("text")), 4 << 20):
            begin, end, first = tk.spans(chunk, tk.WHITE)
            data, offsets = tk.kept_words(chunk, begin, end, first, np.ones(len(begin), bool))
            wide = np.concatenate(([0], np.cumsum(end - begin + 1)))
            mine = slice(first_take[a], first_take[b])
            row = np.repeat(np.arange(b - a), many[a:b])
            low, high = first[row] + word[mine], first[row] + word[mine] + count[mine]
            shift = offsets[row] - wide[first[row]]
            raw, at, to = data.tobytes(), wide[low] + shift, wide[high] + shift - 1
            texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(at.tolist(), to.tolist(), strict=True)]
            pick = pa.array(row + a)
            fixed = [batch.column(batch.schema.get_field_index(c)).take(pick) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(x[mine]) for x in (shard, slot, block, word)), pa.array(texts, pa.string())], names=names)


def mixed_texts(documents: DataFrame) -> DataFrame:
    """The mix as training pieces: shard, slot, block, word (place in the document), text, with doc_id, source and lang."""
    mix = Mix(documents)
    takes = mix.blocks().groupBy("_id", "_text", "source_no").agg(F.collect_list(F.struct("shard", "slot", "block", "word", "count", "start")).alias("takes"))
    takes = takes.join(mix.sources.select("source_no", F.col("source").alias("_source")), "source_no")
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(tables.NULL_ID)).alias("_id"), F.xxhash64("text").alias("_text"), "doc_id", "source", "lang", "text").dropDuplicates(["_id", "_text", "source"])
    joined = rows.join(takes, (rows["_id"] == takes["_id"]) & (rows["_text"] == takes["_text"]) & rows["source"].eqNullSafe(takes["_source"]))
    return joined.select("doc_id", "source", "lang", "text", "takes").mapInArrow(_cut, "doc_id long, source string, lang string, shard long, slot long, block long, word long, text string")


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    found = Mix(tables.table(spark, sf_dir, "documents")).taken()
    return found.select(tables.doc_id(), "size", "source_size", "target", "taken")
