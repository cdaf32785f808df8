"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed per document. Copies with one fingerprint form one class, so only
distinct fingerprints are compared. Two fingerprints within the radius agree on at least two of
four 16-bit blocks, so comparing all pairs that share two blocks (six tables of 32-bit keys)
loses no link. Each key's fingerprints are sorted by population count and compared in numpy
tiles (exclusive-or and bit counts); tile pairs whose population counts differ by more than the
radius are skipped. A key with more fingerprints than a tile holds is cut into tiles by population
count, and only pairs of tiles whose counts come within the radius are dealt out to tasks.
A task returns a spanning forest of its links, never all pairs, and the components follow from
alternating large-star and small-star rounds over these forests.

Defined results: texts without words (null, empty, only white space) have fingerprint zero and
link like any other. component_id is the smallest doc_id reachable; a null doc_id counts as
smallest. Repeated rows each return a row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables
from . import textkernel as tk
from .exchange import bucket_count

RADIUS, SHINGLE, SEED = 2, 3, 42
TILE = 4096
CHUNK_BYTES = 2 << 20
# XXH64 primes (fixed values of the published algorithm)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_LONG = 1024
#: A byte's bits, each in a byte of its own.
_SPREAD = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(np.uint64).ravel()


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of slices of `data`, all slices of one length at a time."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    half = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    order = np.argsort(np.minimum(length, _LONG + 1).astype(np.uint16), kind="stable")
    ranked = length[order]
    cut = np.flatnonzero(np.diff(ranked, prepend=-1))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for a, b in zip(cut, np.append(cut[1:], len(ranked)), strict=True):
            size, rows = int(ranked[a]), order[a:b]
            if size > _LONG:
                for i in order[a:]:
                    out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]].tobytes(), seed)
                break
            at, done = start[rows], 0
            if size >= 32:
                acc = [np.full(len(at), v) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
                while done + 32 <= size:
                    acc = [_round(v, wide[at + (done + 8 * i)]) for i, v in enumerate(acc)]
                    done += 32
                h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
                for v in acc:
                    h = (h ^ _round(np.uint64(0), v)) * _P1 + _P4
            else:
                h = np.full(len(at), s + _P5)
            h = h + np.uint64(size)
            while done + 8 <= size:
                h = _rot(h ^ _round(np.uint64(0), wide[at + done]), 27) * _P1 + _P4
                done += 8
            if done + 4 <= size:
                h = _rot(h ^ (half[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
                done += 4
            while done < size:
                h = _rot(h ^ (data[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def shingles(chunk: tk.Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, length, first): lower-cased shingles as slices of the words joined by single spaces."""
    begin, end, first = tk.spans(chunk, tk.WHITE)
    lower = tk.Chunk(tk.LOWER[chunk.data], chunk.offsets)
    data, offsets = tk.kept_words(lower, begin, end, first, np.ones(len(begin), bool))
    counts = np.diff(first)
    words = np.repeat(np.arange(len(counts)), counts)
    wide = end - begin
    place = np.cumsum(wide + 1) - (wide + 1)
    place = place - np.repeat(place[first[:-1][counts > 0]], counts[counts > 0]) + offsets[words] if len(begin) else place
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    of = np.repeat(np.arange(len(counts)), number)
    head = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    tail = np.minimum(head + size, first[of + 1]) - 1
    return data, place[head], place[tail] + wide[tail] - place[head], np.concatenate(([0], np.cumsum(number)))


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each document: the bits set in over half of its hashes."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    block = -(-counts[full] // 255)
    head = np.concatenate(([0], np.cumsum(block)))[:-1]
    at = np.repeat(first[:-1][full], block) + 255 * (np.arange(block.sum()) - np.repeat(head, block))
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        lanes = np.add.reduceat(_SPREAD[raw[:, j]], at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), head, axis=0)
        bits = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little").ravel()
        out[full] |= bits.astype(np.uint64) << np.uint64(8 * j)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """_id, _tag, fp (long) of rows (_id, _tag, text)."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, _, chunk in tk.chunks(batch.column(2), CHUNK_BYTES):
                data, start, length, first = shingles(chunk)
                found.append(majority(xxh64(data, start, length), first))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found).view(np.int64))], names=["_id", "_tag", "fp"])

    return docs.select("_id", "_tag", "text").mapInArrow(mapper, "_id long, _tag long, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node that is not its component's smallest, from links a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def tile_links(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """All links within the radius among fingerprints, tile by tile in the order of population counts."""
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    fps, pop = fps[order], pop[order].astype(np.int64)
    left, right = [], []
    step = min(tile, 512)
    for i in range(0, len(fps), step):
        x = fps[i : i + step]
        for j in range(i, len(fps), step):
            if pop[j] - pop[min(i + step, len(fps)) - 1] > radius:
                break
            y = fps[j : j + step]
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            fresh = p + i < q + j
            left.append(x[p[fresh]])
            right.append(y[q[fresh]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _group_links(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each group; small groups are compared together at one distance after another."""
    order = np.lexsort((np.bitwise_count(fps), group))
    group, fps = group[order], fps[order]
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(cut, len(group)))
    left, right = [], []
    small = np.repeat(size <= 64, size)
    g, f = group[small], fps[small]
    for lag in range(1, int(size[size <= 64].max(initial=1))):
        hit = np.flatnonzero((g[lag:] == g[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= radius))
        left.append(f[hit])
        right.append(f[hit + lag])
    for a, n in zip(cut[size > 64], size[size > 64], strict=True):
        p, q = tile_links(fps[a : a + n], radius)
        left.append(p)
        right.append(q)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(radius: int):
    def reducer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        key, a, b, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, a, key))
        new = np.concatenate(([True], (np.diff(key[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new)
        x, y = _group_links(group, fp.view(np.uint64), radius)
        node, root = forest(x.view(np.int64), y.view(np.int64)) if len(x) else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

    return reducer


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, n: int = 0) -> DataFrame:
    """Forests (u, v) of the links between distinct fingerprints (column fp), compared in `n` tasks."""
    if radius > 2:
        raise ValueError("two of four blocks must agree: the radius is 2 at most")
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.shiftleft(F.lit(t).cast("long"), 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for t, (i, j) in enumerate(combinations(range(4), 2))]
    entries = distinct.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*keys)).alias("key"))
    counted = entries.groupBy("key", "pop").agg(F.count("*").alias("n"))  # 65 rows of a key at most
    key = W.partitionBy("key")
    upto = lambda last: F.coalesce(F.sum("n").over(key.orderBy("pop").rangeBetween(W.unboundedPreceding, last)), F.lit(0))
    # fingerprints of a key stand in the order of their counts; a tile is `tile` places of it
    placed = counted.select("key", "pop", "n", F.sum("n").over(key).alias("all"), upto(-1).alias("before"), upto(-radius - 1).alias("low"), upto(radius).alias("high")).where("all > 1")
    own = F.floor((F.col("before") + F.pmod(F.xxhash64("fp"), F.col("n"))) / tile)
    dealt = (
        entries.join(placed, ["key", "pop"])
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.floor(F.col("low") / tile), F.floor((F.col("high") - 1) / tile))).alias("other"))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    )
    n = n or int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "a", "b").mapInArrow(_links(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v) but the roots: alternating large-star and small-star rounds."""
    edges = tables.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        before, edges = edges, tables.written(small, "stars")
        tables.removed(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """_id, _tag, fp, root (the group) and component (smallest _id reachable) of every row."""
    docs, _ = tables.keyed(documents, "text")
    prints = tables.written(fingerprints(tables.with_tag(docs)), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("_id").alias("rep"))
    roots = components(links(classes.select("fp"), radius, n=bucket_count(docs)))
    of = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("rep").alias("component"))
    return prints.join(of.join(least, "root").select("fp", "root", "component"), "fp")


def representatives(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group, with all columns: the row of the smallest doc_id (among its rows, of the least text hash)."""
    names = documents.columns
    docs, _ = tables.keyed(documents, "text")
    prints = tables.written(fingerprints(tables.with_tag(docs)), "fingerprints")
    # one row of each fingerprint stands for its copies, so a large group is combined before any shuffle or join
    classes = prints.groupBy("fp").agg(F.min(F.struct("_id", "_tag")).alias("b"))
    roots = components(links(classes.select("fp"), radius, n=bucket_count(docs))).withColumnRenamed("node", "fp")
    best = classes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("b").alias("b")).select("b.*")
    rows, key = tables.keyed(tables.whole(documents), "_row", "text")
    # texts meet their keys by a sort-merge join at every size, so cost and disk follow the input without a jump
    kept = rows.join(best.select(*key).hint("merge"), key, "left_semi")
    return tables.unpacked(kept.dropDuplicates(key) if "_tag" in key else kept, names)


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(tables.table(spark, sf_dir, "documents"))
    component = F.when(F.col("component") != tables.NULL_ID, F.col("component")).alias("component_id")
    return found.select(tables.doc_id(), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component)
