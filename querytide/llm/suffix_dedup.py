"""Deduplication of repeated byte strings by column-wise construction of a multi-document index.

A document's windows of `length` bytes are grouped by anchor: the smallest `ANCHOR`-byte string in
the window, by hash. Consecutive windows with one anchor form a segment of at most
`length + length - ANCHOR` bytes. Equal windows have equal anchors at equal offsets, so all copies
of a string meet under one anchor, aligned on it:

1. one shuffle brings the segments of an anchor together. Equal ones (by 128 bits of hashes) stand
   for each other; an anchor with one place only is dropped, as nothing in it can repeat;
2. the bytes of every different segment that is left are fetched by source coordinates, twice if it
   has copies, and form the documents of a collection that is indexed column by column: every round
   inserts one symbol per document, from the last column to the first, and updates the order of the
   suffixes (a stable sort of the previous order by the new symbols, which in that order are the
   round's column of the Burrows-Wheeler transform) and the common prefixes of neighbours. Symbols
   are read from a file column after column, and the transform and the prefixes are appended to
   files, so memory holds the arrays of two columns whatever the collection's width. A window is
   repeated where a neighbour shares `length` symbols or more;
3. what the index says of a segment holds for all its copies. The bytes of each copy are read again
   and compared by a 128-bit digest; if two copies differ, all is done again with other hash
   functions, so no collision reaches the result.

The construction over whole documents would need as many rounds as the longest document has bytes,
each rewriting the index of all documents; on anchored segments it is bounded by 2 * `length` rounds.

Defined results: a null text is empty. Texts shorter than `length` keep everything. Windows are
judged on the input, all copies go, those in one document included. Rows that share a doc_id are
told apart by their text and repeat each other; rows equal in both are copies of each other too.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, tables
from . import textkernel as tk
from .exchange import batch_of, bucket_count, bucket_of, deal, exchange, pack, unpack
from .substring_dedup import flat_spans, gathered

LENGTH, ANCHOR = 400, 200
CHUNK_BYTES = 1 << 19
#: Bytes of documents that are indexed together; an anchor with more is a collection of its own.
COLLECTION_BYTES = 4 << 20
#: A row for each segment; `copies` is 0 but at the one of its equals that is indexed: 1 or 2 (two or more).
SEGMENTS = "_id long, _tag long, start int, size int, shift int, anchor long, content long, copies int"
RUNS = "anchor long, content long, many boolean, runs array<struct<inner:int,count:int>>"
_RECORDS = ["u8", "u8", "i8", "i8", "u4", "u2", "u2", "u1"]
_ASKED = ["u8", "u8", "u2", "u2", "u1"]


def _grams(anchor: int):
    def grams_of(chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        (grams,) = tk.byte_windows(chunk.data, anchor)
        valid = tk.window_valid(chunk.offsets, len(chunk.data), anchor)[: len(grams)]
        return grams[valid], np.repeat(np.arange(len(chunk)), np.diff(chunk.offsets))[: len(grams)][valid]

    return grams_of


def _segments(n_buckets: int, length: int, anchor: int, frequent, family: int, bits: int):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, chunk in tk.chunks(batch.column(2), CHUNK_BYTES):
                rows = _chunk_segments(chunk, ids[a:b], tags[a:b], n_buckets, length, anchor, frequent.value, family, np.uint64((1 << bits) - 1))
                if rows:
                    yield batch_of(rows)

    return mapper


def _chunk_segments(chunk, ids, tags, n_buckets, length, anchor, frequent, family, mask) -> list[tuple[int, bytes]]:
    n = len(chunk.data)
    index = np.flatnonzero(tk.window_valid(chunk.offsets, n, length)[: max(n - length + 1, 0)])
    if not len(index):
        return []
    grams, strings = tk.byte_windows(chunk.data, anchor, length, family=family)
    place = anchors.positions(grams, length - anchor + 1, frequent)[index]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(index) != 1) | (np.diff(place) != 0))))
    size = np.diff(np.append(cut, len(index)))
    first, place = index[cut], place[cut]
    key = grams[place]
    # the first and the last window hold all bytes of a segment, as it has fewer starts than a window has bytes
    content = tk.joined(tk.joined(strings[first], strings[first + size - 1]), size.astype(np.uint64)) & mask
    doc = np.searchsorted(chunk.offsets, first, side="right") - 1
    start = first - chunk.offsets[doc]
    # of the equal segments of this chunk one goes to its anchor's bucket, with the news that it has copies
    many, lead = np.zeros(len(cut), bool), np.ones(len(cut), bool)
    some = np.flatnonzero(tk.repeated(content))
    if len(some):
        order = some[np.lexsort((key[some], content[some]))]
        same = (content[order][1:] == content[order][:-1]) & (key[order][1:] == key[order][:-1])
        lead[order[1:][same]] = False
        many[order[1:][same]] = many[order[:-1][same]] = True
    columns = [key, content, ids[doc], tags[doc], start.astype(np.uint32), size.astype(np.uint16), (place - first).astype(np.uint16), many.astype(np.uint8)]
    rows = [(k, b"S" + x) for k, x in deal(bucket_of(key[lead], n_buckets), [c[lead] for c in columns])]
    if not lead.all():
        rows += [(k, b"L" + x) for k, x in deal(bucket_of(tk.mix64(ids[doc[~lead]].astype(np.uint64)), n_buckets), [c[~lead] for c in columns])]
    return rows


def _settle_segments(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    out = []
    if local := gathered(blobs, b"L", _RECORDS):
        out.append([*local[2:7], *local[:2], np.zeros(len(local[0]), np.int32)])
    if found := gathered(blobs, b"S", _RECORDS):
        some = np.flatnonzero(tk.repeated(found[0]) | (found[7] > 0))
        found = [c[some] for c in found]
        order = np.lexsort((found[3], found[4], found[2], found[1], found[0]))
        key, content, ids, tags, start, size, shift, many = (c[order] for c in found)
        if len(key):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
            at = np.flatnonzero(new)
            several = (np.diff(np.append(at, len(key))) > 1) | (np.add.reduceat(many.astype(np.int64), at) > 0)
            copies = np.zeros(len(key), np.int32)
            copies[at] = 1 + several
            out.append([ids, tags, start, size, shift, key, content, copies])
    if out:
        whole = [np.concatenate(c) for c in zip(*out, strict=True)]
        kinds = [np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64, np.int32]
        arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(t)) for c, t in zip(whole, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SEGMENTS.split(", ")])


def _asked(n_buckets: int, length: int):
    """The segments to be indexed, with their bytes, by anchor."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, size, shift, key, content, copies = flat_spans(batch.column(1), *range(6))
            key, content = key.view(np.uint64), content.view(np.uint64)
            for a, b, chunk in tk.chunks(batch.column(0), CHUNK_BYTES):
                mine = np.arange(*np.searchsorted(row, (a, b)))
                if not len(mine):
                    continue
                bucket = bucket_of(key[mine], n_buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                rows = []
                for x, y in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                    k = mine[order[x:y]]
                    at, wide = chunk.offsets[row[k] - a] + start[k], size[k] + length - 1
                    head = pack([key[k], content[k], size[k].astype(np.uint16), shift[k].astype(np.uint16), copies[k].astype(np.uint8)])
                    body = np.concatenate([chunk.data[p : p + w] for p, w in zip(at.tolist(), wide.tolist(), strict=True)]).tobytes()
                    rows.append((int(bucket[order[x]]), len(head).to_bytes(8, "little") + head + body))
                yield batch_of(rows)

    return mapper


class Collection:
    """The documents of one collection by column, in a file; a symbol is a byte plus one, 0 where a document has none."""

    def __init__(self, data: np.ndarray, first: np.ndarray, wide: np.ndarray, offset: np.ndarray, width: int) -> None:
        self.count, self.width = len(first), width
        self.folder = tempfile.TemporaryDirectory()  # a task's own scratch: lost and made anew with the task
        with open(f"{self.folder.name}/symbols", "wb") as f:
            f.truncate(2 * width * self.count)
        symbols = np.memmap(f"{self.folder.name}/symbols", np.uint16, "r+", shape=(width, self.count))
        step = max(1, COLLECTION_BYTES // width)
        for a in range(0, self.count, step):
            b = min(a + step, self.count)
            run = np.repeat(np.arange(b - a), wide[a:b])
            inner = np.arange(len(run)) - np.repeat(np.cumsum(wide[a:b]) - wide[a:b], wide[a:b])
            block = np.zeros((width, b - a), np.uint16)
            block[offset[a:b][run] + inner, run] = data[first[a:b][run] + inner].astype(np.uint16) + 1
            symbols[:, a:b] = block
        del symbols

    def columns(self) -> Iterator[np.ndarray]:
        """The columns from the last to the first."""
        with open(f"{self.folder.name}/symbols", "rb") as f:
            for column in range(self.width - 1, -1, -1):
                f.seek(2 * column * self.count)
                yield np.fromfile(f, np.uint16, self.count)

    def build(self) -> None:
        """Appends each round's transform, order and common prefixes to files."""
        order, common = np.arange(self.count, dtype=np.int32), np.zeros(self.count, np.int32)
        with open(f"{self.folder.name}/transform", "wb") as transform, open(f"{self.folder.name}/order", "wb") as orders, open(f"{self.folder.name}/prefixes", "wb") as prefixes:
            for column in self.columns():
                symbol = column[order]
                symbol.tofile(transform)
                sort = np.argsort(symbol, kind="stable")
                ranked = symbol[sort]
                same = np.flatnonzero((ranked[1:] == ranked[:-1]) & (ranked[1:] > 0)) + 1
                fresh = np.zeros(self.count, np.int32)
                fresh[same] = _range_minimum(common, sort[same - 1] + 1, sort[same]) + 1
                order, common = order[sort], fresh
                order.tofile(orders)
                common.tofile(prefixes)

    def index(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(column, transform, order, prefixes) of the rounds, in the order of building."""
        with open(f"{self.folder.name}/transform", "rb") as transform, open(f"{self.folder.name}/order", "rb") as orders, open(f"{self.folder.name}/prefixes", "rb") as prefixes:
            for column in range(self.width - 1, -1, -1):
                yield column, np.fromfile(transform, np.uint16, self.count), np.fromfile(orders, np.int32, self.count), np.fromfile(prefixes, np.int32, self.count)

    def repeats(self, length: int) -> Iterator[tuple[int, np.ndarray]]:
        """(column, mask of documents with a repeated window of `length` that starts there), from the last column to the first."""
        for column, _, order, common in self.index():
            if self.width - column >= length:
                hit = common >= length
                hit[:-1] |= hit[1:]
                mask = np.zeros(self.count, bool)
                mask[order] = hit
                yield column, mask

    def close(self) -> None:
        self.folder.cleanup()


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high] (inclusive) for each pair, by a table of doubling spans."""
    span = high - low + 1
    out = np.empty(len(low), values.dtype)
    table, size, left = values, 1, np.arange(len(low))
    while len(left):
        mine = left[span[left] < 2 * size]
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - size + 1])
        left = left[span[left] >= 2 * size]
        if len(left):
            table, size = np.minimum(table[:-size], table[size:]), size * 2
    return out


def _indexed(key, content, size, shift, copies, data, first, length: int, reach: int) -> pa.RecordBatch:
    """Runs of repeated starts of each document of one collection, as a row of RUNS."""
    twice = np.repeat(np.arange(len(key)), copies)
    collection = Collection(data, first[twice], (size + length - 1)[twice], (reach - shift)[twice], reach + length)
    collection.build()
    one = np.flatnonzero(np.diff(twice, prepend=-1))
    end, found = np.full(len(key), -1), []
    for column, mask in collection.repeats(length):
        inner = column - (reach - shift)
        hit = mask[one] & (inner >= 0) & (inner < size)
        done = np.flatnonzero((end >= 0) & ~hit)
        found.append((done, inner[done] + 1, end[done] - inner[done]))
        end[done] = -1
        fresh = hit & (end < 0)
        end[fresh] = inner[fresh]
    collection.close()
    done = np.flatnonzero(end >= 0)
    found.append((done, np.zeros(len(done), np.int64), end[done] + 1))
    document, inner, many = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(document, kind="stable")
    bounds = np.searchsorted(document[order], np.arange(len(key) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(inner[order].astype(np.int32)), pa.array(many[order].astype(np.int32))], names=["inner", "count"])
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(copies > 1), pa.ListArray.from_arrays(pa.array(bounds), runs)], names=["anchor", "content", "many", "runs"])


def _settle_columns(length: int, anchor: int):
    reach = length - anchor

    def reducer(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        heads, bodies = [], []
        while blobs:
            x = blobs.pop()
            end = 8 + int.from_bytes(x[:8], "little")
            heads.append(unpack(x[8:end], _ASKED))
            bodies.append(np.frombuffer(x, np.uint8, offset=end))
        key, content, size, shift, copies = (np.concatenate(c) for c in zip(*heads, strict=True))
        data = np.concatenate(bodies)
        bodies.clear()
        size, shift, copies = size.astype(np.int64), shift.astype(np.int64), copies.astype(np.int64)
        wide = size + length - 1
        first = np.cumsum(wide) - wide
        order = np.lexsort((content, key))
        weight = np.cumsum((wide * copies)[order])
        heads_at = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        a = 0
        while a < len(heads_at):
            before = weight[heads_at[a] - 1] if heads_at[a] else 0
            ends = weight[np.append(heads_at[a + 1 :], len(order)) - 1]
            b = a + max(1, int(np.searchsorted(ends, before + COLLECTION_BYTES, side="right")))
            k = order[heads_at[a] : heads_at[b] if b < len(heads_at) else len(order)]
            yield _indexed(key[k], content[k], size[k], shift[k], copies[k], data, first[k], length, reach)
            a = b

    return reducer


def _digest(length: int, texts: bool):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proof = ["anchor", "content", "digest"]
        for batch in batches:
            row, start, size, key, content, many = flat_spans(batch.column(2), 0, 1, 2, 3, 4)
            runs = batch.column(2).flatten().field(5)
            member, inner, counts = flat_spans(runs)
            for a, b, chunk in tk.chunks(batch.column(1), CHUNK_BYTES):
                mine = slice(*np.searchsorted(row, (a, b)))
                at = chunk.offsets[row[mine] - a] + start[mine]
                run = slice(*np.searchsorted(member, (mine.start, mine.stop)))
                gone = tk.cover(at[member[run] - mine.start] + inner[run], counts[run] + length - 1, len(chunk.data))
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                edge = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
                head[edge] = gone[edge]
                raw, total = chunk.data[~gone].tobytes(), np.concatenate(([0], np.cumsum(~gone)))[chunk.offsets].tolist()
                kept = [raw[x:y] for x, y in zip(total[:-1], total[1:], strict=True)]
                # what the segment really holds, once for each kind of it in the chunk
                copy = np.flatnonzero(many[mine])
                text, wide = chunk.data.tobytes(), size[mine] + length - 1
                seen = {(key[mine.start + k], content[mine.start + k], hashlib.blake2b(text[at[k] : at[k] + wide[k]], digest_size=16).digest()) for k in copy.tolist()}
                columns = list(zip(*sorted(seen), strict=True)) or [(), (), ()]
                proofs = pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=proof)
                bounds = np.full(b - a + 1, len(seen), np.int32)
                bounds[0] = 0  # with the chunk's first row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(np.diff(chunk.offsets)), pa.array(tk.per_document(gone, chunk.offsets)), pa.array(tk.per_document(head, chunk.offsets)),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.ListArray.from_arrays(pa.array(bounds), proofs), *([pa.array(kept, pa.binary())] if texts else []),
                    ],
                    names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "proofs", *(["kept"] if texts else [])],
                )

    return mapper


def _attempt(docs: DataFrame, key: list[str], length: int, anchor: int, family: int, bits: int, frequent, texts: bool) -> tuple[DataFrame, bool]:
    """The result by one choice of hash functions, and whether all segments taken for copies are."""
    n = bucket_count(docs)
    segments = tables.written(exchange(tables.with_tag(docs).select("_id", "_tag", "text"), _segments(n, length, anchor, frequent, family, bits), _settle_segments, SEGMENTS, n), "segments")
    asks = segments.where("copies > 0").groupBy(*key).agg(F.collect_list(F.struct("start", "size", "shift", "anchor", "content", "copies")).alias("asks"))
    runs = exchange(docs.join(asks, key).select("text", "asks"), _asked(n, length), _settle_columns(length, anchor), RUNS, n).where(F.size("runs") > 0)
    places = segments.join(runs, ["anchor", "content"]).groupBy(*key).agg(F.collect_list(F.struct("start", "size", "anchor", "content", F.col("many").cast("int").alias("many"), "runs")).alias("gone"))
    joined = docs.join(places, key, "left").select("_id", "text", "gone")
    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, proofs array<struct<anchor:long,content:long,digest:binary>>" + ", kept binary" * texts
    result = tables.written(joined.mapInArrow(_digest(length, texts), schema), "kept")
    proofs = result.select(F.explode("proofs").alias("p")).select("p.*").groupBy("anchor", "content")
    true = proofs.agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").isEmpty()
    tables.removed(segments)
    return result, true


def dedup_bytes(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, texts: bool = True, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if `texts`) kept (binary) of every row of `documents`.

    bits: bits of the first attempt's content hashes; fewer make collisions, for tests."""
    docs, key = tables.keyed(documents, "text")
    frequent = docs.sparkSession.sparkContext.broadcast(anchors.frequent_grams(docs, _grams(anchor)))
    for attempt in count():
        result, true = _attempt(docs, key, length, anchor, attempt + 1, 64 if attempt else bits, frequent, texts)
        if true:
            return result.select(tables.doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(tables.table(spark, sf_dir, "documents"), texts=False)


ORACLE = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b from documents
), starts as (
  select doc_id, b, unnest(range(0, greatest(octet_length(b) - 399, 0))) as s from d
), windows as (
  select doc_id, s, md5(b[s + 1 : s + 400]) as h from starts
), again as (
  select doc_id, s from (select doc_id, s, count(*) over (partition by h) as n from windows) where n > 1
), runs as (
  select doc_id, s, sum(fresh) over (partition by doc_id order by s) as run from (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 400 then 0 else 1 end as fresh from again)
), gone as (
  select doc_id, run, min(s) as a, max(s) + 400 as z from runs group by doc_id, run
), pieces as (
  select doc_id, a as place, lag(z, 1, 0) over (partition by doc_id order by a) as p, a as q from gone
  union all select doc_id, max(z), max(z), null from gone group by doc_id
), kept as (
  select doc_id, string_agg(hex(b[p + 1 : coalesce(q, octet_length(b))]), '' order by place, q nulls last) as k from pieces join d using (doc_id) group by doc_id
), counts as (select doc_id, count(*) as n_spans, sum(z - a) as n_removed from gone group by doc_id)
select doc_id, octet_length(b) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(case when k is null then b else unhex(k) end) as kept_sha256
from d left join counts using (doc_id) left join kept using (doc_id)
"""
