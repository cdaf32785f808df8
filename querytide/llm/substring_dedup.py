"""Substring deduplication over a compacted De Bruijn graph of token k-mers.

The edges of the graph are the windows of `window` words; two edges that follow each other share a
node, the words between. Only repeated edges matter, and they are found as compaction by minimizers
finds them: every edge is dealt to the bucket of the smallest k-mer inside it (frequent k-mers last,
see `anchors`), and consecutive edges of a document with one minimizer travel as one record.

1. Edges. In a bucket, records with equal words are occurrences of one piece; each but the first
   claims to repeat the first, whose source coordinates it notes. Where one minimizer has several
   different records the graph may branch inside them: their edges are fetched by source coordinates
   and compared one by one in a second, smaller shuffle, which gives shorter pieces.
2. Compaction, in Spark joins. Pieces that follow each other in documents are linked. A piece with
   one successor that has one predecessor is nonbranching; pointer doubling joins such pieces into
   paths, and a document's claims that run along one path become one long span.
3. Verification by source coordinates. The words of every long span and of the place it claims to
   repeat are read again, and compared by a 128-bit digest over an independent hash family. If any
   claim is false, all is done again with other hash functions, so no collision reaches the result.
4. The spans of a document are merged and cut from the text.

Edges that repeat inside a chunk of documents are settled in the chunk, word for word, so a passage
that fills a third of the corpus sends one record per chunk.

Defined results: a null text has no words. A document shorter than the window keeps everything.
Windows are judged on the input. Rows that share a doc_id count as one document for "earlier";
equal rows give equal results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import anchors, tables
from . import textkernel as tk
from .exchange import batch_of, bucket_count, bucket_of, deal, exchange, unpack

WINDOW, KMER = 20, 6
CHUNK_BYTES = 1 << 20
#: Kinds of spans: settled in the chunk, asked for edge by edge, claimed, and proof of a collision.
LOCAL, ASK, CLAIM, COLLISION = range(4)
SPANS = "kind byte, _id long, _tag long, start int, count int, src long, src_tag long, src_start int, piece long"
_NAMES = [x.split()[0] for x in SPANS.split(", ")]
_RECORDS = ["u8", "u8", "i8", "i8", "u4", "u2"]
_LOCALS = ["i8", "i8", "u4", "u4", "u1"]


def ranked(ids: np.ndarray) -> np.ndarray:
    """Dense rank of sorted ids."""
    return np.cumsum(np.diff(ids, prepend=ids[:1]) != 0) if len(ids) else np.zeros(0, np.int64)


def first_of(key: np.ndarray, coordinate: np.ndarray) -> np.ndarray:
    """For each record the record of the same key with the smallest coordinate."""
    out = np.arange(len(key))
    some = np.flatnonzero(tk.repeated(key))
    if len(some):
        order = some[np.lexsort((coordinate[some], key[some]))]
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def sorted_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch in the order of _id, so that positions in a chunk follow coordinates."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    return batch if (np.diff(ids) >= 0).all() else batch.take(pa.array(np.argsort(ids, kind="stable")))


def runs_of(index: np.ndarray, *same: np.ndarray, step: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """First entries and lengths of the runs in which `index` and each of `step` rise by one and each of `same` stays."""
    if not len(index):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.diff(index) != 1
    for x in step:
        new |= np.diff(x) != 1
    for x in same:
        new |= x[1:] != x[:-1]
    cut = np.flatnonzero(np.concatenate(([True], new)))
    return cut, np.diff(np.append(cut, len(index)))


def expanded(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs (start, count): the run of each member, and the member."""
    run = np.repeat(np.arange(len(start)), count)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + start[run]


def _kmers(kmer: int):
    def grams_of(chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        begin, end, first = tk.spans(chunk, tk.WHITE)
        (grams,) = tk.windows(tk.word_hashes(chunk.data, begin, end), kmer)
        valid = tk.window_valid(first, len(begin), kmer)[: len(grams)]
        return grams[valid], np.repeat(np.arange(len(chunk)), np.diff(first))[: len(grams)][valid]

    return grams_of


class Hashing:
    """The hash functions of one attempt; `bits` weakens them in tests."""

    def __init__(self, attempt: int = 0, bits: int = 64) -> None:
        self.family, self.check = 2 * attempt + 1, 2 * attempt + 2
        self.mask = np.uint64((1 << bits) - 1)

    def windows(self, chunk: tk.Chunk, begin: np.ndarray, end: np.ndarray, *sizes: int) -> list[np.ndarray]:
        *grams, edges = tk.windows(tk.word_hashes(chunk.data, begin, end, self.family), *sizes, family=self.family)
        return [*grams, edges & self.mask]

    def piece(self, first: np.ndarray, last: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of a run of edges; its first and last edge hold all its words, as a run is shorter than an edge."""
        return tk.joined(tk.joined(first, last), length.astype(np.uint64)) & self.mask


def _settled(chunk, begin, end, index, lead, ids, tags, doc, start, window, n) -> list[tuple[int, bytes]]:
    """Blobs of the edges that repeat an earlier one of the chunk, compared word for word."""
    cut, length = runs_of(index, step=(lead,))
    run, at = expanded(np.zeros(len(cut), np.int64), length + window - 1)
    same = tk.same_words(chunk.data, begin, end, index[cut][run] + at, lead[cut][run] + at)
    false = np.bincount(run[~same], minlength=len(cut)) > 0
    k = doc[cut]
    columns = [ids[k], tags[k], start[cut].astype(np.uint32), length.astype(np.uint32), false.astype(np.uint8)]
    return [(b, b"L" + x) for b, x in deal(bucket_of(tk.mix64(ids[k].astype(np.uint64)), n), columns)]


def _pieces(n_buckets: int, window: int, kmer: int, frequent, hashing: Hashing):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = sorted_rows(whole)
            all_ids, all_tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, chunk in tk.chunks(batch.column(2), CHUNK_BYTES):
                rows = _chunk_pieces(chunk, all_ids[a:b], all_tags[a:b], n_buckets, window, kmer, frequent.value, hashing)
                if rows:
                    yield batch_of(rows)

    return mapper


def _chunk_pieces(chunk, ids, tags, n_buckets, window, kmer, frequent, hashing) -> list[tuple[int, bytes]]:
    begin, end, first = tk.spans(chunk, tk.WHITE)
    n = len(begin)
    index = np.flatnonzero(tk.window_valid(first, n, window)[: max(n - window + 1, 0)])
    if not len(index):
        return []
    grams, edges = hashing.windows(chunk, begin, end, kmer, window)
    doc = np.repeat(np.arange(len(ids)), np.diff(first))[index]
    start = index - first[doc]
    coordinate = (ranked(ids)[doc] << 32) | start
    lead = first_of(edges[index], coordinate)
    again = coordinate[lead] < coordinate
    place = anchors.positions(grams, window - kmer + 1, frequent)[index]
    cut, length = runs_of(index, place)
    new = np.add.reduceat((~again).astype(np.int64), cut) > 0
    cut, length = cut[new], length[new]
    piece = hashing.piece(edges[index[cut]], edges[index[cut] + length - 1], length)
    mini = grams[place[cut]]
    columns = [mini, piece, ids[doc[cut]], tags[doc[cut]], start[cut].astype(np.uint32), length.astype(np.uint16)]
    rows = [(b, b"P" + x) for b, x in deal(bucket_of(mini, n_buckets), columns)]
    gone = np.flatnonzero(again)
    if len(gone):
        rows += _settled(chunk, begin, end, index[gone], index[lead[gone]], ids, tags, doc[gone], start[gone], window, n_buckets)
    return rows


def _batch(groups: list[tuple]) -> pa.RecordBatch:
    """Rows of SPANS from groups of its columns; a number stands for a whole column."""
    kinds = [np.int8, np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int32, np.uint64]
    # each column has its own type before they are joined: numpy would make doubles of signed and unsigned ones
    full = [[np.broadcast_to(np.asarray(c).astype(t), len(g[1])) for c, t in zip(g, kinds, strict=True)] for g in groups]
    arrays = [np.concatenate([g[i] for g in full]) for i in range(len(kinds))]
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays], names=_NAMES)


def gathered(blobs: list[bytes], kind: bytes, dtypes: list[str]) -> list[np.ndarray] | None:
    parts = [unpack(x[1:], dtypes) for x in blobs if x[:1] == kind]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else None


def _locals(blobs: list[bytes]) -> list[tuple]:
    if local := gathered(blobs, b"L", _LOCALS):
        ids, tags, start, length, false = local
        return [(np.where(false, COLLISION, LOCAL), ids, tags, start, length, 0, 0, 0, 0)]
    return []


def _equal(*columns: np.ndarray) -> np.ndarray:
    """Mask of the sorted records that begin a group of equal `columns`."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _settle_pieces(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    out = _locals(blobs)
    if found := gathered(blobs, b"P", _RECORDS):
        some = np.flatnonzero(tk.repeated(found[0]))
        found = [c[some] for c in found]
        mini, piece, ids, tags, start, length = found
        order = np.lexsort((tags, start, ids, piece, mini))
        mini, piece, ids, tags, start, length = (c[order] for c in found)
        if len(mini):
            new_mini, new = _equal(mini), _equal(mini, piece, length)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(mini)), 0))
            later = (ids != ids[lead]) | (start != start[lead])
            group = np.cumsum(new_mini) - 1
            ask = (np.bincount(group, weights=new)[group] > 1) & ~later
            out.append((CLAIM, ids[later], tags[later], start[later], length[later], ids[lead][later], tags[lead][later], start[lead][later], piece[later]))
            out.append((ASK, ids[ask], tags[ask], start[ask], length[ask], 0, 0, 0, mini[ask]))
    if out:
        yield _batch(out)


def flat_spans(column: pa.Array, *fields: int) -> tuple[np.ndarray, ...]:
    """Row, then the given fields (the first two), of every entry of an array<struct> column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0))
    entries = column.flatten()
    return np.repeat(np.arange(len(column)), size), *(np.asarray(entries.field(k)).astype(np.int64) for k in fields or (0, 1))


def _edges(n_buckets: int, window: int, hashing: Hashing):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = sorted_rows(whole)
            all_ids, all_tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            row, ask_start, ask_count, ask_mini = flat_spans(batch.column(3), 0, 1, 2)
            for a, b, chunk in tk.chunks(batch.column(2), CHUNK_BYTES):
                begin, end, first = tk.spans(chunk, tk.WHITE)
                mine = slice(*np.searchsorted(row, (a, b)))
                run, start = expanded(ask_start[mine], ask_count[mine])
                if not len(run):
                    continue
                doc, mini = (row[mine] - a)[run], ask_mini[mine][run].view(np.uint64)
                index, ids, tags = first[doc] + start, all_ids[a:b], all_tags[a:b]
                edge = hashing.windows(chunk, begin, end, window)[0][index]
                coordinate = (ranked(ids)[doc] << 32) | start
                lead = first_of(edge, coordinate)
                again = coordinate[lead] < coordinate
                new = ~again
                columns = [mini[new], edge[new], ids[doc[new]], tags[doc[new]], start[new].astype(np.uint32)]
                rows = [(k, b"E" + x) for k, x in deal(bucket_of(mini[new], n_buckets), columns)]
                if again.any():
                    gone = np.flatnonzero(again)
                    gone = gone[np.argsort(index[gone], kind="stable")]
                    rows += _settled(chunk, begin, end, index[gone], index[lead[gone]], ids, tags, doc[gone], start[gone], window, n_buckets)
                if rows:
                    yield batch_of(rows)

    return mapper


def _settle_edges(hashing: Hashing):
    def reducer(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        out = _locals(blobs)
        if edges := gathered(blobs, b"E", _RECORDS[:5]):
            some = np.flatnonzero(tk.repeated(edges[1]))
            edges = [c[some] for c in edges]
            order = np.lexsort((edges[3], edges[4], edges[2], edges[1], edges[0]))
            mini, edge, ids, tags, start = (c[order] for c in edges)
            new = _equal(mini, edge)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(mini)), 0))
            later = np.flatnonzero((ids != ids[lead]) | (start != start[lead]))
            later = later[np.lexsort((start[later], tags[later], ids[later], mini[later]))]
            lead = lead[later]
            mini, edge, at = mini[later], edge[later], start[later].astype(np.int64)
            source = [ids[lead], tags[lead], start[lead].astype(np.int64)]
            cut, length = runs_of(at, mini, ids[later], tags[later], *source[:2], step=(source[2],))
            k = later[cut]
            out.append((CLAIM, ids[k], tags[k], at[cut], length, *(c[cut] for c in source), hashing.piece(edge[cut], edge[cut + length - 1], length)))
        if out:
            yield _batch(out)

    return reducer


def paths(steps: DataFrame) -> DataFrame:
    """piece, path, offset of the pieces that follow another one without branching.

    steps: piece, count (its edges) and next, a row for each place where `next` follows `piece`."""
    steps = tables.written(steps.distinct(), "steps")
    one_next = steps.groupBy("piece", "count").agg(F.count("*").alias("n"), F.min("next").alias("next")).where("n = 1").drop("n")
    one_before = steps.groupBy("next").agg(F.count("*").alias("n"), F.min("piece").alias("piece")).where("n = 1").select("piece", "next")
    links = one_next.where("piece <> next").join(one_before, ["piece", "next"])
    state = tables.written(links.select(F.col("next").alias("piece"), F.col("piece").alias("path"), F.col("count").cast("long").alias("offset"), F.lit(True).alias("moved")), "links")
    tables.removed(steps)
    before = None
    while True:  # pointers double; those of a circle never arrive, and are all that is left when the number of moves stays
        up = state.select(F.col("piece").alias("path"), F.col("path").alias("up"), F.col("offset").alias("more"))
        next_state = tables.written(
            state.join(up, "path", "left").select("piece", F.coalesce("up", "path").alias("path"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("up").isNotNull().alias("moved")), "paths"
        )
        tables.removed(state)
        state, moves = next_state, next_state.where("moved").count()
        if moves in (0, before):
            return state.where("not moved").select("piece", "path", "offset")
        before = moves


def long_spans(claims: DataFrame) -> DataFrame:
    """_id, _tag, start, count, src, src_tag, src_start: claims that run along one path and one source become one."""
    document = W.partitionBy("_id", "_tag").orderBy("start")
    follows = F.lead("start").over(document) == F.col("start") + F.col("count")
    steps = claims.select("piece", "count", F.when(follows, F.lead("piece").over(document)).alias("next")).where("next is not null")
    labelled = claims.join(paths(steps), "piece", "left").withColumn("path", F.coalesce("path", "piece")).withColumn("offset", F.coalesce("offset", F.lit(0)))
    goes_on = F.lit(True)
    for c in ("path", "src", "src_tag"):
        goes_on = goes_on & (F.lag(c).over(document) == F.col(c))
    for c in ("start", "offset", "src_start"):
        goes_on = goes_on & (F.lag(c).over(document) + F.lag("count").over(document) == F.col(c))
    marked = labelled.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(document.rowsBetween(W.unboundedPreceding, 0)))
    first = [F.min(c).alias(c) for c in ("start", "src", "src_tag", "src_start")]
    return marked.groupBy("_id", "_tag", "run").agg(*first, F.sum("count").cast("int").alias("count")).drop("run")


def _digest(window: int, check: int, texts: bool):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proof = pa.list_(pa.struct([("src", pa.int64()), ("src_tag", pa.int64()), ("src_start", pa.int32()), ("count", pa.int32()), ("digest", pa.binary())]))
        for batch in batches:
            row, start, size, source, gone = flat_spans(batch.column(2), 0, 1, 2, 3)
            jobs = batch.column(2).flatten()
            for a, b, chunk in tk.chunks(batch.column(1), CHUNK_BYTES):
                begin, end, first = tk.spans(chunk, tk.WHITE)
                mine = slice(*np.searchsorted(row, (a, b)))
                head, wide, cut = first[row[mine] - a] + start[mine], size[mine] + window - 1, gone[mine] > 0
                mask = tk.cover(head[cut], wide[cut], len(begin))
                data, offsets = tk.kept_words(chunk, begin, end, first, ~mask)
                raw = data.tobytes()
                kept = [raw[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                # words of claimed spans and of their sources, by an independent hash
                asked = np.flatnonzero(source[mine])
                hashes = tk.word_hashes(chunk.data, begin, end, check) if len(asked) else np.zeros(0, np.uint64)
                digests = [hashlib.blake2b(hashes[x : x + w].tobytes(), digest_size=16).digest() for x, w in zip(head[asked].tolist(), wide[asked].tolist(), strict=True)]
                pick = jobs.take(pa.array(asked + mine.start))
                proofs = pa.StructArray.from_arrays([pick.field("src"), pick.field("src_tag"), pick.field("src_start"), pick.field("count"), pa.array(digests, pa.binary())], names=[f.name for f in proof.value_type])
                bounds = np.searchsorted(row[mine][asked], np.arange(a, b + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(tk.per_document(mask, first)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                        pa.ListArray.from_arrays(pa.array(bounds), proofs), *([pa.array(kept, pa.binary()).cast(pa.string())] if texts else []),
                    ],
                    names=["_id", "n_words", "n_removed", "kept_sha256", "proofs", *(["kept_text"] if texts else [])],
                )

    return mapper


def _attempt(docs: DataFrame, key: list[str], window: int, kmer: int, hashing: Hashing, frequent, texts: bool) -> tuple[DataFrame, bool]:
    """The result by one choice of hash functions, and whether every claim in it was true."""
    n = bucket_count(docs)
    found = tables.written(exchange(tables.with_tag(docs).select("_id", "_tag", "text"), _pieces(n, window, kmer, frequent, hashing), _settle_pieces, SPANS, n), "pieces")
    asks = found.where(F.col("kind") == ASK).groupBy(*key).agg(F.collect_list(F.struct("start", "count", "piece")).alias("asks"))
    branching = tables.with_tag(docs.join(asks, key)).select("_id", "_tag", "text", "asks")
    later = tables.written(exchange(branching, _edges(n, window, hashing), _settle_edges(hashing), SPANS, n), "edges")
    spans = found.where(F.col("kind") != ASK).unionByName(later)
    claims = tables.written(long_spans(spans.where(F.col("kind") == CLAIM).drop("kind")), "claims")
    none = F.lit(0)
    job = lambda *columns: F.struct(*[c.cast(t).alias(x) for c, (x, t) in zip(columns, _JOB, strict=True)]).alias("job")
    col = F.col
    jobs = spans.where(F.col("kind") == LOCAL).select("_id", "_tag", job(col("start"), col("count"), none, F.lit(1), none, none, none))
    jobs = jobs.unionByName(claims.select("_id", "_tag", job(col("start"), col("count"), F.lit(1), F.lit(1), col("src"), col("src_tag"), col("src_start"))))
    sources = claims.select("src", "src_tag", "src_start", "count").distinct()
    jobs = jobs.unionByName(sources.select(col("src").alias("_id"), col("src_tag").alias("_tag"), job(col("src_start"), col("count"), F.lit(1), none, col("src"), col("src_tag"), col("src_start"))))
    joined = docs.join(jobs.groupBy(*key).agg(F.collect_list("job").alias("jobs")), key, "left").select("_id", "text", "jobs")
    schema = "_id long, n_words long, n_removed long, kept_sha256 string, proofs array<struct<src:long,src_tag:long,src_start:int,count:int,digest:binary>>" + ", kept_text string" * texts
    result = tables.written(joined.mapInArrow(_digest(window, hashing.check, texts), schema), "kept")
    proofs = result.select(F.explode("proofs").alias("p")).select("p.*").groupBy("src", "src_tag", "src_start", "count")
    false = proofs.agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    true = false.isEmpty() and spans.where(F.col("kind") == COLLISION).isEmpty()
    for df in (found, later, claims):
        tables.removed(df)
    return result, true


_JOB = [("start", "int"), ("count", "int"), ("source", "int"), ("gone", "int"), ("src", "long"), ("src_tag", "long"), ("src_start", "int")]


def dedup_substrings(documents: DataFrame, window: int = WINDOW, kmer: int = KMER, texts: bool = True, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (if `texts`) kept_text of every row of `documents`.

    bits: bits of the first attempt's hashes; fewer make collisions, for tests."""
    docs, key = tables.keyed(documents, "text")
    frequent = docs.sparkSession.sparkContext.broadcast(anchors.frequent_grams(docs, _kmers(kmer)))
    for attempt in count():
        result, true = _attempt(docs, key, window, kmer, Hashing(attempt, 64 if attempt else bits), frequent, texts)
        if true:
            return result.select(tables.doc_id(), "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(tables.table(spark, sf_dir, "documents"), texts=False)


ORACLE = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), starts as (
  select doc_id, words, unnest(range(0, greatest(len(words) - 19, 0))) as s from w
), windows as (
  select doc_id, s, md5(array_to_string(words[s + 1 : s + 20], ' ')) as h from starts
), again as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by h order by doc_id, s) as n from windows) where n > 1
), gone as (
  select doc_id, list(distinct p) as ps from (select doc_id, unnest(range(s + 1, s + 21)) as p from again) group by doc_id
), kept as (
  select w.doc_id, len(words) as n_words, coalesce(len(ps), 0) as n_removed,
         list_filter(words, lambda x, i: not list_contains(coalesce(ps, []), i)) as k
  from w left join gone using (doc_id)
)
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""
