"""Benchmark decontamination with an FM-index per training shard.

A shard is a chunk of documents inside a task. Its words become the symbols of the benchmark's
vocabulary; words outside it become one separator, and stretches that cannot hold a phrase (no
run of benchmark word pairs as long as the shortest phrase) collapse into it, which loses no
occurrence. The shard's index is the Burrows-Wheeler transform of that sequence in a wavelet
matrix, with every `SAMPLE`-th suffix position kept. All phrases are searched backwards at once;
matching rows are walked to a sampled position, and the located word runs merge into removal
spans. Nothing is shuffled: a shard's answers concern its own documents only.

The benchmark is sent to the executors in blocks of at most `BLOCK_BYTES` of text, so the size of
a broadcast is bounded; with several blocks the spans of a document are merged afterwards.

Phrases are the windows of `window` words of each item; an item with fewer words, but not none,
is one phrase. Defined results: null texts have no words and are never contaminated; an item
without words is ignored; a null item_id counts as the text `null`; items that repeat an id count
once; repeated rows each return a row; an empty benchmark leaves every document clean; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from . import textkernel as tk

WINDOW, SHARE = 13, 20
SAMPLE = 8
CHUNK_BYTES = 2 << 20
#: Text of one benchmark block; its broadcast takes at most about five times as much.
BLOCK_BYTES = 2 << 20


class FMIndex:
    """FM-index of a sequence of symbols: 0 ends it, 1 separates, 2 and up are words."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        n = len(text)
        order = self._suffixes(text)
        bwt = text[order - 1]
        self.bwt, self.n, self.sample = bwt, n, sample
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 2))))
        self.levels = max(int(text.max()).bit_length(), 1)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            count = np.zeros(n + 1, np.int64)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(n - int(count[-1]))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        held = order % sample == 0
        self.held = held
        self.held_rank = np.concatenate(([0], np.cumsum(held)))
        self.held_at = order[held]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by doubling the compared length."""
        n, rank, step = len(text), np.unique(text, return_inverse=True)[1], 1  # dense, so a pair fits its key
        while True:
            key = rank * np.int64(n + 2)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key)
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
            step *= 2
            if step >= n or rank[order[-1]] == n - 1:
                return order

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each row."""
        low, high = np.zeros_like(at), at.copy()
        for i in range(self.levels):
            bit = (symbol >> (self.levels - 1 - i)) & 1
            a, b = self.ones[i][low], self.ones[i][high]
            low = np.where(bit, self.zeros[i] + a, low - a)
            high = np.where(bit, self.zeros[i] + b, high - b)
        return high - low

    def search(self, words: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase: the symbols words[start : start + length], searched from the last to the first."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n)
        top = len(self.smaller) - 2
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = words[start[live] + lengths[live] - 1 - step].astype(np.int64)
            known = symbol <= top
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.smaller[symbol] + self.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, live, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.held[at]
            out[live[done]] = self.held_at[self.held_rank[at[done]]] + steps
            live, at = live[~done], at[~done]
            symbol = self.bwt[at]
            at = self.smaller[symbol] + self.rank(symbol, at)
            steps += 1
        return out


class Phrases:
    """The searched phrases of one benchmark block, as places in the items' words; no phrase is spelled out."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.names = sorted({str(i) for i, _ in items})
        place = {x: k for k, x in enumerate(self.names)}
        chunk = next(iter(tk.chunks(pa.array([t for _, t in items], pa.string()), 1 << 62)), (0, 0, tk.Chunk(np.zeros(0, np.uint8), np.zeros(1, np.int64))))[2]
        data = tk.LOWER[chunk.data]
        begin, end, first = tk.spans(chunk, tk.NOT_ALNUM_LOWER, data)
        hashes, checks = (tk.word_hashes(data, begin, end, f) for f in (1, 2))
        self.vocabulary, one, code = np.unique(hashes, return_index=True, return_inverse=True)
        self.check = checks[one]
        self.words = (code + 2).astype(np.int32)
        counts = np.diff(first)
        number = np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0)
        item = np.repeat(np.arange(len(counts)), number)
        start = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number)
        length = np.minimum(counts[item], window)
        # phrases with the same words are one: by their length and 128 bits of hashes
        same = np.zeros((2, len(start)), np.uint64)
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            for f, h in enumerate((hashes, checks)):
                same[f, mine] = tk.windows(h, n, family=f + 1)[0][start[mine]] + np.uint64(n)
        order = np.lexsort((same[1], same[0]))
        new = np.concatenate(([True], (np.diff(same[:, order], axis=1) != 0).any(0)))[: len(order)]
        phrase = np.cumsum(new) - 1
        self.start, self.lengths, self.count = start[order][new].astype(np.int32), length[order][new].astype(np.int32), int(new.sum())
        owner = np.array([place[str(x)] for x, _ in items], np.int64)[item[order]] if len(items) else np.zeros(0, np.int64)
        pairs = np.unique(phrase * max(len(self.names), 1) + owner)
        self.items = (pairs % max(len(self.names), 1)).astype(np.int32)
        self.items_from = np.searchsorted(pairs // max(len(self.names), 1), np.arange(self.count + 1))
        self.shortest = int(self.lengths.min()) if self.count else 0
        next_to = np.ones(max(len(self.words) - 1, 0), bool)
        next_to[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(self.words))] - 1] = False
        self.pairs = np.unique((self.words[:-1].astype(np.int64) * self._base + self.words[1:])[next_to])
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @property
    def _base(self) -> int:
        return len(self.vocabulary) + 2

    def codes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Symbol of each word: 1 outside the vocabulary. A word is known if two independent hashes agree."""
        hashes, out = tk.word_hashes(data, begin, end), np.ones(len(begin), np.int64)
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), max(len(self.vocabulary) - 1, 0))
        hit = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(0, bool)
        maybe, at = maybe[hit], at[hit]
        real = tk.word_hashes(data, begin[maybe], end[maybe], 2) == self.check[at]
        out[maybe[real]] = at[real] + 2
        return out

    def sequence(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard's indexed sequence, and the word that each symbol came from."""
        n = len(codes)
        joined = np.zeros(n + 1, bool)
        inside = np.flatnonzero((codes[:-1] > 1) & (codes[1:] > 1)) if n > 1 else np.zeros(0, np.int64)
        pair = codes[inside] * self._base + codes[inside + 1]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        joined[inside[self.pairs[at] == pair] + 1 if len(self.pairs) else []] = True
        joined[first] = False
        head = np.flatnonzero((codes > 1) & ~joined[:n])
        size = np.diff(np.searchsorted(np.flatnonzero(codes > 1), np.append(head, n)))
        keep = size >= self.shortest
        head, size = head[keep], size[keep]
        word = np.repeat(head, size + 1) + np.arange((size + 1).sum()) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        text = codes[np.minimum(word, n - 1)] if n else word
        text[np.cumsum(size + 1) - 1] = 1
        return np.append(text, 0), word

    def occurrences(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence in the shard."""
        if not self.count:
            return (np.zeros(0, np.int64),) * 2
        text, word = self.sequence(codes, first)
        if len(text) == 1:
            return (np.zeros(0, np.int64),) * 2
        index = FMIndex(text)
        low, high = index.search(self.words, self.start, self.lengths)
        count = high - low
        phrase = np.repeat(np.arange(self.count), count)
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return word[index.locate(rows)], phrase


def _scan(block):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = block.value
        for batch in batches:
            for a, b, chunk in tk.chunks(batch.column(2), CHUNK_BYTES):
                data = tk.LOWER[chunk.data]
                begin, end, first = tk.spans(chunk, tk.NOT_ALNUM_LOWER, data)
                at, phrase = phrases.occurrences(phrases.codes(data, begin, end), first)
                hit = tk.cover(at, phrases.lengths[phrase], len(begin))
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                run, stop = edge[::2], edge[1::2]
                # a run may reach over the next document's first word only if both are hit
                bounds = np.union1d(run, first[1:-1][hit[np.minimum(first[1:-1], max(len(hit) - 1, 0))] & (first[1:-1] < len(hit))]) if len(run) else run
                stops = np.minimum(np.append(bounds[1:], len(hit)), stop[np.searchsorted(run, bounds, side="right") - 1]) if len(run) else stop
                owner = np.searchsorted(first, bounds, side="right") - 1
                start_list = np.searchsorted(owner, np.arange(len(chunk) + 1))
                doc = np.searchsorted(first, at, side="right") - 1
                size = np.diff(phrases.items_from)[phrase]
                item = phrases.items[np.repeat(phrases.items_from[:-1][phrase], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                pairs = np.unique(np.repeat(doc, size) * max(len(phrases.names), 1) + item)
                item_list = np.searchsorted(pairs // max(len(phrases.names), 1), np.arange(len(chunk) + 1))
                names = pa.array(phrases.names, pa.string()).take(pa.array(pairs % max(len(phrases.names), 1)))
                spans = pa.StructArray.from_arrays([pa.array((bounds - first[owner]).astype(np.int32)), pa.array((stops - bounds).astype(np.int32))], names=["start", "count"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(a, b - a) for k in (0, 1)),
                        pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(pa.array(start_list.astype(np.int32)), spans),
                        pa.ListArray.from_arrays(pa.array(item_list.astype(np.int32)), names),
                    ],
                    names=["_id", "_tag", "n_words", "spans", "items"],
                )

    return mapper


SCHEMA = "_id long, _tag long, n_words long, spans array<struct<start:int,count:int>>, items array<string>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the spans that several blocks found in a document."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            spans: list[dict] = []
            for x in sorted((s for part in r["spans"] for s in part), key=lambda s: s["start"]):
                if spans and x["start"] <= spans[-1]["start"] + spans[-1]["count"]:
                    spans[-1]["count"] = max(spans[-1]["count"], x["start"] + x["count"] - spans[-1]["start"])
                else:
                    spans.append(dict(x))
            r["spans"], r["items"] = spans, sorted({i for part in r["items"] for i in part})
        span = pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.list_(pa.string())]
        names = ["_id", "_tag", "n_words", "spans", "items"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names=names)


def _phrases(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Items as (item_id text, text), and the number of blocks that keeps each within `block_bytes`."""
    phrases = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    size = phrases.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return phrases, max(1, -(-size // block_bytes))


def _collected(part: DataFrame) -> list[tuple[str, str | None]]:
    return [(r["item_id"], r["text"]) for r in part.collect()]  # at most about a block of text


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """_id, _tag, n_words, spans (merged hit runs, in words), items of every row of `documents`."""
    docs, key = tables.keyed(documents, "text")
    docs = tables.with_tag(docs).select("_id", "_tag", "text")
    phrases, blocks = _phrases(benchmark, block_bytes)
    found = []
    for k in range(blocks):
        part = phrases.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else phrases
        found.append(docs.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(Phrases(_collected(part), window))), SCHEMA))
    if blocks == 1:
        return found[0]
    parts = found[0].select("_id", "_tag", "n_words", "spans", "items", F.lit(0).alias("k"))
    for k, x in enumerate(found[1:], 1):
        parts = parts.unionByName(x.withColumn("k", F.lit(k)))
    merged = parts.groupBy("_id", "_tag", "n_words").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
    merged = merged.mapInArrow(_merged, SCHEMA)
    whole = docs.select(*key) if key == ["_id", "_tag"] else docs.select("_id").withColumn("_tag", F.lit(0).cast("long"))
    return whole.join(merged, ["_id", "_tag"]).select("_id", "_tag", "n_words", "spans", "items")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (hit words are at least one in SHARE)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["count"])
    names = F.array_join(F.array_sort("items"), ",")
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(names, 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def _clean(block):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = block.value
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for _, _, chunk in tk.chunks(batch.column(batch.num_columns - 1), CHUNK_BYTES):
                data = tk.LOWER[chunk.data]
                begin, end, first = tk.spans(chunk, tk.NOT_ALNUM_LOWER, data)
                at, phrase = phrases.occurrences(phrases.codes(data, begin, end), first)
                n_hit = tk.per_document(tk.cover(at, phrases.lengths[phrase], len(begin)), first)
                keep.append((n_hit == 0) | (SHARE * n_hit < np.diff(first)))
            yield batch.select([0]).filter(pa.array(np.concatenate(keep)))

    return mapper


def clean(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `documents` that are not contaminated, with all columns.

    A benchmark of one block is searched as the rows pass, which moves no text; with several blocks the
    contaminated rows are found first and then taken away by their keys."""
    names = documents.columns
    phrases, blocks = _phrases(benchmark, block_bytes)
    if blocks == 1:
        rows = tables.whole(documents).select("_row", "text")
        block = documents.sparkSession.sparkContext.broadcast(Phrases(_collected(phrases)))
        return tables.unpacked(rows.mapInArrow(_clean(block), rows.select("_row").schema), names)
    rows, key = tables.keyed(tables.whole(documents), "_row", "text")
    bad = judged(contamination(documents, benchmark, block_bytes=block_bytes)).where("contaminated").select(*key).distinct()
    return tables.unpacked(rows.join(bad, key, "left_anti"), names)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = judged(contamination(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "benchmark")))
    return found.select(tables.doc_id(), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
with dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents
), bw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from benchmark
), phrases as (
  select distinct item_id, n, array_to_string(words[s + 1 : s + n], ' ') as p
  from (select item_id, words, least(13, len(words)) as n, unnest(range(0, greatest(len(words) - 13, 0) + 1)) as s from bw where len(words) > 0)
), sizes as (select distinct n from phrases
), windows as (
  select doc_id, n, s, array_to_string(words[s + 1 : s + n], ' ') as p
  from (select doc_id, words, n, unnest(range(0, greatest(len(words) - n + 1, 0))) as s from dw, sizes)
), hits as (select doc_id, s, n, item_id from windows join phrases using (n, p)
), hit as (select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(s, s + n)) as w from (select distinct doc_id, s, n from hits)) group by doc_id
), items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from dw left join hit using (doc_id) left join items using (doc_id)
"""
