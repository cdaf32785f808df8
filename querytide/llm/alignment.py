"""Alignment of two tokenizers' tokens over a corpus, by distinct segments.

1. Splitting. A byte of white space is a safe cut if no entry of either vocabulary holds it after a byte that is
   no white space: no merge can then join its two sides. It is checked against the vocabularies given.
   Texts are cut before runs of white space that begin with a safe byte. In each chunk of texts the
   distinct segments are numbered, and texts are kept as numbers.
2. Aligning. A chunk sends its distinct segments to buckets by hash. A bucket holds all copies of its
   segments, so each distinct segment of the corpus is tokenised by both tokenizers and aligned
   once: an elementary interval between consecutive token ends is one link of an A and a B token, and
   ends that both share close a group.
3. Counting. A bucket's pairs of ids, weighted by the segments' occurrences, are summed over the corpus and
   joined back to the bucket, which gives each segment its number of best links and its sum of counts.
4. Composing. Each chunk gets its segments' results back, in the order it sent them, and adds them up by text.

A hot segment has one entry per chunk, a hot pair one row per bucket. Chunks and buckets are bounded in
bytes, but for a text beyond the size of a chunk, which is one alone. Both tokenizers go to the tasks
as bytes: 2 MB for the files given, 64 MB allowed.

Defined results: null and empty texts, texts with U+2581 (which B reads as a space) and texts that are no valid
UTF-8 have no tokens: zeros and ''. Rows that share a doc_id are texts of their own; a null doc_id
stays null. An empty table gives no rows. Other columns are ignored. A tokenizer that changes text
in another way is refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables
from . import textkernel as tk
from .exchange import bucket_count, pack, unpack

#: Folder of the vocabulary files where the session names none in SETTING.
FOLDER, SETTING = "/opt/tokenizers", "spark.querytide.tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MOST_BYTES = 64 << 20
CHUNK_BYTES = 12 << 20
#: Segments that are tokenised together.
SLICE = 20_000
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
PARTS = "chunk long, bucket int, blob binary, ids array<long>, n array<int>"
ALIGNED = "bucket int, chunks binary, refs binary, stats binary, groups binary, links binary, pairs binary"
_SPACES = b" \t\n\x0b\x0c\r"
#: White space characters, and which bytes are one.
_CHARACTERS = tuple(chr(c).encode() for c in range(0x3001) if chr(c).isspace())
_WHITE = np.zeros(256, bool)
_WHITE[[*_SPACES, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of their entries by id."""

    def __init__(self, a: bytes, b: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        symbols = byte_symbols()
        vocabulary = json.loads(a)["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            if all(c in symbols for c in entry):
                self.bytes_a[i] = bytes(symbols[c] for c in entry)
        fallback = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        self.bytes_b = [fallback(i) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.space = [self.b.piece_to_id("▁")]
        self.entries_a, self.entries_b = pa.array(self.bytes_a, pa.large_binary()), pa.array(self.bytes_b, pa.large_binary())
        self.length_a, self.length_b = (np.array([len(x) for x in entries]) for entries in (self.bytes_a, self.bytes_b))

    def cuts(self) -> bytes:
        """White space before which both vocabularies allow a cut; the space must be alone in B to be put before other cuts and dropped again."""
        unsafe = {e[i] for e in {*self.bytes_a, *self.bytes_b} for i in range(1, len(e)) if e[i] in _SPACES and not e[:i].endswith(_CHARACTERS)}
        unsafe |= {e[i] for e in self.bytes_b for i in range(1, len(e)) if e[i] in _SPACES and e[i] != 32 and e[i - 1] == 32}
        return bytes(x for x in _SPACES if x not in unsafe)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, and their number for each of `texts`, then the same of B; a text's own first space is the one that B adds."""
        a = [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        b = self.b.encode([x[1:] if x[0] == " " else x for x in texts], num_threads=1)
        b = [(y or self.space) if x[0] == " " else y[1:] for x, y in zip(texts, b, strict=True)]
        flat = lambda ids: (np.fromiter((i for x in ids for i in x), np.int64), np.array([len(x) for x in ids], np.int64))
        return *flat(a), *flat(b)


@lru_cache(1)
def tokenizers(a: bytes, b: bytes) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizers(a, b)


def files(spark: SparkSession, folder: str | None = None) -> tuple[bytes, bytes]:
    folder = folder or spark.conf.get(SETTING, FOLDER)
    found = []
    for name in (FILE_A, FILE_B):
        with open(os.path.join(folder, name), "rb") as f:
            found.append(f.read(MOST_BYTES + 1))
        if len(found[-1]) > MOST_BYTES:
            raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
    return found[0], found[1]


def fit(texts: pa.Array) -> np.ndarray:
    """Mask of the texts that have tokens."""
    valid = pc.and_(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False), pc.invert(pc.fill_null(pc.match_substring(texts, "▁"), True))).to_numpy(zero_copy_only=False)
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        for i, x in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            try:
                (x or b"").decode()
            except UnicodeDecodeError:
                valid[i] = False
    return valid


def segments(texts: pa.Array, cuts: bytes) -> tuple[pa.Array, np.ndarray]:
    """Segments of space + text for each of the valid `texts`, and their number in each."""
    data, offsets = tk.text_buffers(texts)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    data = np.insert(data, offsets[:-1], 32)
    offsets = offsets + np.arange(len(offsets))
    safe = np.zeros(256, bool)
    safe[[*cuts]] = True
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), data[:-k]]) if len(data) > k else np.zeros(len(data), np.uint8) for k in (1, 2, 3))
    at = np.flatnonzero(safe[data] & ~_WHITE[one])
    p, q, r = one[at], two[at], three[at]
    # U+0085 U+00A0; U+1680; U+2000 to U+200A, U+2028, U+2029, U+202F; U+205F; U+3000
    white = ((q == 0xC2) & ((p == 0x85) | (p == 0xA0))) | ((r == 0xE1) & (q == 0x9A) & (p == 0x80)) | ((r == 0xE3) & (q == 0x80) & (p == 0x80)) | ((r == 0xE2) & (q == 0x81) & (p == 0x9F))
    white |= (r == 0xE2) & (q == 0x80) & ((p <= 0x8A) | (p == 0xA8) | (p == 0xA9) | (p == 0xAF))
    start = np.union1d(at[~white], offsets[:-1])
    ends = np.append(start[1:], len(data)).astype(np.int64)
    number = np.diff(np.searchsorted(start, offsets))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data)]), number


def strings(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths and bytes of a large binary or string column."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets), bytes(memoryview(buffers[2])[int(offsets[0]) : int(offsets[-1])]) if len(column) and buffers[2] else b""


def array_of(length: np.ndarray, raw: bytes, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return pa.Array.from_buffers(kind, len(length), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def parts(docs: DataFrame, cuts: bytes, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """PARTS of (doc_id, text): for each chunk one row (bucket -1) with its ids, segments of each text and their numbers, and one for each bucket with its distinct segments and their occurrences."""

    def rows(chunk: int, ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        valid = fit(texts)
        found, number = segments(texts.filter(pa.array(valid)), cuts) if valid.any() else (pa.array([], pa.large_binary()), np.zeros(0, np.int64))
        coded = found.dictionary_encode()
        refs, words = coded.indices.to_numpy(), coded.dictionary
        length, raw = strings(words)
        start = np.cumsum(length) - length
        bucket = (tk.word_hashes(np.frombuffer(raw, np.uint8), start, start + length) % np.uint64(buckets)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(refs, minlength=len(words))
        # texts as ranks by frequency, whose high bytes are mostly 0, and the place of each rank among what is sent
        place, rank, ranked = np.empty(len(order), np.int32), np.empty(len(order), np.int32), np.argsort(-count, kind="stable")
        place[order] = rank[ranked] = np.arange(len(order))
        n = np.zeros(len(ids), np.int32)
        n[valid] = number
        yield chunk, -1, squeezed(pack([place[ranked]]) + pack([rank[refs]])), ids.to_pylist(), n.tolist()
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(order) else []
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            size, held = strings(words.take(pa.array(order[a:b])))
            yield chunk, int(bucket[order[a]]), squeezed(pack([size.astype(np.uint32), count[order[a:b]].astype(np.uint32)]) + held), None, None

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            texts, ids = table.column(1).combine_chunks().cast(pa.large_string()), table.column(0).combine_chunks()
            for first, last, _ in tk.chunks(texts, chunk_bytes):
                found = list(rows(number, ids[first:last], texts[first:last]))
                number += 1
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                for at in range(0, len(found), 64):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found[at : at + 64]], t) for i, t in enumerate(kinds)], names=["chunk", "bucket", "blob", "ids", "n"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= chunk_bytes:
                yield from flushed()
                held, size = [], 0
        if held:
            yield from flushed()

    tables.small_batches(docs.sparkSession)
    return tables.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(mapper, PARTS), "parts")


def aligned_slice(both: Tokenizers, raw: bytes, length: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(n_a, n_b, n_groups, n_links) by segment, the text of its groups, and the pairs a << 32 | b of all links in order."""
    start = np.cumsum(length) - length
    texts = [raw[a : a + n].decode() for a, n in zip(start.tolist(), length.tolist(), strict=True)]
    a, n_a, b, n_b = both.encode(texts)
    for ids, n, entries, size in ((a, n_a, both.entries_a, both.length_a), (b, n_b, both.entries_b, both.length_b)):
        stop = np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum(n)]
        if not np.array_equal(stop, np.cumsum(length)) or strings(entries.take(pa.array(ids)))[1] != raw:
            raise ValueError("a tokenizer changes the text of segments, so that its tokens cannot be aligned")
    end_a, end_b = np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b])
    common, every = np.intersect1d(end_a, end_b, assume_unique=True), np.union1d(end_a, end_b)
    pairs = (a[np.searchsorted(end_a, every)] << 32) | b[np.searchsorted(end_b, every)]
    stop = np.cumsum(length)
    n_groups, n_links = (np.diff(np.searchsorted(x, stop, side="right"), prepend=0) for x in (common, every))
    sides = []
    for ids, end in ((a, end_a), (b, end_b)):
        group = np.searchsorted(end, common, side="right")
        sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], group]), pa.int32()), pc.cast(pa.array(ids), pa.string())), ","))
    joined = pc.binary_join_element_wise(*sides, "|")
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32()), joined), ";")
    return np.stack([n_a, n_b, n_groups, n_links]), groups.cast(pa.large_string()), pairs


def aligned(chunks: DataFrame, both: tuple[bytes, bytes]) -> DataFrame:
    """ALIGNED: for each bucket its chunks with their numbers of segments, the segment of each, and by distinct segment the alignment; written."""

    def bucket(table: pa.Table) -> pa.Table:
        chunk, blobs = table["chunk"].to_numpy(), table["blob"].to_pylist()
        order = np.argsort(chunk)
        lengths, counts, raws = [], [], []
        for x in (opened(blobs[i]) for i in order.tolist()):
            size, count = unpack(x, ["u4", "u4"])
            lengths.append(size.astype(np.int64))
            counts.append(count.astype(np.int64))
            raws.append(x[8 + 8 * len(size) :])
        coded = array_of(np.concatenate(lengths), b"".join(raws), pa.large_binary()).dictionary_encode()
        refs = coded.indices.to_numpy()
        weight = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(weight, refs, np.concatenate(counts))
        stats, groups, links = [], [], []
        for at in range(0, len(weight), SLICE):
            length, raw = strings(coded.dictionary.slice(at, SLICE))
            s, g, p = aligned_slice(tokenizers(*both), raw, length)
            stats.append(s)
            groups.append(g)
            links.append(p)
        stats, links = np.concatenate(stats, axis=1), np.concatenate(links)
        pairs, of = np.unique(links, return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, of, np.repeat(weight, stats[3]))
        size, raw = strings(pa.concat_arrays(groups))
        return pa.table({
            "bucket": table["bucket"][:1], "chunks": [pack([chunk[order], np.array([len(x) for x in lengths])])], "refs": [squeezed(pack([refs.astype(np.uint32)]))], "stats": [squeezed(pack([x.astype(np.uint32) for x in stats]))],
            "groups": [squeezed(pack([size.astype(np.uint32)]) + raw)], "links": [squeezed(pack([of.astype(np.uint32)]))], "pairs": [pack([pairs, total])],
        })

    return tables.written(chunks.where("bucket >= 0").select("bucket", "chunk", "blob").groupBy("bucket").applyInArrow(bucket, ALIGNED), "aligned")


def pair_rows(index: DataFrame) -> DataFrame:
    """(bucket, pair, n): a bucket's pairs of ids and how many links of the corpus its segments have with them."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                pair, n = unpack(blob, ["i8", "i8"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), bucket, np.int32)), pa.array(pair), pa.array(n)], names=["bucket", "pair", "n"])

    return index.select("bucket", "pairs").mapInArrow(mapper, "bucket int, pair long, n long")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): links of the corpus with a pair, and whether no other pair of its B id has more. A B id has at most as many pairs as A has ids."""
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))))


def returned(index: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, bucket, blob): the results of a chunk's segments in the order that it sent them. counts: (bucket, pair, count, best)."""

    def bucket(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        order = np.argsort(right["pair"].to_numpy())
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        stats = [x.astype(np.int64) for x in unpack(opened(row["stats"]), ["u4"] * 4)]
        links, edge = unpack(opened(row["links"]), ["u4"])[0], np.cumsum(stats[3]) - stats[3]
        stats += [np.add.reduceat(best[links], edge), np.add.reduceat(count[links], edge)]
        held = opened(row["groups"])
        length = unpack(held, ["u4"])[0]
        groups = array_of(length, held[8 + 4 * len(length) :], pa.large_binary())
        refs = unpack(opened(row["refs"]), ["u4"])[0]
        chunk, size = unpack(row["chunks"], ["i8", "i8"])
        blobs = []
        for a, n in zip((np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
            own = refs[a : a + n]
            text_length, text = strings(groups.take(pa.array(own)))
            blobs.append(squeezed(pack([x.astype(t) for x, t in zip([*(s[own] for s in stats), text_length], STATS, strict=True)]) + text))
        return pa.table({"chunk": chunk, "bucket": pa.array(np.full(len(chunk), row["bucket"], np.int32)), "blob": pa.array(blobs, pa.binary())})

    return index.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(bucket, "chunk long, bucket int, blob binary")


#: n_a, n_b, n_groups, n_links, n_best, count_sum and the length of the groups' text.
STATS = ["u4", "u4", "u4", "u4", "u4", "i8", "u4"]
_WIDTH = sum(np.dtype(x).itemsize for x in STATS)


def composed(left: pa.Table, right: pa.Table) -> pa.Table:
    """RESULT of the texts of one chunk. left: its row of PARTS; right: what came back from its buckets."""
    order = np.argsort(right["bucket"].to_numpy())
    blobs = right["blob"].to_pylist()
    columns, texts = [[] for _ in STATS], []
    for x in (opened(blobs[i]) for i in order.tolist()):
        for c, values in zip(columns, unpack(x, STATS), strict=True):
            c.append(values)
        texts.append(x[8 + _WIDTH * len(columns[0][-1]) :])
    columns = [np.concatenate([np.zeros(0, t), *c]) for c, t in zip(columns, STATS, strict=True)]
    held = opened(left["blob"][0].as_py())
    place = unpack(held, ["i4"])[0]
    refs = unpack(held[8 + 4 * len(place) :], ["i4"])[0]
    groups = array_of(columns[-1].astype(np.int64), b"".join(texts), pa.large_string()).take(pa.array(place))
    columns = [c[place] for c in columns]
    n = np.array(left["n"][0].as_py(), np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    sums = [np.concatenate([[0], np.cumsum(c[refs], dtype=np.int64)])[offsets] for c in columns[:-1]]
    hashes = [hashlib.sha256(";".join(groups.take(pa.array(refs[a:b])).to_pylist()).encode()).hexdigest() if b > a else "" for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.table([left["ids"][0].values if isinstance(left["ids"][0], pa.ListScalar) else pa.array([], pa.int64()), *[pa.array(np.diff(s)) for s in sums], pa.array(hashes, pa.string())], names=names)


def token_alignment(docs: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """RESULT for each row of `docs` (doc_id, text), by the tokenizers in `folder`."""
    both = files(docs.sparkSession, folder)
    chunks = parts(docs, tokenizers(*both).cuts(), bucket_count(docs), chunk_bytes)
    index = aligned(chunks, both)
    rows = pair_rows(index)
    counts = rows.hint("merge").join(pair_counts(rows), "pair").select("bucket", "pair", "count", "best")
    back = returned(index, counts)
    return chunks.where("bucket < 0").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(composed, RESULT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(tables.table(spark, sf_dir, "documents"))
