"""Quality rules with compression bands.

The base rules count words, symbols, repeated lines and repeated five-word windows. The method's
verdict compares zstandard ratios (raw bytes over compressed bytes) of the whole document and of
fixed chunks of it with limits that depend on the length: repetitive text compresses too well,
noise too badly. The last chunk ends with the text and may overlap the one before, so every byte of
a text of PIECE_BYTES or more is in a chunk; shorter texts have none. Everything happens inside a row; nothing is shuffled.

Defined results: null and empty texts have no words, fail the base rule and are not kept. Texts
shorter than the first band have no ratio limits. Repeated rows each return a row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from . import textkernel as tk

LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
LEVEL = 3
PIECE_BYTES = 4096
#: (bytes from which the band holds, lowest ratio, highest ratio) of whole documents; short texts compress less. The
#: lower limits lie between random base64 or ideographs (1.05 to 1.09 at 256 bytes, 1.26 to 1.28 at 1 KB, 1.32 to 1.36
#: at 4 KB, 1.38 beyond) and prose (1.35, 1.7, 2.1 and 2.3 at least, measured at scale 0.1).
BANDS = ((64, 0.70, 2.5), (256, 1.12, 2.6), (512, 1.30, 2.6), (1024, 1.34, 2.9), (2048, 1.42, 2.9), (4096, 1.48, 3.3), (16384, 1.50, 4.0), (65536, 1.50, 5.0))
#: The same for one chunk of PIECE_BYTES.
PIECE_LOW, PIECE_HIGH = 1.45, 4.0
CHUNK_BYTES = 1 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
SCHEMA = "_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, piece_low double, piece_high double, base_failed boolean, kept boolean"


def _groups_repeat(document: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over records: the value occurs again in its document; it occurred earlier in it."""
    key = tk.mix64(value + tk.mix64(document.astype(np.uint64) + np.uint64(1)))
    again = tk.repeated(key)
    some = np.flatnonzero(again)
    later = np.zeros(len(key), bool)
    if len(some):
        order = some[np.argsort(key[some], kind="stable")]
        later[order[1:]] = key[order][1:] == key[order][:-1]
    return again, later


def measures(chunk: tk.Chunk) -> dict[str, np.ndarray]:
    begin, end, first = tk.spans(chunk, tk.WHITE)
    n, size = len(begin), len(chunk)
    document = np.repeat(np.arange(size), np.diff(first))
    hashes = tk.word_hashes(chunk.data, begin, end)
    heads = (chunk.data & 0xC0) != 0x80  # first bytes of code points
    chars = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(heads & ~tk.WHITE[chunk.data], out=chars[1:])
    repeats = np.zeros(n, bool)
    if n >= REPEAT_WINDOW:
        index = np.flatnonzero(tk.window_valid(first, n, REPEAT_WINDOW)[: n - REPEAT_WINDOW + 1])
        windows = tk.windows(hashes, REPEAT_WINDOW)[0][index]
        again, _ = _groups_repeat(document[index], windows)
        repeats = tk.cover(index[again], REPEAT_WINDOW, n)
    line_begin, line_end, line_first = tk.spans(chunk, NEWLINE)
    words_before = np.searchsorted(begin, np.stack([line_begin, line_end]))
    filled = words_before[1] > words_before[0]
    line_document = np.repeat(np.arange(size), np.diff(line_first))
    _, later = _groups_repeat(line_document, tk.word_hashes(chunk.data, line_begin, line_end)) if len(line_begin) else (None, np.zeros(0, bool))
    return {
        "n_words": np.diff(first),
        "word_chars": chars[chunk.offsets[1:]] - chars[chunk.offsets[:-1]],
        "n_symbols": tk.per_document(SYMBOLS[chunk.data], chunk.offsets),
        "n_dup_lines": tk.per_document(later & filled, line_first),
        "n_repeat_words": tk.per_document(repeats, first),
    }


def ratios(compressor: zstandard.ZstdCompressor, raw: memoryview) -> tuple[float, float, float]:
    """Ratio of the whole text, and the lowest and highest of its chunks (the whole's, without one)."""
    n = len(raw)
    if not n:
        return 1.0, 1.0, 1.0
    whole = n / len(compressor.compress(raw))
    starts = [*range(0, n - PIECE_BYTES, PIECE_BYTES), n - PIECE_BYTES] if n >= PIECE_BYTES else []
    pieces = [PIECE_BYTES / len(compressor.compress(raw[i : i + PIECE_BYTES])) for i in starts]
    return whole, min(pieces, default=whole), max(pieces, default=whole)


def in_band(size: np.ndarray, ratio: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.ones(len(size), bool)
    for at, least, most in BANDS:
        out = np.where(size >= at, (ratio >= least) & (ratio <= most), out)
    return out & ((size < PIECE_BYTES) | ((low >= PIECE_LOW) & (high <= PIECE_HIGH)))


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    for batch in batches:
        for a, b, chunk in tk.chunks(batch.column(1), CHUNK_BYTES):
            m = measures(chunk)
            view, offsets = memoryview(chunk.data), chunk.offsets.tolist()
            band = np.array([ratios(compressor, view[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]).reshape(-1, 3)
            failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
            kept = ~failed & in_band(np.diff(chunk.offsets), *band.T)
            columns = [batch.column(0).slice(a, b - a), *map(pa.array, m.values()), *(pa.array(np.ascontiguousarray(c)) for c in band.T), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", *m, "ratio", "piece_low", "piece_high", "base_failed", "kept"])


def quality(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, the compression ratios, base_failed and kept of every row."""
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(tables.NULL_ID)).alias("_id"), "text")
    out = docs.mapInArrow(_rules, SCHEMA)
    return out.select(tables.doc_id(), *[c for c in out.columns if c != "_id"])


def op10_compression_quality(spark, sf_dir: str) -> DataFrame:
    found = quality(tables.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
