"""Vectorised text primitives shared by the corpus operators.

Everything works on flat numpy arrays over the UTF-8 bytes of many documents at once, so the
per-document Python overhead is paid once per chunk. Hashes are built from 8-byte lanes and from
neighbours, each step passing through a bijective mixer, so no pattern of the text (periods,
Thue-Morse words) cancels out; two families with different constants are independent. They are
fixed functions of the content (no per-process salt), so a retried task gives the same rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Bytes up to which a slice is hashed lane by lane; longer ones by a library hash.
_LANES = 1024


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word (a bijection)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(None)
def _family(k: int) -> tuple[np.uint64, np.uint64]:
    """Odd multiplier and start of hash family k."""
    start, factor = mix64(np.array([k * 0x9E3779B97F4A7C15 & _MASK, k * 0xA0761D6478BD642F + 1 & _MASK], U64))
    return factor | U64(1), start


def joined(a: np.ndarray, b: np.ndarray, family: int = 1) -> np.ndarray:
    """Hash of the sequence that follows a's with b's."""
    x = a * _family(family)[0]
    x += b
    return mix64(x)


#: [\x20\x09-\x0D] are separators; every other byte belongs to a word.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z and every byte of a non-ASCII character.
ALNUM_LOWER = np.zeros(256, bool)
ALNUM_LOWER[0x30:0x3A] = ALNUM_LOWER[0x61:0x7B] = ALNUM_LOWER[0x80:] = True
NOT_ALNUM_LOWER = ~ALNUM_LOWER


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of `data` as one number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(9, np.uint8)]), strides=(1,))


#: Masks of the first 0 to 8 bytes of a lane.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def windows(values: np.ndarray, *sizes: int, span: int = 1, family: int = 1) -> list[np.ndarray]:
    """Hashes of all windows of each size, by start: doubled up to the largest power of two inside, then two that overlap.

    Each entry of `values` stands for `span` symbols from its place on."""
    levels, n = {span: values}, len(values) + span - 1
    while span * 2 <= max(sizes) and len(values) > span:
        values = joined(values[:-span], values[span:], family)
        span *= 2
        levels[span] = values
    out = []
    for size in sizes:
        if n < size:
            out.append(np.zeros(0, U64))
            continue
        low = max(k for k in levels if k <= size)
        out.append(levels[low][: n - size + 1] if low == size else joined(levels[low][: n - size + 1], levels[low][size - low : n - low + 1], family))
    return out


def byte_windows(data: np.ndarray, *sizes: int, family: int = 1) -> list[np.ndarray]:
    """Hashes of all windows of so many bytes each, by start."""
    span = 1 << (min(8, *sizes).bit_length() - 1)
    if len(data) < span:
        return [np.zeros(0, U64) for _ in sizes]
    return windows(mix64((_lanes(data)[: len(data) - span + 1] & _FIRST[span]) + _family(family)[1]), *sizes, span=span, family=family)


class Chunk:
    """Bytes of consecutive documents: `data` (uint8) and `offsets` (documents + 1)."""

    __slots__ = ("data", "offsets")

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    buffers, n = column.buffers(), len(column)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int):
    """(first, last, Chunk) slices of a string column of about `limit` bytes each; a longer document is a slice of its own."""
    data, offsets = text_buffers(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, Chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def spans(chunk: Chunk, separator: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each document its first word (documents + 1 entries).

    `separator` is a 256-entry table; words never cross documents."""
    data = chunk.data if data is None else data
    n = len(data)
    sep = separator[data]
    edge = np.zeros(n + 1, bool)
    edge[chunk.offsets] = True
    word = ~sep
    before = np.empty(n, bool)
    if n:
        before[0] = True
        before[1:] = sep[:-1]
    start = np.flatnonzero(word & (before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = True
        after[:-1] = sep[1:]
    end = np.flatnonzero(word & (after | edge[1 : n + 1])) + 1
    return start, end, np.searchsorted(start, chunk.offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 1) -> np.ndarray:
    """Hash of each slice: its length and its 8-byte lanes, each mixed in by a bijection."""
    length, lanes, (factor, begin) = end - start, _lanes(data), _family(family)
    out = mix64((lanes[start] & _FIRST[np.minimum(length, 8)]) + length.astype(U64) * factor + begin)
    live, at = np.flatnonzero((length > 8) & (length <= _LANES)), 8
    while len(live):
        out[live] = joined(out[live], lanes[start[live] + at] & _FIRST[np.minimum(length[live] - at, 8)], family)
        at += 8
        live = live[length[live] > at]
    for k in np.flatnonzero(length > _LANES).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, salt=family.to_bytes(4, "little")).digest(), "little")
    return out


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether words `one` and `two` have the same bytes."""
    length, lanes = end - start, _lanes(data)
    out = length[one] == length[two]
    live, at = np.flatnonzero(out & (one != two)), 0
    while len(live):
        a, b = one[live], two[live]
        mask = _FIRST[np.minimum(length[a] - at, 8)]
        equal = (lanes[start[a] + at] & mask) == (lanes[start[b] + at] & mask)
        out[live[~equal]] = False
        at += 8
        live = live[equal & (length[a] > at)]
    return out


def window_valid(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether a window of `size` words may start at each word, given each document's first word."""
    counts = np.diff(first)
    return np.arange(n) + size <= np.repeat(first[1:], counts)


def cover(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Mask of the positions covered by the given runs."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1) if len(starts) < 64 else delta.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32))
    stop = starts + lengths
    np.subtract.at(delta, stop, 1) if len(starts) < 64 else delta.__isub__(np.bincount(stop, minlength=n + 1).astype(np.int32))
    return np.cumsum(delta[:-1]) > 0


def per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true entries in each document's slice."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values, by doubling."""
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def repeated(values: np.ndarray) -> np.ndarray:
    """Mask of the entries whose value occurs more than once."""
    order = np.argsort(values)
    ranked = values[order]
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(values), bool)
    out[order] = same[1:] | same[:-1]
    return out


def kept_words(chunk: Chunk, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray):
    """Bytes of the kept words of each document, joined by one space: (data, offsets)."""
    n = len(chunk.data)
    last_kept = np.zeros(len(start), bool)
    index = np.flatnonzero(keep)
    if len(index):
        doc = np.searchsorted(first, index, side="right")
        last_kept[index[np.flatnonzero(np.diff(doc, append=doc[-1] + 1))]] = True
    chosen = np.zeros(n + 1, np.int8)
    chosen[start[keep]] += 1
    stop = end[keep] + ~last_kept[keep]
    delta = np.zeros(n + 2, np.int32)
    delta[: n + 1] += chosen
    delta += np.bincount(stop, minlength=n + 2)[: n + 2].astype(np.int32) * -1
    mask = np.cumsum(delta[:n]) > 0
    out = np.where(WHITE[chunk.data], np.uint8(0x20), chunk.data)[mask]
    total = np.zeros(n + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return out, total[chunk.offsets]
