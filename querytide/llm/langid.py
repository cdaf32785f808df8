"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (orders 1 to 3) of the lower-cased texts per language, hashed into
`BUCKETS` features. Tasks add up what they touch and send it in slices of the feature space, so a
language that holds most rows costs no more than any other. The smoothed log-probability matrix is
broadcast in blocks of `BLOCK` languages (16 MB each at most), and every block scores the documents
in one pass: the sparse n-gram counts of a batch times the block's dense columns, as gathered rows
summed per document, a bounded number of n-grams at a time. Passes of further blocks carry the best
language so far and the sum of the odds, so any number of languages gives the same result as one
matrix would.

All documents outside the held-out fold with a non-null lang are learned from; doc_id decides the
fold only. Defined results: texts that are null or have no letter get `und` and score 0; without
any learned language every text gets `und`. Ties go to the first language by code point. Repeated
rows each return a row; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from . import textkernel as tk

FOLDS, HELD = 5, 0
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SLICE = 1 << 12
SMOOTHING = 0.5
#: Languages in one broadcast matrix, and matrix entries gathered at a time.
BLOCK = 64
GATHERED = 1 << 21
UNKNOWN = "und"
CHUNK_BYTES = 1 << 20


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


_LETTERS: list[np.ndarray] = []


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the lower-cased texts with single blanks between them: (points, first of each text, has a letter)."""
    if not _LETTERS:
        _LETTERS.append(letters())
    raw = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(f" {t} " for t in raw).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum([len(t) + 2 for t in raw]))).astype(np.int64)
    letter = _LETTERS[0][points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    keep[first[:-1]] = True  # and one before the text
    out = np.where(letter, points, 32)[keep].astype(np.uint64)
    total = np.concatenate(([0], np.cumsum(keep)))
    seen = np.concatenate(([0], np.cumsum(letter)))
    return out, total[first], seen[first[1:]] > seen[first[:-1]]


def features(points: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram that starts at each point, and the points where one does."""
    for order, grams in zip(ORDERS, tk.windows(tk.mix64(points + np.uint64(0x9E37)), *ORDERS), strict=True):
        valid = tk.window_valid(first, len(points), order)[: max(len(points) - order + 1, 0)]
        yield (grams >> np.uint64(48)).astype(np.int32), valid


def split(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    data, offsets = tk.text_buffers(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = min(max(int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1, a + 1), n)
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b


def _count(languages: list[str]):
    place = {x: k for k, x in enumerate(languages)}
    most = 64  # languages whose counts a task holds before it sends them

    def sent(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        used = [(k, s) for k, counts in total.items() for s in range(0, BUCKETS, SLICE) if counts[s : s + SLICE].any()]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in used], pa.int32()), pa.array([s for _, s in used], pa.int32()), pa.array([total[k][s : s + SLICE].tobytes() for k, s in used], pa.binary())], names=["lang", "slice", "counts"]
        )

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, texts in split(batch.column(0)):
                label = np.array([place[x] for x in langs[a:b]])
                order = np.argsort(label, kind="stable")
                points, first, _ = code_points([texts[k] for k in order.tolist()])
                number, at = np.unique(label[order], return_index=True)
                for bucket, valid in features(points, first):
                    for k, low, high in zip(number.tolist(), first[at].tolist(), first[np.append(at[1:], len(order))].tolist(), strict=True):
                        counts = np.bincount(bucket[low:high][valid[low:high]], minlength=BUCKETS)
                        total[k] = total[k] + counts if k in total else counts
                if len(total) > most:
                    yield sent(total)
                    total = {}
        yield sent(total)

    return mapper


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for k, s, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(blob, np.int64)
            by[k, s] = by[k, s] + x if (k, s) in by else x
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in by], pa.int32()), pa.array([s for _, s in by], pa.int32()), pa.array([x.tobytes() for x in by.values()], pa.binary())], names=["lang", "slice", "counts"])


class Model:
    """A block of languages and their smoothed log probabilities by feature."""

    def __init__(self, languages: list[str], counts: np.ndarray, prior: np.ndarray) -> None:
        self.languages, self.prior = languages, prior
        total = counts.sum(1, keepdims=True)
        self.matrix = np.ascontiguousarray((np.log(counts + SMOOTHING) - np.log(total + SMOOTHING * BUCKETS)).T.astype(np.float32))

    def logs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each text by language, and whether it has a letter."""
        points, first, known = code_points(texts)
        total = np.tile(self.prior, (len(texts), 1))
        step = max(1, GATHERED // len(self.languages))
        for bucket, valid in features(points, first):
            at = np.flatnonzero(valid)
            document, bucket = np.searchsorted(first, at, side="right") - 1, bucket[at]
            for low in range(0, len(at), step):
                rows, mine = self.matrix[bucket[low : low + step]], document[low : low + step]
                cut = np.flatnonzero(np.diff(mine, prepend=-1))
                total[mine[cut]] += np.add.reduceat(rows, cut, axis=0, dtype=np.float64)
        return total, known


def fold(folds: int) -> F.Column:
    """crc32 of doc_id as text, modulo the folds; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def train(documents: DataFrame) -> list[Model]:
    """Learns from the given rows (text, lang), in blocks of languages; rows without lang are left out."""
    rows = documents.where(F.col("lang").isNotNull()).select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a number for each language
    languages = sorted(sizes)
    if not languages:
        return []
    n = min(len(languages) * BUCKETS // SLICE, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = rows.mapInArrow(_count(languages), "lang int, slice int, counts binary").repartition(n, "lang", "slice").mapInArrow(_add, "lang int, slice int, counts binary")
    if len(languages) > BLOCK:
        parts = tables.written(parts, "counts")
    prior = np.log(np.array([sizes[x] for x in languages]) + 1.0)
    prior -= np.log(np.exp(prior).sum())
    out = []
    for low in range(0, len(languages), BLOCK):
        high = min(low + BLOCK, len(languages))
        counts = np.zeros((high - low, BUCKETS), np.int64)
        for r in parts.where(F.col("lang").between(low, high - 1)).toLocalIterator():  # BLOCK x BUCKETS counts at most
            counts[r["lang"] - low, r["slice"] : r["slice"] + SLICE] += np.frombuffer(r["counts"], np.int64)
        out.append(Model(languages[low:high], counts, prior[low:high]))
    return out


_SCORED = "doc_id long, held_out boolean, text string, lang_pred string, best double, odds double"


def _predict(model, last: bool):
    """Scores one block of languages; best is the log odds of lang_pred, odds the sum of all odds over that one's."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in split(batch.column(2)):
                logs, known = model.value.logs(texts)
                lang, best, odds = (batch.column(k).slice(a, b - a) for k in (3, 4, 5))
                lang, before, sums = lang.to_pylist(), best.to_numpy(zero_copy_only=False), odds.to_numpy(zero_copy_only=False)
                pick = logs.argmax(1)
                top = logs[np.arange(len(logs)), pick]
                better = top > before  # ties stay with the earlier language
                lead = np.maximum(top, before)
                sums = sums * np.exp(before - lead) + np.exp(logs - lead[:, None]).sum(1)
                lang = [model.value.languages[k] if new else old for k, new, old in zip(pick.tolist(), better.tolist(), lang, strict=True)]
                head = [batch.column(k).slice(a, b - a) for k in (0, 1)]
                if last:
                    lang = [x if ok else UNKNOWN for x, ok in zip(lang, known.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(lang, pa.string()), pa.array(np.where(known, 1 / sums, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([*head, batch.column(2).slice(a, b - a), pa.array(lang, pa.string()), pa.array(lead), pa.array(sums)], names=[x.split()[0] for x in _SCORED.split(", ")])

    return mapper


def identify(documents: DataFrame, learn_from: DataFrame, held_out: F.Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `documents`, by a model of `learn_from`."""
    tables.small_batches(documents.sparkSession)
    models = train(learn_from)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("odds"))
    if not models:
        return rows.select("doc_id", "held_out", "lang_pred", F.lit(0.0).alias("score"))
    for k, model in enumerate(models):
        last = k == len(models) - 1
        rows = rows.mapInArrow(_predict(documents.sparkSession.sparkContext.broadcast(model), last), "doc_id long, held_out boolean, lang_pred string, score double" if last else _SCORED)
    return rows


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents")
    held = fold(FOLDS) == HELD
    return identify(documents, documents.where(~held), held)
