"""Toxicity by maximum-scoring segments.

Training. At most `TRAIN_ROWS` labelled rows (a documented bound; chosen by a hash of doc_id) give
document frequencies of words and word beginnings (hashed into `BUCKETS` features) in toxic and
clean documents. Each feature's log-odds carries an informative Dirichlet
prior proportional to its overall frequency, and counts only where it is at least `LEAST_ODDS` and
`LEAST_Z` standard errors from zero. A token scores the log-odds of its better-supported feature, less a small drift, so
random text drifts down. Scores are whole numbers (1/`UNIT`), so sums are exact and a document's score
does not depend on its neighbours in a batch. For calibration each of `PARTS` parts of the rows is scored
by what the others teach: lambda solves
E[exp(lambda * score)] = 1 over the tokens of clean documents, K follows from the extreme-value median of
their best segments, and a logistic curve maps a document's evidence to a probability.

Scoring. One linear scan per chunk gives every document's best segment (running sum less its
running minimum). Documents whose best segment is significant are scanned once more, in linear
time, for all maximal scoring segments; those with an expected count below `MOST_EXPECTED` are its
passages. With normalised scores x = lambda * S - ln(K * n), the evidence of the r best passages is
the extreme-value sum statistic, -ln of T^(r-1) e^-T / (r! (r-1)!) with T the sum of their x, and a
document's evidence the largest over r: several passages weigh more than the best alone. All rows
are scored, each in its own row; nothing but the bounded model is broadcast.

Defined results: null or empty texts have no tokens and score as an empty segment. Without a
training row of each class every score is the share of toxic training rows (0 without rows).
Repeated label rows count once per row; a null label is no label. Repeated documents each return
a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from . import textkernel as tk

FOLDS, HELD = 4, 2
THRESHOLD = 0.3
TRAIN_ROWS = 20_000
BUCKETS = 1 << 18
BEGINNING = 5
PARTS = 4
#: Strength of the prior as a share of the documents seen.
PRIOR_SHARE = 0.1
LEAST_Z = 3.0
LEAST_ODDS = 1.5
MOST_SCORE = 6.0
DRIFT = 0.05
UNIT = 1024
MOST_EXPECTED = 0.01
CHUNK_BYTES = 1 << 20
#: Normalised score from which a segment is a passage: its expected count is below MOST_EXPECTED.
LEAST_NORMAL = float(-np.log(MOST_EXPECTED))
_BINS = 256


class Tokens:
    """Tokens of a chunk and their two features."""

    def __init__(self, chunk: tk.Chunk) -> None:
        data = tk.LOWER[chunk.data]
        self.begin, self.end, self.first = tk.spans(chunk, tk.NOT_ALNUM_LOWER, data)
        word = tk.word_hashes(data, self.begin, self.end)
        head = tk.word_hashes(data, self.begin, np.minimum(self.end, self.begin + BEGINNING))
        self.word = (word % np.uint64(BUCKETS)).astype(np.int64)
        self.head = (tk.mix64(head + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
        self.document = np.repeat(np.arange(len(chunk)), np.diff(self.first))


class Lexicon:
    """Log-odds with a Dirichlet prior, by feature."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> None:
        seen = max(n_toxic + n_clean, 1)
        strength = PRIOR_SHARE * seen
        prior = strength * (toxic + clean) / seen + 0.01
        a, b = toxic + prior, clean + prior
        rest_a, rest_b = np.maximum(n_toxic + strength - a, 0.5), np.maximum(n_clean + strength - b, 0.5)
        odds = np.log(a) - np.log(rest_a) - np.log(b) + np.log(rest_b)
        z = odds / np.sqrt(1 / a + 1 / b)
        self.z = np.where((np.abs(z) >= LEAST_Z) & (np.abs(odds) >= LEAST_ODDS), np.abs(z), 0).astype(np.float32)
        self.odds = np.where(self.z > 0, np.clip(odds, -1.0, MOST_SCORE), 0).astype(np.float32)

    def scores(self, tokens: Tokens) -> np.ndarray:
        """Score of each token, in 1/UNIT."""
        better = self.z[tokens.head] > self.z[tokens.word]
        return np.rint((np.where(better, self.odds[tokens.head], self.odds[tokens.word]) - DRIFT) * UNIT).astype(np.int64)


def best_segments(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Score of each document's best segment; 0 for the empty one."""
    n = len(first) - 1
    out = np.zeros(n, np.int64)
    if not len(scores):
        return out
    counts = np.diff(first)
    document = np.repeat(np.arange(n), counts)
    total = np.cumsum(scores)
    before = total - scores
    base = before[np.minimum(first[:-1], len(before) - 1)][document]
    wide = 1 + 2 * int(np.abs(scores).sum())
    low = np.minimum.accumulate(before - base - wide * document) + wide * document  # the minimum starts anew with each document
    full = np.flatnonzero(counts)
    out[full] = np.maximum(np.maximum.reduceat(total - base - low, first[:-1][full]), 0)
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal scoring segments (start, end, score) of one sequence, in linear time."""
    total = np.cumsum(scores)
    found = []  # of each candidate: start, end, sum before it, sum up to its end, the last one before it with a smaller sum
    at = np.flatnonzero(scores > 0)  # the rest matters by its sums only
    for i, high, own in zip(at.tolist(), total[at].tolist(), scores[at].tolist(), strict=True):
        x = [i, i + 1, high - own, high]
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= x[2]:
                k = found[k][4]
            if k < 0 or found[k][3] >= x[3]:
                found.append([*x, k])
                break
            x = [found[k][0], x[1], found[k][2], x[3]]
            del found[k:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def sum_statistic(normal: np.ndarray) -> float:
    """Evidence of the best segments together, the largest over their number; `normal` holds normalised scores, all over 0."""
    x = np.sort(normal)[::-1]
    total, r = np.cumsum(x), np.arange(1, len(x) + 1)
    orders = np.array([lgamma(k + 1) + lgamma(k) for k in r.tolist()])
    return float((total - (r - 1) * np.log(np.maximum(total, 1.0)) + orders).max())


class Calibration:
    """Extreme-value parameters and the curve from evidence to probabilities."""

    def __init__(self, label: np.ndarray, n: np.ndarray, segments: list[np.ndarray], histogram: np.ndarray, base: float) -> None:
        self.rate, self.shift, self.curve, self.base = 1.0, 0.0, None, base
        best = np.array([x.max(initial=0) for x in segments], np.int64)
        values = np.linspace(-1.0 - DRIFT, MOST_SCORE - DRIFT, _BINS)
        tokens = histogram.sum()
        if not histogram[values > 0].any() and tokens:  # a clean token may be as bad as any, though none of these is
            histogram = histogram + np.eye(_BINS)[-1]
        weight = histogram / max(histogram.sum(), 1)
        if weight[values > 0].sum() > 0 and (weight * values).sum() < 0:
            low, high = 1e-3, 20.0
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if (weight * np.exp(middle * values)).sum() < 1 else (low, middle)
            self.rate = low
        clean = (label == 0) & (best > 0)
        if clean.any():
            self.shift = float(np.median(self.rate * best[clean] / UNIT - np.log(np.maximum(n[clean], 1)))) + np.log(np.log(2))
        elif tokens:
            self.shift = self.rate * MOST_SCORE - np.log(tokens) + np.log(np.log(2))
        if 0 < label.sum() < len(label):
            self.curve = self._logistic(np.array([self.evidence(x, m) for x, m in zip(segments, n.tolist(), strict=True)]), label)

    def normal(self, score: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """lambda * S - ln(K * n): expected count of such segments is its exponential, negated."""
        return np.where(score > 0, np.clip(self.rate * score / UNIT - np.log(np.maximum(n, 1)) - self.shift, -20, 40), -20.0)

    def evidence(self, segments: np.ndarray, n: int) -> float:
        """Of a document of n tokens with segments of these scores."""
        x = self.normal(segments, n)
        some = x[x > LEAST_NORMAL]
        return sum_statistic(some) if len(some) else float(x.max(initial=-20.0))

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        mean, spread = x.mean(), x.std() + 1e-9
        design, w = np.stack([np.ones(len(x)), (x - mean) / spread], 1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ w))
            gradient = design.T @ (p - y) + 1e-3 * w
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        slope = max(w[1] / spread, 1e-6)
        return float(w[0] - slope * mean), float(slope)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(evidence), self.base)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * evidence, -500, 500)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's training rows, by part, feature and label; feature -1 counts the documents."""
    counts = np.zeros((PARTS, 2, BUCKETS + 1), np.int32)
    for batch in batches:
        kind = np.asarray(batch.column(2)) * 2 + np.asarray(batch.column(1))
        for a, b, chunk in tk.chunks(batch.column(0), CHUNK_BYTES):
            t = Tokens(chunk)
            wide = BUCKETS + 1
            pairs = np.unique(np.concatenate([t.document * wide + t.word, t.document * wide + t.head, np.arange(b - a) * wide + BUCKETS]))
            flat, n = np.unique(kind[a:b][pairs // wide] * wide + pairs % wide, return_counts=True)
            counts.reshape(-1)[flat] += n.astype(np.int32)
    part, feature = np.nonzero(counts.any(1))
    columns = [part.astype(np.int32), np.where(feature == BUCKETS, -1, feature).astype(np.int32), *(counts[part, y, feature].astype(np.int64) for y in (0, 1))]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "feature", "clean", "toxic"])


def _evidence(lexicons):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.asarray(batch.column(2))
            for a, b, chunk in tk.chunks(batch.column(0), CHUNK_BYTES):
                t = Tokens(chunk)
                of = parts[a:b][t.document]
                s = np.zeros(len(of), np.int64)
                for k in np.unique(of).tolist():
                    s = np.where(of == k, lexicons.value[k].scores(t), s)
                place = np.rint((s / UNIT + 1.0 + DRIFT) / (MOST_SCORE + 1.0) * (_BINS - 1)).astype(np.int64)
                clean = np.bincount(place[np.asarray(batch.column(1))[a:b][t.document] == 0], minlength=_BINS).tobytes()
                hist = [clean, *[b""] * (b - a - 1)]  # one histogram for the chunk's clean tokens
                segments = [[score for _, _, score in maximal_segments(s[x:y])] for x, y in zip(t.first[:-1], t.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(np.diff(t.first)), pa.array(segments, pa.list_(pa.int64())), pa.array(hist, pa.binary())], names=["label", "n", "segments", "hist"])

    return mapper


class Model:
    def __init__(self, lexicon: Lexicon, calibration: Calibration) -> None:
        self.lexicon, self.calibration = lexicon, calibration


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most `rows` labelled rows of `labels` (doc_id, toxic)."""
    context = documents.sparkSession.sparkContext
    sample = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows).collect()
    ids = documents.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in sample], "doc_id long, toxic int")  # bounded by `rows`
    known = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).cast("int").alias("part"))
    counts, total = np.zeros((PARTS, 2, BUCKETS)), np.zeros((PARTS, 2))
    frequencies = known.mapInArrow(_frequencies, "part int, feature int, clean long, toxic long")
    for r in frequencies.groupBy("part", "feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow().to_batches():  # at most PARTS * (BUCKETS + 1) rows
        part, feature, clean, toxic = (np.asarray(c) for c in r.columns)
        real = feature >= 0
        counts[part[real], 0, feature[real]], counts[part[real], 1, feature[real]] = clean[real], toxic[real]
        total[part[~real], 0], total[part[~real], 1] = clean[~real], toxic[~real]
    of = lambda counts, total: Lexicon(counts[1], counts[0], int(total[1]), int(total[0]))
    whole, seen = counts.sum(0), total.sum(0)
    others = [of(whole - counts[k], seen - total[k]) for k in range(PARTS)]
    found = known.mapInArrow(_evidence(context.broadcast(others)), "label int, n long, segments array<long>, hist binary").toArrow()  # at most `rows` rows
    label, n = (found.column(k).to_numpy() for k in (0, 1))
    lists = found.column(2).combine_chunks()
    segments = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]) if len(label) else []
    histogram = sum((np.frombuffer(h, np.int64) for h in found.column(3).to_pylist() if h), np.zeros(_BINS))
    base = seen[1] / seen.sum() if seen.sum() else 0.0
    return Model(of(whole, seen), Calibration(label, n, segments, histogram, float(base)))


def assessed(model: Model, chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """Probability, best segment score and passages of each document of a chunk."""
    t = Tokens(chunk)
    s = model.lexicon.scores(t)
    n, best = np.diff(t.first), best_segments(s, t.first)
    evidence = model.calibration.normal(best, n)
    passages: list[list[dict]] = [[] for _ in range(len(chunk))]
    for k in np.flatnonzero(evidence > LEAST_NORMAL):
        found = maximal_segments(s[t.first[k] : t.first[k + 1]])
        scores = np.array([x for _, _, x in found])
        evidence[k] = model.calibration.evidence(scores, n[k])
        passages[k] = [{"start": a, "count": b - a, "score": x / UNIT} for (a, b, x), y in zip(found, model.calibration.normal(scores, n[k]), strict=True) if y > LEAST_NORMAL]
    return model.calibration.probability(evidence), best / UNIT, passages


def _score(model):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for a, b, chunk in tk.chunks(batch.column(1), CHUNK_BYTES):
                probability, best, passages = assessed(model.value, chunk)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(probability), pa.array(best), pa.array(passages, kind)], names=["row", "score", "best", "passages"])

    return mapper


def score(rows: DataFrame, model: Model) -> DataFrame:
    """row (long, as given), score, best (segment score), passages of rows (row, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.select("row", "text").mapInArrow(_score(shared), "row long, score double, best double, passages array<struct<start:int,count:int,score:double>>")


def _kept(model, threshold: float):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0), *(assessed(model.value, chunk)[0] for _, _, chunk in tk.chunks(batch.column(2), CHUNK_BYTES))]
            yield batch.select([0]).filter(pa.array(np.concatenate(found) < threshold))

    return mapper


def kept(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `documents` that score below the threshold, with all columns."""
    rows = tables.whole(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return tables.unpacked(rows.mapInArrow(_kept(shared, threshold), rows.select("_row").schema), documents.columns)


def fold() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))


def learnt(spark, sf_dir: str, documents: DataFrame) -> Model:
    """A model of the labelled rows outside the held-out fold."""
    return train(documents, tables.table(spark, sf_dir, "labels").where(fold() != HELD))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents")
    found = score(documents.select(F.col("doc_id").cast("long").alias("row"), "text"), learnt(spark, sf_dir, documents)).withColumnRenamed("row", "doc_id")
    return found.select("doc_id", (fold() == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
