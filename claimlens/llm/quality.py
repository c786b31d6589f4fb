"""Quality classifier (3): naive Bayes support vector machine over n-gram indicators.

A text becomes the set of its n-grams: word unigrams and bigrams, and n-grams
(1 to 3) of word shapes (letter case, digits, trailing marks, length, whether a
word repeats the one before) with the share of the text that a shape takes, and
repetition and length levels; all hashed into 2^18 indicators. Each indicator is
scaled by its log-count ratio between the two classes, a row is brought to unit
length, and a linear hinge loss is minimised by dual coordinate descent. A
logistic curve fitted on rows kept out of the descent turns margins into scores.

The fit uses a bounded sample of labelled rows: at most ``max_rows`` (default
MAX_TRAIN_ROWS), those with the smallest id hashes, and of these as many as hold
``max_indicators`` indicators. The model is one array of 2^18 weights whatever
the input's size. Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts get the score of a text without words;
several labels of one id count as 0 if any is 0; rows with null ids or labels
are not learned from; without both classes in the sample every score is the
share of label 1 (0.5 without any label); extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import words as W
from claimlens.llm.stage import id_remainder

BITS = 18
MAX_TRAIN_ROWS = 6000
MAX_INDICATORS = 20_000_000
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 4 other marks
_KIND[33:128] = 4
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 3, 1, 2, 2


def _tag(kind: int, values: np.ndarray) -> np.ndarray:
    return (W.mix(values.astype(np.uint64) * np.uint64(64) + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def _shapes(w: W.Words) -> np.ndarray:
    """A small integer for each word's shape."""
    kind = _KIND[w.data]
    n = w.end - w.start

    def count(k: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind == k)])
        return sums[w.end] - sums[w.start]

    upper, lower, digit, mark = count(1), count(2), count(3), count(4)
    first, last = kind[w.start], kind[w.end - 1]
    before_last = np.where(n > 1, kind[np.maximum(w.end - 2, 0)], 0)
    same = np.zeros(len(n), np.int64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    case = np.where(lower > 0, np.where(upper == 0, 0, np.where((upper == 1) & (first == 1), 1, 2)), np.where(upper > 1, 3, np.where(upper == 1, 4, 5)))
    ending = np.where((last == 4) & (before_last == 4), 2, np.where(last == 4, 1, 0))
    size = np.searchsorted([2, 4, 7, 12, 20], n)
    return (((case * 3 + ending) * 6 + size) * 3 + np.minimum(digit, 2)) * 4 + np.minimum(mark, 1) * 2 + same


def indicators(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, indicator) pairs of a chunk, distinct and sorted."""
    rows, tags = [], []

    def add(row: np.ndarray, tag: np.ndarray) -> None:
        rows.append(row)
        tags.append(tag)

    n_words = np.diff(w.bounds)
    every = np.arange(w.rows)
    add(every, _tag(1, np.minimum(np.ceil(np.log2(n_words + 1)), 12)))
    if len(w.hash):
        shape = _shapes(w)
        add(w.row, _tag(2, w.hash))
        pairs, pair_row, _ = W.grams(w, 2)
        add(pair_row, _tag(3, pairs))
        # shares of shapes without the size and digit detail, and of repeated words
        coarse = (shape // 72) * 4 + shape % 4
        key, counts = np.unique(w.row * 128 + coarse, return_counts=True)
        share = counts / n_words[key // 128]
        level = np.searchsorted([1 / 64, 1 / 16, 1 / 4, 1 / 2, 3 / 4], share)
        for least in range(1, 6):
            at = level >= least
            add(key[at] // 128, _tag(4, (key[at] % 128) * 8 + least))
        for kind, values, row in ((5, w.hash, w.row), (6, pairs, pair_row)):
            total = np.bincount(row, minlength=w.rows)
            order = np.lexsort((values, row))
            new = np.ones(len(order), bool)
            new[1:] = (values[order][1:] != values[order][:-1]) | (row[order][1:] != row[order][:-1])
            distinct = np.bincount(row[order][new], minlength=w.rows)
            some = np.flatnonzero(total)
            ratio = distinct[some] / total[some]
            add(some, _tag(kind, np.floor(ratio * 10) * 16 + np.minimum(np.ceil(np.log2(total[some] + 1)), 10)))
        shaped = W.Words(w.first, w.rows, w.row, W.mix(shape.astype(np.uint64)), w.start, w.end, w.data, w.row_start, w.bounds)
        for size in (1, 2, 3):
            g, row, _ = W.grams(shaped, size)
            add(row, _tag(7, g))
    key = np.unique(np.concatenate(rows) << BITS | np.concatenate(tags))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # hinge weight times log-count ratio, by indicator
    scale: np.ndarray    # squared log-count ratio, for the unit length
    slope: float
    shift: float

    def score(self, w: W.Words) -> np.ndarray:
        row, tag = indicators(w)
        margin = np.bincount(row, self.weights[tag], w.rows)
        length = np.sqrt(np.bincount(row, self.scale[tag], w.rows))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin / np.maximum(length, 1e-12) + self.shift, -500, 500)))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 20, cost: float = 1.0, alpha: float = 1.0, seed: int = 7) -> Model:
    """Fit on indicator lists and 0/1 labels; every fifth row calibrates the scores and is kept out of the descent."""
    size = 1 << BITS
    labels = np.asarray(labels, np.int64)
    good = labels == 1
    if len(labels) == 0 or good.all() or not good.any():
        share = float(np.clip(good.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
        return Model(np.zeros(size), np.zeros(size), 0.0, float(np.log(share / (1 - share))))
    held = np.zeros(len(labels), bool)
    for c in (0, 1):
        held[np.flatnonzero(labels == c)[4::5]] = True
    learn = np.flatnonzero(~held)

    def ratios(of: np.ndarray) -> np.ndarray:
        counts = [np.full(size, alpha), np.full(size, alpha)]
        n = [2 * alpha, 2 * alpha]
        for i in of:
            counts[labels[i]][rows[i]] += 1
            n[labels[i]] += 1
        return np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])

    r = ratios(learn)

    def scaled(i: int) -> np.ndarray:
        x = r[rows[i]]
        return x / max(np.sqrt(x @ x), 1e-12)

    y = labels * 2.0 - 1
    # both classes weigh the same in the loss
    limit = np.where(good, cost * len(learn) / (2 * max(1, good[learn].sum())), cost * len(learn) / (2 * max(1, (~good[learn]).sum())))
    w, dual, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        change = 0.0
        for i in rng.permutation(learn):
            x, at = scaled(i), rows[i]
            gradient = y[i] * (w[at] @ x) - 1
            new = min(max(dual[i] - gradient, 0.0), limit[i])  # the rows have unit length
            if new != dual[i]:
                w[at] += (new - dual[i]) * y[i] * x
                change = max(change, abs(new - dual[i]))
                dual[i] = new
        if change < 1e-3:
            break
    check = np.flatnonzero(held) if len(np.unique(labels[held])) == 2 else learn
    margins = np.array([w[rows[i]] @ scaled(i) for i in check])
    slope, shift = _logistic(margins, labels[check])
    return Model(w * r, r ** 2, slope, shift)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with smoothed targets."""
    n1 = labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-6 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = MAX_TRAIN_ROWS, max_indicators: int = MAX_INDICATORS) -> Model:
    """Fit on labelled documents outside fold 0 (crc32 of the id modulo ``folds``)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & (id_remainder("doc_id", folds) != 0)).groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.word_chunks(batch.column(1)):
                row, tag = indicators(w)
                at = np.searchsorted(row, np.arange(w.rows + 1))
                lists = [tag[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:])]
                own = slice(w.first, w.first + w.rows)
                yield pa.RecordBatch.from_arrays([batch.column(0)[own], batch.column(2)[own], pa.array(lists, pa.binary()), pa.array(np.diff(at))],
                                                 ["doc_id", "label", "tags", "n"])

    featured = texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, tags binary, n long")
    got = featured.orderBy(F.xxhash64("doc_id"), "doc_id", "tags").limit(max_rows).toLocalIterator()
    rows, target, held = [], [], 0
    for r in got:
        held += r["n"]
        if held > max_indicators and rows:
            break
        rows.append(np.frombuffer(r["tags"], "<i4"))
        target.append(r["label"])
    return fit(rows, np.array(target, np.int64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, in a map stage over the whole texts of all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.word_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[w.first:w.first + w.rows], pa.array(model.score(w))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def kept_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns, whatever these are called."""
    position = next(i for i, c in enumerate(docs.columns) if c == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(w) for w in W.word_chunks(batch.column(position))]
            yield batch.filter(pa.array(np.concatenate(score) >= threshold if score else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
