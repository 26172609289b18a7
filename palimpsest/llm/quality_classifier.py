"""Ordinal regression of graded ratings on hashed text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Spans, _SPACE, arrow, joined, mix, portions, runs, table, texts

#: Labelled rows that are fitted at most: those whose hashed ids are least.
SAMPLE = 10_000
LOG2_WEIGHTS, GRADES = 20, 3
#: Bytes of the beginnings of words that are features of their own, beside whole words.
PREFIXES = (5, 7)
_LETTER = np.zeros(256, bool)
_LETTER[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_MARKS = np.flatnonzero(~_LETTER & (np.arange(256) > 32) & (np.arange(256) < 127))
DENSE = len(_MARKS) + 3


def features(blobs: list[bytes], log2_weights: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of each text's distinct words and their beginnings (joined, with where each text begins) and rates of marks, capitals and repeats."""
    n = len(blobs)
    buf, begin = joined(blobs)
    low = np.frombuffer(buf.tobytes().lower(), np.uint8)
    start, end = runs(_LETTER[low])
    doc = np.searchsorted(begin, start, side="right") - 1
    spans, mask = Spans(low), U64((1 << log2_weights) - 1)
    parts = [doc * (1 << log2_weights) + (spans.hash(start, end) & mask).astype(np.int64)]
    for length in PREFIXES:
        long = end - start > length
        parts.append(doc[long] * (1 << log2_weights) + (mix(spans.hash(start[long], start[long] + length)) & mask).astype(np.int64))
    both = np.unique(np.concatenate(parts))
    at = np.searchsorted(both, np.arange(n + 1) * (1 << log2_weights))

    w0, w1 = runs(~_SPACE[buf])
    wd = np.searchsorted(begin, w0, side="right") - 1
    words = np.maximum(np.bincount(wd, minlength=n), 1)
    dense = np.zeros((n, DENSE), np.float32)
    byte_doc = np.repeat(np.arange(n), np.diff(begin))
    grid = np.bincount(byte_doc * 256 + buf, minlength=n * 256).reshape(n, 256)
    dense[:, : len(_MARKS)] = grid[:, _MARKS] / words[:, None]
    letters = grid[:, 65:91].sum(axis=1) + grid[:, 97:123].sum(axis=1)
    dense[:, -3] = grid[:, 65:91].sum(axis=1) / np.maximum(letters, 1)
    wh = Spans(buf).hash(w0, w1)
    again = np.flatnonzero((wh[1:] == wh[:-1]) & (wd[1:] == wd[:-1])) if len(wh) else wh
    dense[:, -2] = np.bincount(wd[again.astype(np.int64)], minlength=n) / words
    dense[:, -1] = 1 / np.sqrt(words)
    return (both & ((1 << log2_weights) - 1)), at, 3 * np.minimum(dense, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _totals(weights: np.ndarray, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(weights[slots], dtype=np.float64)))
    return sums[at[1:]] - sums[at[:-1]]


def fit(slots: np.ndarray, at: np.ndarray, dense: np.ndarray, grade: np.ndarray, log2_weights: int, grades: int, steps: int = 300, l1: float = 0.1, l2: float = 1e-5, least: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word weights, weights of the rates, thresholds: P(grade >= j) = sigmoid(score - threshold j).

    Slots of fewer than `least` rows, or a thousandth of them, stay at zero. A first descent with l1 (by the root of the rows) chooses the slots that bear on grades, a second
    one fits those alone, nearly unpenalised: rare words that are telling then get the weight they need.
    """
    size, n = 1 << log2_weights, len(grade)
    row = np.repeat(np.arange(n), np.diff(at))
    usable = np.bincount(slots, minlength=size) >= max(least, n // 1000)
    rates, i = dense.shape[1], np.arange(n)
    p = np.zeros(0)
    for penalty, weight_decay in ((l1 / np.sqrt(max(1, n)), 0.0), (0.0, l2)):
        names = np.flatnonzero(usable)
        keep = usable[slots]
        place, own = np.searchsorted(names, slots[keep]), row[keep]
        bounds, words = np.searchsorted(own, np.arange(n + 1)), len(names)
        cut = words + rates
        p = np.zeros(cut + grades - 1)
        p[cut:] = [-1.0] + [np.log(1.5)] * (grades - 2)  # the first threshold, then logarithms of the gaps
        total = np.full_like(p, 1e-8)
        for _ in range(steps if penalty else 4 * steps):
            gaps = np.exp(p[cut + 1 :])
            score = _totals(p[:words], place, bounds) + dense @ p[words:cut]
            edge = np.concatenate((np.ones((n, 1)), _sigmoid(score[:, None] - np.cumsum(np.concatenate((p[cut : cut + 1], gaps)))), np.zeros((n, 1))), axis=1)
            slope = edge * (1 - edge)
            chance = np.maximum(edge[i, grade] - edge[i, grade + 1], 1e-9)
            up, down = slope[i, grade] / chance / n, slope[i, grade + 1] / chance / n
            to_cut = np.array([up[grade == j].sum() - down[grade == j - 1].sum() for j in range(1, grades)])
            g = np.concatenate((np.bincount(place, weights=(down - up)[own], minlength=words), (down - up) @ dense, [to_cut.sum()], [to_cut[j:].sum() * gaps[j - 1] for j in range(1, grades - 1)]))
            g[:cut] += weight_decay * p[:cut]
            total += g * g
            step = (0.2 if penalty else 0.5) / np.sqrt(total)
            p -= step * g
            p[:words] = np.sign(p[:words]) * np.maximum(np.abs(p[:words]) - step[:words] * penalty, 0)
        usable = np.zeros(size, bool)
        usable[names[p[:words] != 0]] = True
    weights = np.zeros(size, np.float32)
    weights[names] = p[:words]
    return weights, p[words:cut], np.cumsum(np.concatenate((p[cut : cut + 1], np.exp(p[cut + 1 :]))))


class Ordinal:
    """A cumulative-link model; tails(texts) has P(grade >= j) for j from 1."""

    def __init__(self, words: np.ndarray, rates: np.ndarray, cuts: np.ndarray, log2_weights: int):
        self.words, self.rates, self.cuts, self.log2 = words, rates, cuts, log2_weights

    def tails(self, blobs: list[bytes]) -> np.ndarray:
        slots, at, dense = features(blobs, self.log2)
        return _sigmoid((_totals(self.words, slots, at) + dense @ self.rates)[:, None] - self.cuts)


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, log2_weights: int = LOG2_WEIGHTS, grades: int = GRADES) -> Ordinal | None:
    """Fits the grades of ratings(doc_id, grade), `sample` rows of them at most; None if there are none."""
    chosen = ratings.where("doc_id is not null and grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs, grade = texts(b.column(1)), b.column(2)
            for p in portions(blobs):
                slots, at, dense = features(blobs[p], log2_weights)
                cols = [b.column(0)[p.start : p.stop], grade[p.start : p.stop], pa.array([slots[i:j].astype(np.int32).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary())]
                yield pa.record_batch(cols, names=["doc_id", "grade", "slots", "dense"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = arrow(d.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("grade").cast("int")), run, "doc_id long, grade int, slots binary, dense binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["grade"], r["slots"]))
    if not rows:
        return None
    slots = [np.frombuffer(r["slots"], np.int32) for r in rows]
    at = np.concatenate(([0], np.cumsum([len(s) for s in slots])))
    grade = np.clip(np.array([r["grade"] for r in rows]), 0, grades - 1)
    dense = np.stack([np.frombuffer(r["dense"], np.float32) for r in rows])
    return Ordinal(*fit(np.concatenate(slots).astype(np.int64), at, dense, grade, log2_weights, grades), log2_weights)


def grade_documents(docs: DataFrame, ratings: DataFrame, select_at: int = GRADES - 1, least: float = 0.5, **train_args: int) -> DataFrame:
    """doc_id, expected_grade, tail (the chance of grade select_at or more) and kept (tail >= least) for each row of docs.

    The model is fitted on a bounded sample of rated documents and applied to whole texts. Without any rating, all
    documents get an expected grade and tail of null and are kept. A null or empty text has no words and is graded by
    its rates alone; null doc_id, ties and repeated rows pass through; other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(docs, ratings, **train_args)
    if model is None:
        return d.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail"), F.lit(True).alias("kept"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = texts(b.column(1))
            for p in portions(blobs):
                t = held.value.tails(blobs[p])
                tail = np.round(t[:, select_at - 1], 6)
                yield pa.record_batch([b.column(0)[p.start : p.stop], pa.array(np.round(t.sum(axis=1), 6)), pa.array(tail), pa.array(tail >= least)], names=["doc_id", "expected_grade", "tail", "kept"])

    return arrow(d, run, "doc_id long, expected_grade double, tail double, kept boolean")


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from 0 to 2: a point for quality, and one for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(table(spark, sf_dir, "documents"), ratings_of(table(spark, sf_dir, "labels")))
