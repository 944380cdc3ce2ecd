"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector w serves all grades; ordered thresholds c_1 < ... < c_(K-1) cut the line, and
P(grade >= k) = sigmoid(w . x - c_k). Expected grade and tail probability follow from these.

Features: words (folded A-Z), word shapes (runs of upper case, lower case, digits, other letters, with marks as
they are), and words equal to the one before, hashed to ``DIMENSIONS``; a feature's value is the square root
of its share of the text's words.

Fitted on a bounded sample: the rated documents with the smallest hashes of their ids and texts, ``sample`` at most and
as many of them as have ``most_features`` features together. The fit sees their sparse vectors, not their texts, in
one task; its result is DIMENSIONS weights and the thresholds. All documents are scored by their whole texts.

Defined cases: null and empty texts have no features, so their grade follows from the thresholds; null
ratings are left out; different ratings of a document count each; of rows that repeat one is learnt from, and all are
scored; texts that share an id are documents of their own; ids are cast to long; without any rating every grade is
as likely as another; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import Scratch, once, row_key
from inkspan.llm.words import SPACE, flat, portions, words

DIMENSIONS = 1 << 16
#: Rated documents that the fit may see.
SAMPLE = 8_000
#: Features that the fit may see, of all its texts together: 12 bytes each.
FEATURES = 1 << 24
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = 0x80


def _shapes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: letters and digits by class, runs of one class or mark once."""
    cls = _SHAPE[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (cls[1:] != cls[:-1]) | SPACE[data[1:]]
    keep[ends[:-1][ends[:-1] < len(data)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return words(cls[keep], kept[ends], lower=False)[0]


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, dimension, value) of every feature of every text, by text."""
    data, ends = flat(texts)
    h, _, _, at = words(data, ends, lower=True)
    shape = _shapes(data, ends)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(at))
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    code = np.concatenate([h, shape ^ np.uint64(0x5851F42D4C957F2D), np.full(int(again.sum()), np.uint64(77))])
    owner = np.concatenate([doc, doc, doc[again]])
    key, n = np.unique(owner * DIMENSIONS + (code % np.uint64(DIMENSIONS)).astype(np.int64), return_counts=True)
    owner, dim = key // DIMENSIONS, key % DIMENSIONS
    return owner, dim, np.sqrt(n / np.maximum(np.diff(at), 1)[owner])


def _vectors(batches):
    for b in portions(batches, 1):
        owner, dim, value = features(b.column(1))
        cut = np.searchsorted(owner, np.arange(b.num_rows + 1))
        values = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(value))
        dims = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(dim.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), dims, values], names=["grade", "key", "dims", "vals"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, line: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a row for each value of w . x."""
        return sigmoid(line[:, None] - self.cuts[None, :])

    def score(self, texts) -> np.ndarray:
        owner, dim, value = features(texts)
        return self.tails(np.bincount(owner, value * self.weights[dim], minlength=len(texts)))


def fit(owner: np.ndarray, dim: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, epochs: int = 500, rate: float = 1.0, lasso: float = 3e-5) -> Model:
    """Maximum likelihood with an absolute penalty on the weights by proximal AdaGrad over the whole sample,
    which leaves dimensions without a clear effect at 0; cuts are kept in order through their gaps' logarithms."""
    n = len(grade)
    w = np.zeros(DIMENSIONS)
    share = (np.bincount(grade, minlength=grades)[::-1].cumsum()[::-1][1:] + 0.5) / (n + 1)
    cuts = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(grades - 1))
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    seen_w, seen_c = np.full(DIMENSIONS, 1e-8), np.full(grades - 1, 1e-8)
    rows = np.arange(n)
    for _ in range(epochs if n else 0):
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        line = np.bincount(owner, value * w[dim], minlength=n)
        tail = np.concatenate([np.ones((n, 1)), sigmoid(line[:, None] - cuts), np.zeros((n, 1))], axis=1)
        upper, lower = tail[rows, grade], tail[rows, grade + 1]
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = d_upper - d_lower
        g = np.bincount(dim, value * slope[owner], minlength=DIMENSIONS) / n
        gc = (np.bincount(grade, -d_upper, minlength=grades)[1:] + np.bincount(grade, d_lower, minlength=grades)[:-1]) / n
        gf = np.cumsum(gc[::-1])[::-1].copy()
        gf[1:] *= np.exp(free[1:])
        seen_w += g * g
        seen_c += gf * gf
        step = rate / np.sqrt(seen_w)
        w += step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0.0)
        free += 0.1 * gf / np.sqrt(seen_c)
    return Model(w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def _fit(grades: int):
    def make(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("grade", "ascending")]).combine_chunks()  # a refit gives the same bits
        dims, vals = t.column("dims").combine_chunks(), t.column("vals").combine_chunks()
        owner = np.repeat(np.arange(t.num_rows), np.diff(dims.offsets.to_numpy()))
        m = fit(owner, dims.flatten().to_numpy(), vals.flatten().to_numpy(), t.column("grade").to_numpy().astype(np.int64), grades)
        return pa.table({"weights": pa.array([m.weights.tolist()], pa.list_(pa.float64())), "cuts": pa.array([m.cuts.tolist()], pa.list_(pa.float64()))})

    return make


def train(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, sample: int = SAMPLE, most_features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most ``sample`` ratings of at most ``most_features`` features; ``grade``: a column of ``ratings`` from 0 to grades - 1."""
    scratch = Scratch(docs.sparkSession)
    rated = ratings.select(F.col(id_col).cast("long").alias("_rated"), grade.cast("int").alias("_grade")).where(f"_rated is not null and _grade between 0 and {grades - 1}")
    # as many ratings as the fit may see lead to as many texts at least, unless ids are missing; which of them is decided below
    rated = scratch.save(rated.orderBy(F.xxhash64("_rated", F.lit(3)), "_rated", "_grade").limit(sample), "rated")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    k0, k1 = row_key(F.col("_id"), F.col("text"))
    texts = texts.withColumns({"k0": k0, "k1": k1}).join(F.broadcast(rated), F.col("_id") == F.col("_rated"))
    chosen = texts.select("_id", "k0", "k1", "_grade").distinct().orderBy(F.xxhash64("_id", F.lit(3)), "_id", "_grade", "k0").limit(sample)
    chosen = F.broadcast(scratch.save(chosen, "chosen"))
    picked = texts.join(chosen, ["_id", "k0", "k1", "_grade"], "left_semi").select(F.col("_grade").alias("grade"), "text", F.col("k0").alias("key"))
    vectors = scratch.save(picked.mapInArrow(_vectors, "grade int, key long, dims array<int>, vals array<double>"), "vectors")
    # rows that repeat go; of the rest, which are ``sample`` at most, those that come first by their hashes and fit in
    sizes = vectors.select("key", "grade", F.size("dims").cast("long").alias("n")).distinct().withColumn("all", F.lit(0))
    sizes = sizes.withColumn("so_far", F.sum("n").over(Window.partitionBy("all").orderBy("key", "grade").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fits = F.broadcast(sizes.where(F.col("so_far") <= most_features).select("key", "grade"))
    vectors = once(vectors.join(fits, ["key", "grade"], "left_semi"), (F.col("key"), F.col("grade")))
    got = vectors.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit(grades), "weights array<double>, cuts array<double>").first()
    if got is None:
        share = np.arange(grades - 1, 0, -1) / grades
        return Model(np.zeros(DIMENSIONS), np.log((1 - share) / share))
    return Model(np.array(got["weights"]), np.array(got["cuts"]))


def score(docs: DataFrame, model: Model, top: int, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, expected_grade, tail_probability (of grade ``top`` or better) and
    kept (whether that is ``least`` or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        for b in portions(batches, 1):
            tails = shared.value.score(b.column(1))
            tail = tails[:, top - 1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], names=["id", "expected_grade", "tail_probability", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(make, "id long, expected_grade double, tail_probability double, kept boolean").withColumnRenamed("id", id_col)
