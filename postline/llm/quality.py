"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams, hashed to ``BUCKETS``: byte trigrams, and pairs of word shapes (case, digits,
last mark, length, and whether the word repeats one of the last two). Each indicator is scaled by the log-count ratio of
the classes, and a linear hinge-loss model is fitted by dual coordinate descent; a sigmoid on rows kept out of the fit
turns margins into probabilities.

The model is fitted on at most ``SAMPLE`` labelled documents (a documented bound); every document is scored, by its whole
text of any length. Defined results: a null or empty text has no features and gets the score of the intercept; an empty
table gives an empty table; other columns are carried along, but for ``score``, which is replaced; without labels every
score is 0.5; of labels that repeat an id the smallest holds, of documents that do the one with the least hash is learnt
from; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postline.llm import samples, tokens

SAMPLE = 8_000
BUCKETS = 1 << 18
SMOOTHING = 1.0
EPOCHS = 10
PENALTY = 1.0
THRESHOLD = 0.3


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, its distinct buckets."""
    shift = np.uint64(64 - 18)
    table = tokens.blank_table()
    for _, data, bounds in tokens.slices(column):
        b = data.astype(np.uint64)
        tri = b[:-2] | (b[1:-1] << np.uint64(8)) | (b[2:] << np.uint64(16)) if len(b) > 2 else b[:0]
        tri = ((tri + np.uint64(1)) * tokens.MULTIPLIER >> shift).astype(np.int32)
        words = tokens.Words(data, bounds, table)
        h = words.hashes()
        first, last = data[words.start], data[words.end - 1]
        size = words.end - words.start
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        capitals = upper[words.end] - upper[words.start]
        mark = np.where((last >= 97) & (last <= 122) | (last >= 128), 0, last)
        mark[(last >= 65) & (last <= 90)] = 1
        mark[(last >= 48) & (last <= 57)] = 2
        shape = mark.astype(np.uint64) | (np.minimum(size, 20) // 4).astype(np.uint64) << np.uint64(8) | (np.minimum(capitals, 3)).astype(np.uint64) << np.uint64(12)
        shape |= (digit[words.end] > digit[words.start]).astype(np.uint64) << np.uint64(14) | ((first >= 65) & (first <= 90)).astype(np.uint64) << np.uint64(15)
        again, docs = np.zeros(len(h), np.uint64), words.docs
        for k in (1, 2):
            again[k:] |= ((h[k:] == h[:-k]) & (docs[k:] == docs[:-k])).astype(np.uint64) << np.uint64(k - 1)
        shape |= again << np.uint64(16)
        pair = tokens.mix(shape[:-1] + (shape[1:] << np.uint64(20)) + np.uint64(1 << 50)) if len(shape) > 1 else shape[:0]
        pair = (pair >> shift).astype(np.int32)
        for i in range(len(bounds) - 1):
            t = tri[bounds[i] : max(bounds[i], bounds[i + 1] - 2)]
            p = pair[words.first[i] : max(words.first[i], words.first[i + 1] - 1)]
            yield np.unique(np.concatenate([t, p]))


@dataclass
class Model:
    """weight: of each bucket, the scaling by its ratio included; a text's margin is their sum over sqrt(sum of squared ratios)."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    a: float
    b: float

    def margins(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([self.weight[r].sum() / np.sqrt(self.square[r].sum() + 1e-9) + self.bias for r in rows])

    def scores(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        return samples.sigmoid(self.a * self.margins(rows) + self.b)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """The model for texts with these features and 0/1 labels."""
    if len(set(y.tolist())) < 2:
        at = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log((at + 1e-3) / (1 - at + 1e-3))))
    rng = np.random.default_rng(seed)
    kept_out = rng.random(len(rows)) < 0.25
    fit = np.flatnonzero(~kept_out)
    count = np.zeros((2, BUCKETS))
    for i in fit:
        count[y[i]][rows[i]] += 1
    p, q = count[1] + SMOOTHING, count[0] + SMOOTHING
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[count.sum(axis=0) == 0] = 0.0
    square = ratio * ratio
    values = [ratio[r] / np.sqrt(square[r].sum() + 1e-9) for r in rows]
    w, bias = np.zeros(BUCKETS), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([(y[fit] == 0).mean(), (y[fit] == 1).mean()])
    cap = PENALTY * 0.5 / np.maximum(share, 0.02)
    alpha = np.zeros(len(rows))
    for _ in range(EPOCHS):
        # one dual variable at a time: its best value given the others, cut to [0, cap]
        for i in rng.permutation(fit):
            r, x = rows[i], values[i]
            gradient = sign[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cap[y[i]])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * x
                bias += step
                alpha[i] = new
    model = Model((w * ratio).astype(np.float32), square.astype(np.float32), float(bias), 1.0, 0.0)
    check = np.flatnonzero(kept_out) if kept_out.sum() >= 20 else np.arange(len(rows))
    model.a, model.b = samples.fit_sigmoid(model.margins(rows[i] for i in check), y[check].astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents that ``allowed`` lets in; only their features reach the driver."""
    rows = samples.labelled_sample(docs, labels, label, allowed, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = samples.packed(list(features(b.column(b.schema.get_field_index("text")))))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("y")), made], names=["doc_id", "y", "f"])

    got = rows.mapInArrow(run, "doc_id bigint, y int, f binary").toArrow().sort_by("doc_id")
    return fit_rows(samples.unpacked(got["f"]), np.array(got["y"].to_pylist(), dtype=np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``score``, the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(text: pa.Array) -> list[pa.Array]:
        return [pa.array(held.value.scores(features(text)), pa.float64())]

    return samples.with_column(docs, ["score"], [T.StructField("score", T.DoubleType())], make)


def predicted(col: str = "score") -> Column:
    return (F.col(col) >= THRESHOLD).cast("int")
