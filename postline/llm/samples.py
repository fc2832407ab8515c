"""Labelled samples of bounded size, and small numeric helpers that the two classifiers share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a batch that are worked on at a time.
ROWS = 1_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents that ``allowed`` (on doc_id) lets in, by the hash of doc_id.

    A doc_id with several labels has the smallest; null ids and labels are left out. Of rows that repeat a doc_id, the one
    whose text has the least hash is taken, so the sample has no more rows than ids, however often one repeats.
    """
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def with_column(docs: DataFrame, names: list[str], fields: list[T.StructField], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """docs with columns that ``make`` computes from each Arrow batch's texts; columns of these names are replaced."""
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                made = make(b.column(b.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *names])
        whole = b = made = None
        pa.default_memory_pool().release_unused()  # the worker stays, for tasks of other kinds too

    return docs.mapInArrow(run, schema)


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a m + b))) by Newton's method, with a little ridge; y in 0..1."""
    a, b = 1.0, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else 0.0
    if not len(y):
        return a, b
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * margin).sum() + 1e-2 * a, (p - y).sum()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * margin * margin).sum() + 1e-2, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def packed(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary())


def unpacked(column: pa.ChunkedArray, kind: type = np.int32) -> list[np.ndarray]:
    """The arrays of a binary column, as views of one buffer."""
    one = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    if not len(one):
        return []
    at = np.frombuffer(one.buffers()[1], np.int64, len(one) + 1, 8 * one.offset) // np.dtype(kind).itemsize
    flat = np.frombuffer(one.buffers()[2], kind) if one.buffers()[2] and at[-1] else np.zeros(0, kind)
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def release() -> None:
    """Gives back what a finished fit held: the driver has other work to do."""
    gc.collect()
    pa.default_memory_pool().release_unused()
