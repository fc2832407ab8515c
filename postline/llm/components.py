"""Connected components of an edge table: edges contracted inside tasks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm.common import Scratch

#: Edges that a task contracts at a time.
BLOCK = 500_000
EDGE = "lo bigint, hi bigint"


def forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Stars with the components of the edges a-b: an edge from its smallest node to each other one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(apart := np.flatnonzero(label[a] != label[b])):
        la, lb = label[a[apart]], label[b[apart]]
        # roots are hooked under smaller ones, then every node takes its root
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[label[leaf]]), pa.array(nodes[leaf])], names=["lo", "hi"])


def blocks(edges: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for e in edges:
        held.append(e)
        size += len(e[0])
        if size >= BLOCK:
            yield forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield forest(*(np.concatenate(x) for x in zip(*held, strict=True)))


def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        yield b.column(0).to_numpy(), b.column(1).to_numpy()


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of edges (two columns) as edges (lo, hi) with the same components, fewer: a node has one smaller neighbour in each
    block of a task."""
    return blocks(columns(batches))


def contracted(edges: DataFrame) -> DataFrame:
    """``forests`` of a table of edges (a, b), less null ends and loops."""
    return edges.filter("a <> b").select("a", "b").mapInArrow(forests, EDGE)


def small_stars(edges: DataFrame) -> DataFrame:
    """Links each node's smaller neighbours to the least of them, and contracts what a task has."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        last: tuple[int, int] | None = None  # a node, and its least neighbour
        for lo, hi in columns(batches):
            if not len(lo):
                continue
            first = np.concatenate([[last is None or last[0] != hi[0]], hi[1:] != hi[:-1]])
            at = np.flatnonzero(first)
            which = np.cumsum(first) - 1
            least = np.where(which < 0, last[1] if last else 0, lo[at[np.maximum(which, 0)]] if len(at) else 0)
            other = np.where(first, hi, lo)
            use = other != least
            yield least[use], other[use]
            last = int(hi[-1]), int(least[-1])

    return edges.repartition("hi").sortWithinPartitions("hi", "lo").mapInArrow(lambda batches: blocks(stars(batches)), EDGE)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): for each node of the edges (lo, hi), the smallest node reachable.

    The edges are those that ``forests`` gives: a task contracts what it finds in blocks of bounded size, so a node with very
    many neighbours has no more edges left than there are blocks. Then, in turn, larger neighbours are linked to a node's
    least neighbour (a sum per node and a join that may be split where it is skewed), and smaller ones likewise, until only
    stars are left.
    """
    edges = scratch.cut(edges.select("lo", "hi"))
    scratch.free()
    while not is_stars(edges):
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.least(F.min("hi"), F.col("lo")).alias("least"))
        large = both.join(least, "lo").filter("hi > lo").select(F.col("least").alias("lo"), "hi").filter("lo <> hi")
        further = scratch.cut(small_stars(large))
        scratch.free(edges)
        edges = further
    ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("label")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("label"))))
    labels = scratch.cut(edges.select(ends.alias("e")).select("e.*").distinct())
    scratch.free(edges)
    return labels


def is_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or is the smallest of its own."""
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("under")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(None).cast("bigint").alias("under")))
    met = ends.groupBy("node").agg(F.min("under").alias("least"), F.max("under").alias("most"), F.bool_or(F.col("under").isNull()).alias("centre"))
    return met.filter("least < most OR (centre AND least IS NOT NULL)").count() == 0
