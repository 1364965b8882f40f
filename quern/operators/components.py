"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Edges that a task contracts together; so many at most are left to one task.
TOGETHER = 100_000


def _contracted(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    names, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    away = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[away]), pa.array(names[root[away]])], ["a", "b"])


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges contracted, ``TOGETHER`` at once: each vertex gets one edge to the least vertex that these edges reach."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= TOGETHER:
            yield _contracted(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            held, size = [], 0
    if size:
        yield _contracted(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same vertices: each task contracts its own, in the order in which they lie, and shuffles nothing."""
    return edges.mapInArrow(_local_stars, "a long, b long")


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], rounds: int = 60) -> DataFrame:
    """Vertex and the least vertex of its component, for every vertex that has an edge to another one.

    edges: two long columns a and b.  Alternates contractions inside a task with large-star and small-star steps, until few
    edges are left, so that the rounds grow with the logarithm of the longest path and no vertex's edges have to meet in one task.
    keep: writes a table where all executors can read it and returns it read back; it cuts the lineage of each round.
    """
    now = keep(edges.where("a <> b").select("a", "b").distinct())
    seen = None
    for _ in range(rounds):
        if now.count() < TOGETHER:  # few enough for one task, whatever the corpus
            last = now.repartition(1).mapInArrow(_local_stars, "a long, b long")
            return keep(last.select(F.col("a").alias("vertex"), F.col("b").alias("component")))
        stars = keep(contracted(now))
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.select("a", F.col("m").alias("b")).unionByName(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = keep(small.where("a <> b").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
