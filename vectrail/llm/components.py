"""Connected components of an edge list: union within partitions, then alternating stars between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import forget, map_batches, written

#: Edges of a partition, at least.
PART_EDGES = 100_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of the component of each) of the edges a, b: labels go down along edges, pointers are doubled."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[x], parent[y])
        new = parent.copy()
        for end in (parent[x], parent[y], x, y):
            np.minimum.at(new, end, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, parent):
            return nodes, nodes[parent]
        parent = new


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b), a > b, with the same components: those of each of the parts become stars."""

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            nodes, root = least_labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
            own = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], ["a", "b"])

    return map_batches(edges.select("a", "b").coalesce(parts), run, "a long, b long")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of every node of edges (a, b long), root the smallest node of its component; rows bounds the edges.

    A partition has PART_EDGES edges or more. Union: each partition's edges become stars, so that long chains collapse without a
    shuffle. Large star: each node's larger neighbours are tied to the smallest node around it. Small star: a node's smaller
    neighbours and itself are tied to the smallest of them. Repeated until only stars are left, in about log n rounds.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = written(e, "edges", rows)
    parts = max(1, (e.count() if rows is None else rows) // PART_EDGES)
    last, e = e, written(contracted(e, parts), "stars", rows)
    forget(last)
    while parts > 1 and not is_stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a")
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        last, e = e, written(contracted(small, parts), "stars", rows)
        forget(last)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def is_stars(e: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    return not ends.groupBy("node").agg(F.sum("x").alias("x"), F.max("y").alias("y")).where("x > 1 OR (x = 1 AND y = 1)").limit(1).count()


def regrouped(roots: DataFrame, links: DataFrame, rows: int | None = None) -> DataFrame:
    """roots (node, root) after more links (a, b); a node that is not in roots is its own root. Only roots are linked anew."""
    side = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
    new = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = components(new, rows)
    moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(merged), "roots", rows)
