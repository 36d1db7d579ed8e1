"""Lloyd and spherical k-means with k-means++ seeding; each pass reads and assigns the data once and moves n_lists sums a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.types import Metric


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 0, m / np.where(n > 0, n, 1), m)


def rank_distances(m: np.ndarray, centroids: np.ndarray, metric: Metric) -> np.ndarray:
    """Squared L2, or 1 - dot of unit vectors; differences are taken directly so that equal rows tie exactly."""
    if metric is Metric.COSINE:
        return 1.0 - np.einsum("nd,cd->nc", m, centroids)
    return np.stack([((m - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(m: np.ndarray, centroids: np.ndarray, metric: Metric) -> np.ndarray:
    """Index of the nearest centroid, ties to the lowest."""
    return rank_distances(m, centroids, metric).argmin(axis=1) if len(m) else np.zeros(0, np.int64)


def _prepared(column: pa.Array, metric: Metric) -> np.ndarray:
    return unit(matrix(column)) if metric is Metric.COSINE else matrix(column)


def assign(df: DataFrame, centroids: np.ndarray, metric: Metric, vec: str = "vec") -> DataFrame:
    """df with list_id, its nearest centroid. The centroids (n_lists x dim) travel with the tasks."""
    held = df.sparkSession.sparkContext.broadcast(centroids)
    names = df.columns

    def run(batches):
        for b in batches:
            lists = nearest(_prepared(b.column(names.index(vec)), metric), held.value, metric)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists.astype(np.int32))], [*names, "list_id"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", list_id int")


def _row_names(m: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bits."""
    bits = np.ascontiguousarray(m).view(np.uint64)
    odd = np.random.default_rng(1).integers(0, 1 << 63, m.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (bits * odd).sum(axis=1, dtype=np.uint64)
    return h ^ (h >> np.uint64(29))


def step(df: DataFrame, centroids: np.ndarray, metric: Metric, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, int]:
    """One Lloyd pass: (sums, counts, a number that names the assignment).

    A task sends one row a list with its sums; rows of a list are added up before they come to the driver. Two passes with
    one number assign every row to the same list.
    """
    held = df.sparkSession.sparkContext.broadcast(centroids)
    n, dim = centroids.shape
    schema = "list_id long, n long, name long, s array<double>"

    def batch(lists, counts, names, sums):
        return pa.RecordBatch.from_arrays([pa.array(lists), pa.array(counts), pa.array(names.view(np.int64)), pa.array(list(sums), pa.list_(pa.float64()))], ["list_id", "n", "name", "s"])

    def run(batches):
        sums, counts, names = np.zeros((n, dim)), np.zeros(n, np.int64), np.zeros(n, np.uint64)
        for b in batches:
            m = _prepared(b.column(0), metric)
            if len(m):
                lists = nearest(m, held.value, metric)
                np.add.at(sums, lists, m)
                counts += np.bincount(lists, minlength=n)
                np.add.at(names, lists, _row_names(m) * (lists.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)))
        rows = np.nonzero(counts)[0]
        if len(rows):
            yield batch(rows, counts[rows], names[rows], sums[rows])

    def add(batches):
        sums, counts, names = np.zeros((n, dim)), np.zeros(n, np.int64), np.zeros(n, np.uint64)
        for b in batches:
            lists = b.column(0).to_numpy()
            np.add.at(sums, lists, matrix(b.column(3)))
            np.add.at(counts, lists, b.column(1).to_numpy())
            np.add.at(names, lists, b.column(2).to_numpy().view(np.uint64))
        rows = np.nonzero(counts)[0]
        if len(rows):
            yield batch(rows, counts[rows], names[rows], sums[rows])

    # n_lists rows come back.
    got = df.select(vec).mapInArrow(run, schema).repartition("list_id").mapInArrow(add, schema).toArrow().combine_chunks()
    sums, counts = np.zeros((n, dim)), np.zeros(n, np.int64)
    if not got.num_rows:
        return sums, counts, 0
    lists = got["list_id"].to_numpy()
    sums[lists], counts[lists] = matrix(got["s"].combine_chunks()), got["n"].to_numpy()
    return sums, counts, int(got["name"].to_numpy().view(np.uint64).sum(dtype=np.uint64))


def _sample(df: DataFrame, n: int, seed: int, vec: str) -> np.ndarray:
    """n different rows drawn by the hash of their content and a seed, whatever the partitions are; with fewer, these again."""
    rows = df.groupBy(vec).agg(F.lit(1)).select(vec).orderBy(F.xxhash64(F.col(vec), F.lit(seed)), F.col(vec)).limit(n).toArrow().combine_chunks()
    m = matrix(rows.column(0).combine_chunks()) if rows.num_rows else np.zeros((0, 0))
    return m[np.arange(n) % len(m)] if 0 < len(m) < n else m


def _weighted_sample(df: DataFrame, n: int, seed: int, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """(n different rows at most, how often each stands in the data): copies are one row, however many."""
    counts = df.groupBy(vec).agg(F.count("*").alias("n"))
    rows = counts.orderBy(F.xxhash64(F.col(vec), F.lit(seed)), F.col(vec)).limit(n).toArrow().combine_chunks()
    return (matrix(rows.column(0).combine_chunks()), rows.column(1).to_numpy().astype(np.float64)) if rows.num_rows else (np.zeros((0, 0)), np.zeros(0))


def kmeans_pp_init(df: DataFrame, n_lists: int, metric: Metric, seed: int = 42, vec: str = "vec", sample_rows: int = 20_000) -> np.ndarray:
    """k-means++ seeds from a hash sample of at most sample_rows different rows, each weighed by its copies (a documented
    bound; Lloyd passes read every row).

    The next seed is drawn in proportion to the squared L2 distance, or to 1 - cosine, from the seeds so far;
    in proportion to the copies if all these are zero.
    """
    m, weight = _weighted_sample(df, sample_rows, seed, vec)
    m = unit(m) if metric is Metric.COSINE else m
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(m), p=weight / weight.sum()))]
    best = np.full(len(m), np.inf)
    while len(chosen) < n_lists:
        best = np.minimum(best, np.maximum(0.0, rank_distances(m, m[chosen[-1:]], metric)[:, 0]))
        odds = best * weight if (best * weight).sum() > 0 else weight
        chosen.append(int(rng.choice(len(m), p=odds / odds.sum())))
    return m[chosen]


def kmeans(df: DataFrame, n_lists: int, metric: Metric, max_iter: int = 25, seed: int = 42, init: np.ndarray | None = None, vec: str = "vec") -> tuple[np.ndarray, DataFrame]:
    """(centroids, df with list_id). Stops when a pass moves no row, after one update at least.

    An empty list is seeded anew from a row of the data. The assignments are those under the returned centroids.
    """
    if metric not in (Metric.L2, Metric.COSINE):
        raise ValueError(f"k-means does not support {metric.value}")
    if n_lists <= 0:
        raise ValueError("n_lists must be positive")
    if df.limit(n_lists).count() < n_lists:
        raise ValueError("fewer rows than lists")
    if not (df.select(F.size(vec).alias("d")).first() or [0])[0]:
        raise ValueError("dimension is zero")
    centroids = kmeans_pp_init(df, n_lists, metric, seed, vec) if init is None else np.array(init, np.float64)
    before = None
    for i in range(max_iter):
        sums, counts, name = step(df, centroids, metric, vec)
        if name == before:
            break
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], 0.0)
        if (counts == 0).any():
            spare = _sample(df, int((counts == 0).sum()), seed + i + 1, vec)
            new[counts == 0] = spare[np.arange((counts == 0).sum()) % len(spare)]
        before, centroids = name, unit(new) if metric is Metric.COSINE else new
    return centroids, assign(df, centroids, metric, vec)


def centroids_frame(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(centroids)], "list_id int, centroid array<double>")
