"""Recall, latency and throughput summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of each query's k true ids that were found. Ids of -1 do not count."""
    hits = truth.where(F.col("rank") <= k).select("query_id", "id").join(found.where((F.col("rank") <= k) & (F.col("id") >= 0)).select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int) -> float:
    return recall_at_k(found, truth, k).agg(F.avg("recall")).first()[0]


def _elements(times: DataFrame, value: str, named: dict[str, Callable[[int], int]]) -> DataFrame:
    """Elements of the sorted values, counted from 0, each at the place that its function gives for the number of values.

    Spark's percentile_disc keeps a count for each different value and adds these up by task.
    """
    n = times.where(F.col(value).isNotNull()).count()
    at = lambda place: F.expr(f"percentile_disc({(place + 0.5) / n!r}D) WITHIN GROUP (ORDER BY `{value}`)") if n else F.first(value)
    return times.agg(*(at(place(n)).alias(name) for name, place in named.items()))


def latency_percentiles(times: DataFrame, value: str = "us") -> DataFrame:
    """p50, p95 and p99 without interpolation: element floor(p * (n - 1)) of the sorted values; null without values."""
    return _elements(times, value, {f"p{p}": lambda n, p=p: p * (n - 1) // 100 for p in (50, 95, 99)})


def median_time(times: DataFrame, value: str = "us") -> DataFrame:
    """Element n // 2 of the sorted values; null without values."""
    return _elements(times, value, {"median": lambda n: n // 2})


def speedup_cells(times: DataFrame, a: str, b: str) -> DataFrame:
    """Of rows (n_queries, n_db, backend, ms): in how many cells backend b is faster than a, and of how many."""
    cells = times.groupBy("n_queries", "n_db").pivot("backend", [a, b]).agg(F.first("ms"))
    return cells.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count_if(F.col(a) / F.col(b) > 1).alias("faster"), F.count("*").alias("cells"))
