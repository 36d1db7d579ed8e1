"""Vectors that arrive as a stream: assigned to an index's lists, or searched against a fixed corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectrail.functions import metrics as M
from vectrail.operators.ivf import IVFIndex
from vectrail.operators.kmeans import assign
from vectrail.plans.planner import BROADCAST_ROWS, at_most
from vectrail.types import Metric


def stream_into_lists(stream: DataFrame, index: IVFIndex, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each arriving (id, vec) to the Parquet table of its list, against the index's fixed centroids."""
    rows = assign(stream.select("id", "vec"), index.centroids, index.metric)
    return rows.writeStream.format("parquet").partitionBy("list_id").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def stream_pair_distances(queries: DataFrame, corpus: DataFrame, metric: Metric) -> DataFrame:
    """Distances of arriving (query_id, vec) to every row of a corpus of at most BROADCAST_ROWS rows; rank them in foreachBatch.

    A larger corpus raises: let foreachBatch call knn_join, or search an inverted file.
    """
    if not at_most(corpus, BROADCAST_ROWS):
        raise ValueError(f"the corpus of a stream's pairs has more than {BROADCAST_ROWS} rows")
    distance = (M.l2_distance if metric is Metric.L2 else M.cosine_distance)("q_vec", "vec")
    pairs = queries.withColumnRenamed("vec", "q_vec").crossJoin(F.broadcast(corpus.select("id", "vec")))
    return pairs.select("query_id", "id", distance.alias("distance"))


def search_stream(stream: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Appends what search returns for each micro-batch of (query_id, vec) to a Parquet table; a batch that is run again
    overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.select("query_id", "vec").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
