"""Inverted-file index: rows grouped by nearest centroid; a search reads the lists nearest to each query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.operators.block import DDL, GROUP_BYTES, SHARE_BYTES, TILE_QUERIES, Nearest, TopK, _cells, search_cells, sizes
from vectrail.operators.kmeans import assign, centroids_frame, kmeans, matrix, rank_distances, unit
from vectrail.operators.knn import check_dims, top_k
from vectrail.plans.planner import choose_strategy
from vectrail.types import DataType, Metric

#: Up to so many lists are named in the scan's filter, so that folders of others are not read.
PRUNED_LISTS = 1000


#: Multiplications that the driver does to find the lists of a broadcast query set; more are left to tasks.
DRIVER_WORK = 1 << 30


def nearest_lists(m: np.ndarray, centroids: np.ndarray, n_probe: int, metric: Metric) -> np.ndarray:
    """The n_probe nearest lists of each row, ties to the lower list."""
    d = rank_distances(unit(m) if metric is Metric.COSINE else m, centroids, metric)
    return np.argsort(d, axis=1, kind="stable")[:, :n_probe]


def probe(queries: DataFrame, centroids: np.ndarray, n_probe: int, metric: Metric) -> DataFrame:
    """(query_id, vec, list_id) of each query's n_probe nearest lists, ties to the lower list."""
    held = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = nearest_lists(matrix(b.column(1)), held.value, n_probe, metric)
            rows = np.repeat(np.arange(b.num_rows), lists.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(lists.ravel().astype(np.int32))], ["query_id", "vec", "list_id"])

    return queries.select("query_id", "vec").mapInArrow(run, f"query_id long, vec {queries.schema['vec'].dataType.simpleString()}, list_id int")


def search_broadcast(qids: np.ndarray, q: np.ndarray, number: np.ndarray, of_list: np.ndarray, lists: DataFrame, k: int, metric: Metric, n_lists: int) -> DataFrame:
    """Candidates (query_id, id, distance) of queries whose number the caller has checked: they travel with the tasks, the
    lists stay where they are, and rows of lists that no query probes are not looked at. Query number[i] probes of_list[i]."""
    # The queries of list l are by_list[first[l] : first[l + 1]].
    by_list = number[np.lexsort((number, of_list))]
    first = np.searchsorted(np.sort(of_list), np.arange(n_lists + 1))
    held = lists.sparkSession.sparkContext.broadcast((qids, q, by_list, first))

    def run(batches):
        qids, q, by_list, first = held.value
        best = TopK(q, k, DataType.DENSE_FLOAT, metric)
        for b in batches:
            if not b.num_rows:
                continue
            ids, m, lists = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy()
            order = np.argsort(lists, kind="stable")
            edge = np.append(np.nonzero(np.diff(lists[order], prepend=-1))[0], len(order))
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                rows = order[x:y]
                who = by_list[first[lists[rows[0]]] : first[lists[rows[0]] + 1]]
                if len(who):
                    best.add(m[rows], ids[rows], who)
        yield from best.batches(qids)

    asked = np.unique(of_list).tolist()
    return lists.where(F.col("list_id").isin(asked) if len(asked) < min(n_lists, PRUNED_LISTS) else F.lit(True)).select("id", "vec", "list_id").mapInArrow(run, DDL)


class _Placed(Nearest):
    """The k nearest of one list, and which place the list has among those nearest to the query."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int, metric: Metric, name: int, centroids: np.ndarray):
        super().__init__(query_ids, q, k, DataType.DENSE_FLOAT, metric)
        self.place = np.concatenate([(nearest_lists(self.best.q[at : at + TILE_QUERIES].astype(np.float64), centroids, len(centroids), metric) == name).argmax(axis=1) for at in range(0, len(self.best.q), TILE_QUERIES)])

    def finish(self):
        return self.best.batches(self.query_ids, self.of, self.place)


def search_dealt(probes: DataFrame, lists: DataFrame, k: int, metric: Metric, centroids: np.ndarray | None = None) -> DataFrame:
    """The same for any number of queries: a task holds a group of the queries of one list and streams a share of the list
    past it. Large lists have several shares, and lists that many queries probe have several groups. Where centroids are
    given, each row has the place of its list among the query's, from 0."""
    dtype, spark = DataType.DENSE_FLOAT, lists.sparkSession
    cells = _cells(*sizes(probes, lists, dtype), k, spark.sparkContext.defaultParallelism, GROUP_BYTES, SHARE_BYTES)
    q, c = probes.select("query_id", "vec", "list_id"), lists.select("id", "vec", "list_id")
    if centroids is None:
        return search_cells(q, c, cells, dtype, lambda _, ids, m: Nearest(ids, m, k, dtype, metric), DDL, k)
    held = spark.sparkContext.broadcast(centroids)
    return search_cells(q, c, cells, dtype, lambda name, ids, m: _Placed(ids, m, k, metric, name, held.value), f"{DDL}, place int", k)


class IVFIndex:
    """train once, add any number of times, search. Rows are DataFrames (id, vec)."""

    def __init__(self, metric: Metric = Metric.L2, n_lists: int = 100, n_probe: int = 10):
        if metric not in (Metric.L2, Metric.COSINE):
            raise ValueError(f"an inverted file does not support {metric.value}")
        if n_lists <= 0 or n_probe <= 0:
            raise ValueError("n_lists and n_probe must be positive")
        self.metric, self.n_lists = metric, n_lists
        self.n_probe = min(n_probe, n_lists)
        self.centroids: np.ndarray | None = None
        self.lists: DataFrame | None = None
        self._filled = False  # whether a row is known to be there

    @property
    def is_trained(self) -> bool:
        return self.centroids is not None

    @property
    def dim(self) -> int:
        return 0 if self.centroids is None else self.centroids.shape[1]

    def set_n_probe(self, n_probe: int) -> None:
        self.n_probe = max(1, min(n_probe, self.n_lists))

    def train(self, df: DataFrame, max_iter: int = 25, seed: int = 42, init: np.ndarray | None = None) -> IVFIndex:
        if self.is_trained:
            raise ValueError("the index is trained already")
        self.centroids, _ = kmeans(df, self.n_lists, self.metric, max_iter, seed, init)
        return self

    def use_centroids(self, centroids: np.ndarray) -> IVFIndex:
        self.centroids = np.array(centroids, np.float64)
        return self

    def add(self, df: DataFrame) -> IVFIndex:
        if not self.is_trained:
            raise RuntimeError("train the index before rows are added")
        check_dims(df, self.dim)
        new = assign(df.select("id", "vec"), self.centroids, self.metric)
        self.lists = new if self.lists is None else self.lists.unionByName(new)
        return self

    def size(self) -> int:
        return 0 if self.lists is None else self.lists.count()

    def search(self, queries: DataFrame, k: int, *, pad: bool = False, strategy: str = "auto") -> DataFrame:
        """The k nearest rows among each query's probed lists, exact if n_probe is n_lists.

        strategy: "broadcast" (queries travel with the tasks), "dealt" (any number of queries) or "auto", which counts them.
        pad fills rows up to min(k, size) with id -1 and distance 0.0.
        """
        if not self.is_trained:
            raise RuntimeError("train the index before it is searched")
        self._filled = self._filled or (self.lists is not None and self.lists.limit(1).count() > 0)
        if not self._filled:
            raise RuntimeError("the index is empty")
        found = top_k(self._candidates(queries, k, strategy), k)
        if not pad:
            return found
        slots = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(min(k, self.size())))).alias("rank")) if k > 0 else queries.select("query_id", F.lit(1).alias("rank")).limit(0)
        return slots.join(found, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), F.coalesce("distance", F.lit(0.0)).alias("distance"))

    def search_each(self, queries: DataFrame, k: int, n_probes: list[int]) -> DataFrame:
        """(n_probe, query_id, rank, id, distance): search() for several numbers of probed lists, which reads each list once."""
        if not self.is_trained or self.lists is None:
            raise RuntimeError("train and fill the index before it is searched")
        check_dims(queries, self.dim)
        most = min(max(n_probes), self.n_lists)
        found = search_dealt(probe(queries, self.centroids, most, self.metric), self.lists, k, self.metric, self.centroids)
        numbers = F.array_sort(F.array(*map(F.lit, n_probes)))
        each = found.withColumn("n_probe", F.explode(F.filter(numbers, lambda n: n > F.col("place"))))
        best = top_k(each.select(F.struct("n_probe", "query_id").alias("query_id"), "id", "distance"), k)
        return best.select("query_id.n_probe", "query_id.query_id", "rank", "id", "distance")

    def _candidates(self, queries: DataFrame, k: int, strategy: str) -> DataFrame:
        few, first = choose_strategy(queries) if strategy == "auto" else (strategy, None)
        if few in ("block", "dealt"):
            check_dims(queries, self.dim)
            return search_dealt(probe(queries, self.centroids, self.n_probe, self.metric), self.lists, k, self.metric)
        held = (queries.select("query_id", "vec").toArrow() if first is None else first).combine_chunks()
        if not held.num_rows:
            return queries.sparkSession.createDataFrame([], DDL)
        vec = held["vec"].combine_chunks()
        if len(vec.flatten()) != held.num_rows * self.dim or (np.diff(np.asarray(vec.offsets)) != self.dim).any():
            raise ValueError(f"a vector's dimension differs from {self.dim}")
        qids, q = held["query_id"].to_numpy(), matrix(vec)
        if q.size * self.n_lists <= DRIVER_WORK:
            lists = nearest_lists(q, self.centroids, self.n_probe, self.metric)
            number, of_list = np.repeat(np.arange(len(q)), lists.shape[1]), lists.ravel()
        else:
            got = probe(queries, self.centroids, self.n_probe, self.metric).select("query_id", "list_id").distinct().toArrow().combine_chunks()
            order = np.argsort(qids, kind="stable")
            number, of_list = order[np.searchsorted(qids[order], got["query_id"].to_numpy())], got["list_id"].to_numpy()
        return search_broadcast(qids, q, number, of_list.astype(np.int64), self.lists, k, self.metric, self.n_lists)

    def list_sizes(self) -> DataFrame:
        return self.lists.groupBy("list_id").agg(F.count("*").alias("n"))

    def validate(self) -> None:
        """Raises if a row has no list, a list is unknown, or a dimension differs."""
        if self.lists is None:
            return
        bad = self.lists.where(F.col("list_id").isNull() | (F.col("list_id") < 0) | (F.col("list_id") >= self.n_lists) | (F.size("vec") != self.dim))
        if bad.limit(1).count():
            raise ValueError("a row has a wrong list or dimension")

    def save(self, path: str) -> None:
        """Two Parquet tables; lists are partitioned by list_id, so that a search reads probed folders only."""
        centroids_frame(self.lists.sparkSession, self.centroids).write.mode("overwrite").parquet(f"{path}/centroids")
        self.lists.write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")

    @classmethod
    def load(cls, spark, path: str, metric: Metric, n_probe: int = 10) -> IVFIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
        index = cls(metric, len(rows), n_probe).use_centroids(np.array([r["centroid"] for r in rows]))
        index.lists = spark.read.parquet(f"{path}/lists").select("id", "vec", F.col("list_id").cast("int").alias("list_id"))
        return index
