"""Index classes over DataFrames: declare an encoding and a metric, add rows, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.functions.encoding import pack_bits, sparse_problem, with_ids, words_per_row
from vectrail.operators.knn import check_dims, knn_join
from vectrail.types import DENSE, SPARSE, DataType, Metric, require_valid


class VectorIndex:
    """Exact index of one encoding and metric.

    add() takes (id, vec), or with order_by rows without ids, which are numbered in that order behind those added before;
    dense dimensions are set by the first add. No row is copied: the corpus is the union of what was added.
    """

    def __init__(self, dtype: DataType = DataType.DENSE_FLOAT, metric: Metric = Metric.L2, dim: int = 0, strategy: str = "auto"):
        require_valid(dtype, metric)
        if dtype not in DENSE and dim <= 0:
            raise ValueError("sparse and binary vectors need a dimension")
        self.dtype, self.metric, self.dim, self.strategy = dtype, metric, dim, strategy
        self.corpus: DataFrame | None = None
        self._size = 0

    def size(self) -> int:
        return self._size

    def _check_type(self, df: DataFrame) -> None:
        t = df.schema["vec"].dataType
        sparse = isinstance(t, T.StructType)
        integers = isinstance(t, T.ArrayType) and isinstance(t.elementType, T.LongType)
        if sparse != (self.dtype in SPARSE) or (self.dtype is DataType.BINARY) != integers:
            raise ValueError(f"{t.simpleString()} is not a column of {self.dtype.value} vectors")

    def _check_rows(self, df: DataFrame) -> None:
        if self.dtype in SPARSE:
            bad = df.where(sparse_problem("vec", self.dim).isNotNull()).limit(1).collect()
            if bad:
                raise ValueError("a sparse vector is not valid")
        else:
            check_dims(df, self.dim if self.dtype in DENSE else words_per_row(self.dim))

    def add(self, df: DataFrame, order_by: list[str] | None = None) -> VectorIndex:
        self._check_type(df)
        if order_by is not None:
            df = with_ids(df.select("vec", *(c for c in order_by if c != "vec")), order_by, self._size)
        first = df.select("vec").first()
        if first is None:
            return self
        if self.dtype in DENSE and not self.dim:
            self.dim = len(first[0])
        self._check_rows(df)
        self.corpus = df.select("id", "vec") if self.corpus is None else self.corpus.unionByName(df.select("id", "vec"))
        self._size += df.count()
        return self

    def add_bits(self, df: DataFrame) -> VectorIndex:
        """Rows (id, bits array<boolean>) of a binary index."""
        return self.add(df.select("id", pack_bits("bits", self.dim).alias("vec")))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        self._check_type(queries)
        if self.corpus is None:
            raise RuntimeError("the index is empty")
        self._check_rows(queries)
        return knn_join(queries, self.corpus, k, self.dtype, self.metric, self.strategy)

    def validate(self) -> None:
        """Raises if stored rows break the declared encoding or their number differs from what was added."""
        if self.corpus is None:
            return
        self._check_rows(self.corpus)
        if self.corpus.count() != self._size:
            raise ValueError("row count differs from the rows added")


class DenseIndex(VectorIndex):
    def __init__(self, metric: Metric = Metric.L2, strategy: str = "auto"):
        super().__init__(DataType.DENSE_FLOAT, metric, strategy=strategy)


class TiledDenseIndex(DenseIndex):
    """The same answers by matrix blocks, whatever the number of queries."""

    def __init__(self, metric: Metric = Metric.L2):
        super().__init__(metric, "block")


class SparseIndex(VectorIndex):
    def __init__(self, dim: int, metric: Metric = Metric.COSINE, strategy: str = "auto"):
        super().__init__(DataType.SPARSE_FLOAT, metric, dim, strategy)


class BinaryIndex(VectorIndex):
    def __init__(self, dim: int, strategy: str = "auto"):
        super().__init__(DataType.BINARY, Metric.TANIMOTO, dim, strategy)


def wide(result: DataFrame) -> DataFrame:
    """One row for each query, with its ids and distances in rank order."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "id", "distance")))
    return result.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.col("r.id").alias("ids"), F.col("r.distance").alias("distances"))
