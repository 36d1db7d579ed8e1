"""Vector encodings, metrics and the pairs of them that make sense."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Metric(Enum):
    L2 = "l2"
    COSINE = "cosine"
    TANIMOTO = "tanimoto"


class DataType(Enum):
    DENSE_FLOAT = "dense_float"
    DENSE_INT32 = "dense_int32"
    SPARSE_FLOAT = "sparse_float"
    SPARSE_INT32 = "sparse_int32"
    BINARY = "binary"


# The admissible pairs.
VALID = {
    Metric.L2: {DataType.DENSE_FLOAT, DataType.DENSE_INT32, DataType.SPARSE_FLOAT},
    Metric.COSINE: {DataType.DENSE_FLOAT, DataType.DENSE_INT32, DataType.SPARSE_FLOAT, DataType.SPARSE_INT32},
    Metric.TANIMOTO: {DataType.BINARY},
}

DENSE = {DataType.DENSE_FLOAT, DataType.DENSE_INT32}
SPARSE = {DataType.SPARSE_FLOAT, DataType.SPARSE_INT32}


def metric_name(metric: Metric) -> str:
    return metric.value


def data_type_name(dtype: DataType) -> str:
    return dtype.value


def is_valid_combination(dtype: DataType, metric: Metric) -> bool:
    return dtype in VALID[metric]


def require_valid(dtype: DataType, metric: Metric) -> None:
    if not is_valid_combination(dtype, metric):
        raise ValueError(f"{dtype.value} vectors cannot be compared by {metric.value}")


def vector_type(dtype: DataType) -> T.DataType:
    """The column type that holds one vector of an encoding."""
    number = T.IntegerType() if "int32" in dtype.value else T.FloatType()
    if dtype in DENSE:
        return T.ArrayType(number)
    if dtype in SPARSE:
        return T.StructType(
            [
                T.StructField("dim", T.IntegerType()),
                T.StructField("indices", T.ArrayType(T.IntegerType())),
                T.StructField("values", T.ArrayType(number)),
            ]
        )
    return T.ArrayType(T.LongType())
