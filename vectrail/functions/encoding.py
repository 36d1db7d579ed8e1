"""Conversions between vector encodings, as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64


def words_per_row(dim: int) -> int:
    return -(-dim // WORD)


def pack_bits(bits, dim: int) -> Column:
    """array<boolean> of length dim to 64-bit words, least significant bit first, padding zero."""
    bits = F.col(bits) if isinstance(bits, str) else bits

    def word(w: Column) -> Column:
        part = F.slice(bits, w * WORD + 1, F.lit(WORD))
        ones = F.transform(part, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(ones, F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))

    return F.transform(F.sequence(F.lit(0), F.lit(words_per_row(dim) - 1)), word)


def popcount(words) -> Column:
    words = F.col(words) if isinstance(words, str) else words
    return F.aggregate(words, F.lit(0), lambda s, x: s + F.bit_count(x))


def dense_to_sparse(v, threshold: float = 0.0) -> Column:
    """Struct of the components whose absolute value is over the threshold, in index order."""
    v = F.col(v) if isinstance(v, str) else v
    kept = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.abs(s["x"]) > threshold)
    return F.struct(F.size(v).alias("dim"), kept["i"].alias("indices"), kept["x"].alias("values"))


def sparse_to_long(df: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """One row (id, dim_idx, value) for each stored entry that is not zero."""
    return df.select(id_col, F.explode(F.arrays_zip(f"{vec}.indices", f"{vec}.values")).alias("e")).select(id_col, F.col("e.indices").alias("dim_idx"), F.col("e.values").cast("double").alias("value")).where("value <> 0")


def long_to_sparse(df: DataFrame, dim: int, id_col: str = "id") -> DataFrame:
    """Long form back to one struct for each id."""
    entries = F.sort_array(F.collect_list(F.struct("dim_idx", "value")))
    return df.groupBy(id_col).agg(entries.alias("e")).select(id_col, F.struct(F.lit(dim).alias("dim"), F.col("e.dim_idx").cast("array<int>").alias("indices"), F.col("e.value").cast("array<float>").alias("values")).alias("vec"))


def csr_row(indptr, indices, values, row: int, dim: int) -> tuple[int, list[int], list[float]]:
    """Row of a compressed matrix held on the driver, in the struct's field order."""
    lo, hi = indptr[row], indptr[row + 1]
    return dim, list(indices[lo:hi]), list(values[lo:hi])


def sparse_problem(vec, dim: int) -> Column:
    """Text that says why a sparse struct is not valid; null if it is."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    i = vec["indices"]
    rising = F.forall(F.zip_with(F.slice(i, 2, F.greatest(F.size(i), F.lit(1))), i, lambda b, a: b > a), lambda ok: F.coalesce(ok, F.lit(True)))
    return (
        F.when(vec.isNull() | i.isNull() | vec["values"].isNull(), "null")
        .when(F.size(i) != F.size(vec["values"]), "lengths differ")
        .when(~rising, "indices not ascending")
        .when(F.exists(i, lambda x: (x < 0) | (x >= dim)), "index out of range")
    )


def blocked_rows(df: DataFrame, lanes: int = 32) -> DataFrame:
    """(block, width, indices, values): sparse rows (id, vec) in blocks of consecutive ids, padded to the block's longest row.

    The k-th entry of lane l (the id's place in its block) stands at k * lanes + l of both arrays; what is padded is 0 in both.
    """
    block, lane = F.floor(F.col("id") / lanes), F.pmod("id", F.lit(lanes)).cast("int")
    width = F.max(F.size("vec.indices")).alias("width")
    cells = F.transform(F.arrays_zip("vec.indices", "vec.values"), lambda e, k: F.struct((k * lanes + lane).alias("place"), e["indices"].alias("i"), e["values"].cast("double").alias("x")))
    packed = df.groupBy(block.alias("block")).agg(width, F.flatten(F.collect_list(cells)).alias("cells"))
    of = lambda name, zero: F.transform(F.sequence(F.lit(0), F.col("width") * lanes - 1), lambda p: F.coalesce(F.try_element_at(F.col(name), p), zero))
    maps = packed.select("block", "width", F.map_from_arrays("cells.place", "cells.i").alias("i"), F.map_from_arrays("cells.place", "cells.x").alias("x")).where("width > 0")
    return maps.select("block", "width", of("i", F.lit(0)).alias("indices"), of("x", F.lit(0.0)).alias("values"))


def with_ids(df: DataFrame, order_by: list[str], start: int = 0) -> DataFrame:
    """Consecutive ids in the order of the columns: rows are numbered within their range of it, and ranges by their sizes."""
    name = f"_at_{uuid.uuid4().hex}"
    # A stated number of ranges is the same in both uses of the rows.
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(ranges, *order_by).sortWithinPartitions(*order_by).withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(name, 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(F.col("part").alias(f"{name}p"), first.alias(f"{name}f"))  # a row for each range
    places = rows.join(F.broadcast(firsts), part == F.col(f"{name}p"))
    return places.select((F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(f"{name}f") + start).alias("id"), *df.columns)
