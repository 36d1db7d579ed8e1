"""Distances and similarities as column expressions, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vectrail.types import Metric


def _doubles(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm_sq(a) -> Column:
    return _total(F.transform(_doubles(a), lambda x: x * x))


def norm(a) -> Column:
    return F.sqrt(norm_sq(a))


def normalise(a) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_doubles(a), lambda x: x / n)).otherwise(_doubles(a))


def l2_distance_sq(a, b) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def l2_distance(a, b) -> Column:
    return F.sqrt(l2_distance_sq(a, b))


def cosine_distance(a, b) -> Column:
    """1 - cosine; 1.0 if either vector is zero."""
    na, nb = norm_sq(a), norm_sq(b)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1.0 - dot(a, b) / F.sqrt(na * nb))


def centroid_distance(a, centroid, metric: Metric) -> Column:
    """What nearest-centroid searches rank on: squared L2, or 1 - dot of unit vectors."""
    return l2_distance_sq(a, centroid) if metric is Metric.L2 else 1.0 - dot(a, centroid)


def tanimoto_similarity(a, b) -> Column:
    """Shared bits over set bits of two arrays of 64-bit words; 1.0 if no bit is set."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    bits = lambda w: F.aggregate(w, F.lit(0), lambda s, x: s + F.bit_count(x))
    union = bits(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    shared = bits(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared.cast("double") / union)


def sparse_dot(a, b) -> Column:
    """Inner product of two sparse structs, by lookup of a's entries in b."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    lookup = F.map_from_arrays(b["indices"], b["values"].cast("array<double>"))
    pairs = F.zip_with(a["indices"], _doubles(a["values"]), lambda i, x: x * F.coalesce(F.try_element_at(lookup, i), F.lit(0.0)))
    return _total(pairs)


def sparse_norm_sq(a) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return norm_sq(a["values"])


def sparse_cosine_distance(a, b) -> Column:
    return cosine_from_dot(sparse_dot(a, b), sparse_norm_sq(a), sparse_norm_sq(b))


def sparse_l2_distance(a, b) -> Column:
    return l2_from_dot(sparse_dot(a, b), sparse_norm_sq(a), sparse_norm_sq(b))


def cosine_from_dot(product: Column, na_sq: Column, nb_sq: Column) -> Column:
    return F.when((na_sq == 0) | (nb_sq == 0), F.lit(1.0)).otherwise(1.0 - product / F.sqrt(na_sq * nb_sq))


def l2_from_dot(product: Column, na_sq: Column, nb_sq: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), na_sq + nb_sq - 2.0 * product))


def register_sql(spark: SparkSession) -> None:
    """SQL functions vec_dot, vec_l2, vec_cosine and vec_tanimoto for this session."""
    d = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, v) -> s + v)"
    arrays = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    sq = "aggregate(transform({0}, x -> x * x), 0D, (s, v) -> s + v)"
    bits = "aggregate(zip_with(a, b, (x, y) -> bit_count(x {} y)), 0, (s, v) -> s + v)"
    for name, args, body in (
        ("vec_dot", arrays, d.format("x * y")),
        ("vec_l2", arrays, f"sqrt({d.format('(x - y) * (x - y)')})"),
        ("vec_cosine", arrays, f"if({sq.format('a')} = 0 OR {sq.format('b')} = 0, 1D, 1 - {d.format('x * y')} / sqrt({sq.format('a')} * {sq.format('b')}))"),
        ("vec_tanimoto", "a ARRAY<BIGINT>, b ARRAY<BIGINT>", f"if({bits.format('|')} = 0, 1D, {bits.format('&')} / {bits.format('|')})"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
