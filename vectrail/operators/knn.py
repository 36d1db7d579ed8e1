"""k-nearest-neighbour joins: queries (query_id, vec) against corpus (id, vec) to (query_id, rank, id, distance)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from vectrail.functions import metrics as M
from vectrail.operators.block import block_apart, block_dots, block_knn, block_knn_broadcast
from vectrail.plans.planner import choose_strategy
from vectrail.types import SPARSE, DataType, Metric, require_valid


def top_k(pairs: DataFrame, k: int, *, descending: bool = False) -> DataFrame:
    """Each query's k best rows, ties to the smaller id; Spark plans it as a partial and a final group limit."""
    by = F.desc("distance") if descending else F.asc("distance")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by, "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def pair_distances(queries: DataFrame, corpus: DataFrame, dtype: DataType, metric: Metric) -> DataFrame:
    """Every pair's distance by column expressions; the planner has checked that the query side is small."""
    q = queries.select("query_id", F.col("vec").alias("q_vec"))
    pairs = corpus.select("id", "vec").join(F.broadcast(q), F.lit(True), "inner")
    if metric is Metric.TANIMOTO:
        d = M.tanimoto_similarity("q_vec", "vec")
    elif dtype in SPARSE:
        d = (M.sparse_l2_distance if metric is Metric.L2 else M.sparse_cosine_distance)("q_vec", "vec")
    else:
        d = (M.l2_distance if metric is Metric.L2 else M.cosine_distance)("q_vec", "vec")
    return pairs.select("query_id", "id", d.alias("distance"))


def sparse_dots(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, id, dot) of the pairs that share a dimension. Pairs are met and added up within a task, so none is shuffled."""
    return block_dots(queries, corpus).withColumnRenamed("distance", "dot")


def sparse_apart(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, apart): the number of rows whose inner product with the query is 0. Pairs are counted within a task."""
    return block_apart(queries, corpus).groupBy("query_id").agg(F.sum("apart").alias("apart"))


def sparse_inverted(queries: DataFrame, corpus: DataFrame, k: int, metric: Metric) -> DataFrame:
    """Inverted-file search: pairs that share a dimension, and for each query enough of the rest.

    Rows without a common dimension all have dot 0: by cosine they tie at 1.0, by L2 they follow their norm. So the
    k best of them are found by walking the corpus in (norm, id) order; a query that overlaps m rows needs at most
    the first k + m rows of that order, and m is known from the join. No product of the two sides is formed.
    """
    qn = queries.select("query_id", M.sparse_norm_sq("vec").alias("q_sq"))
    cn = corpus.select("id", M.sparse_norm_sq("vec").alias("c_sq"))
    found = sparse_dots(queries, corpus)
    measure = (lambda p: M.l2_from_dot(p, F.col("q_sq"), F.col("c_sq"))) if metric is Metric.L2 else (lambda p: M.cosine_from_dot(p, F.col("q_sq"), F.col("c_sq")))
    near = found.join(qn, "query_id").join(cn, "id").select("query_id", "id", measure(F.col("dot")).alias("distance"))
    overlaps = found.groupBy("query_id").agg(F.count("*").alias("m"))
    # Only queries whose k-th overlapping row is not nearer than any row without overlap can need these.
    least = cn.agg(F.min("c_sq")).first()[0] or 0.0
    bound = F.sqrt(F.col("q_sq") + F.lit(float(least))) if metric is Metric.L2 else F.lit(1.0)
    settled = top_k(near, k).groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
    open_ = qn.join(overlaps, "query_id", "left").join(settled, "query_id", "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("kth") >= bound))
    need = open_.select("query_id", "q_sq", (F.coalesce("m", F.lit(0)) + k).alias("need"))
    by = ["c_sq", "id"] if metric is Metric.L2 else ["id"]
    most = need.agg(F.max("need")).first()[0] or 0
    walk = cn.orderBy(*by).limit(int(most)).withColumn("pos", F.row_number().over(Window.orderBy(*by)))
    wanted = need.select("query_id", "q_sq", F.explode(F.sequence(F.lit(1).cast("long"), F.col("need"))).alias("pos"))
    rest = wanted.join(walk.withColumn("pos", F.col("pos").cast("long")), "pos").join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    far = rest.select("query_id", "id", measure(F.lit(0.0)).alias("distance"))
    return top_k(near.unionByName(far), k)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, dtype: DataType, metric: Metric, strategy: str = "auto") -> DataFrame:
    """The k nearest corpus rows of each query. Ascending distance for L2 and COSINE, descending similarity for TANIMOTO.

    strategy: "expr" (column expressions, query side broadcast), "broadcast" (numpy blocks, query side broadcast),
    "block" (numpy blocks, both sides of any size), "inverted" (sparse only), or "auto", which measures the query side.
    "expr" and "inverted" make a row for every pair or every overlap and sort them, so more than EXPR_ROWS queries go to blocks
    (whose tiles of sparse rows are searched by inverted lists as well).
    """
    require_valid(dtype, metric)
    if strategy == "inverted" and dtype not in SPARSE:
        raise ValueError("only sparse vectors have an inverted strategy")
    held = None
    if strategy in ("auto", "expr", "inverted"):
        fits, held = choose_strategy(queries)
        strategy = fits if fits != "expr" or strategy == "auto" else strategy
    if strategy == "inverted":
        return sparse_inverted(queries, corpus, k, metric)
    if strategy == "expr":
        return top_k(pair_distances(queries, corpus, dtype, metric), k, descending=metric is Metric.TANIMOTO)
    if strategy not in ("block", "broadcast"):
        raise ValueError(f"unknown strategy {strategy}")
    found = block_knn(queries, corpus, k, dtype, metric) if strategy == "block" else block_knn_broadcast(queries, corpus, k, dtype, metric, held)
    best = top_k(found, k)
    return best.withColumn("distance", -F.col("distance")) if metric is Metric.TANIMOTO else best


def check_dims(df: DataFrame, dim: int, vec: str = "vec") -> None:
    if df.where(F.size(vec) != dim).limit(1).count():
        raise ValueError(f"a vector's dimension differs from {dim}")
