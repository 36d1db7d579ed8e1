"""Registered queries through the public classes, the other search strategies and the small functions, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vectrail.functions import encoding as E
from vectrail.functions import metrics as M
from vectrail.operators.evaluate import latency_percentiles, median_time, speedup_cells
from vectrail.operators.index import BinaryIndex, DenseIndex, SparseIndex, TiledDenseIndex, VectorIndex, wide
from vectrail.operators.ivf import IVFIndex
from vectrail.operators.kmeans import assign, centroids_frame, kmeans, rank_distances, step, unit
from vectrail.operators.knn import knn_join
from vectrail.plans.catalog import C0, COS, K, L2, LISTS, SP, SPL2, TOP, UV, V, angle_sql, bits_table, ivf_sql, pairs_sql, query, rounded, seeds, sparse_table, tanimoto_sql
from vectrail.sources.tables import as_queries, dense_table, gaussian, table, uniform
from vectrail.types import DataType, Metric, data_type_name, is_valid_combination, metric_name, vector_type

BRUTE_L2 = f"WITH {V}, {pairs_sql(L2)} {TOP.format('', K)}"
BRUTE_COS = f"WITH {V}, {pairs_sql(COS)} {TOP.format('', K)}"
SIGN_BITS = tanimoto_sql("[x > 0 FOR x IN embedding]")


@query("index_dense_l2", BRUTE_L2)
def index_dense_l2(spark, d):
    v = dense_table(spark, d)
    index = DenseIndex(Metric.L2).add(v.where("id % 2 = 0")).add(v.where("id % 2 = 1"))
    index.validate()
    return rounded(index.search(as_queries(v), K))


@query("index_facade_cosine", BRUTE_COS)
def index_facade_cosine(spark, d):
    v = dense_table(spark, d)
    return rounded(VectorIndex(DataType.DENSE_FLOAT, Metric.COSINE).add(v).search(as_queries(v), K))


@query("index_tiled_l2", BRUTE_L2)
def index_tiled_l2(spark, d):
    v = dense_table(spark, d)
    return rounded(TiledDenseIndex(Metric.L2).add(v).search(as_queries(v), K))


@query("index_tiled_cosine", BRUTE_COS)
def index_tiled_cosine(spark, d):
    v = dense_table(spark, d)
    return rounded(TiledDenseIndex(Metric.COSINE).add(v).search(as_queries(v), K))


@query("index_sparse_cosine", f"WITH {SP}, {pairs_sql(COS, 'b', 'b')} {TOP.format('', K)}")
def index_sparse_cosine(spark, d):
    s = sparse_table(spark, d)
    index = SparseIndex(64).add(s)
    index.validate()
    return rounded(index.search(as_queries(s), K))


@query("index_binary_words", SIGN_BITS)
def index_binary_words(spark, d):
    b = bits_table(spark, d)
    return rounded(BinaryIndex(64).add(b).search(as_queries(b), K))


@query("index_binary_bools", SIGN_BITS)
def index_binary_bools(spark, d):
    v = dense_table(spark, d).select("id", F.transform("vec", lambda x: x > 0).alias("bits"))
    return rounded(BinaryIndex(64).add_bits(v).search(as_queries(bits_table(spark, d)), K))


@query("index_ordered_ids", f"WITH {V}, c AS (SELECT row_number() OVER (ORDER BY label, id) - 1 AS id, vec FROM v), {pairs_sql(L2, 'c')} {TOP.format('', K)}")
def index_ordered_ids(spark, d):
    """Rows without ids are numbered in the order of columns."""
    rows = table(spark, d, "embeddings").select(F.col("embedding").alias("vec"), "label", "vec_id")
    return rounded(DenseIndex(Metric.L2).add(rows, ["label", "vec_id"]).search(as_queries(dense_table(spark, d)), K))


@query("index_sizes", "SELECT count(*) AS size, 64 AS dim, true AS valid FROM embeddings")
def index_sizes(spark, d):
    v = dense_table(spark, d)
    index = DenseIndex(Metric.L2).add(v)
    index.validate()
    return spark.createDataFrame([(index.size(), index.dim, True)], "size long, dim int, valid boolean")


@query("search_wide", f"WITH {V}, {pairs_sql(L2)}, t AS ({TOP.format('', 3)}) SELECT query_id, max(CASE WHEN rank = 1 THEN id END) AS first_id, max(CASE WHEN rank = 3 THEN id END) AS third_id FROM t GROUP BY query_id")
def search_wide(spark, d):
    v = dense_table(spark, d)
    return wide(DenseIndex(Metric.L2).add(v).search(as_queries(v), 3)).select("query_id", F.col("ids")[0].alias("first_id"), F.col("ids")[2].alias("third_id"))


def few(df):
    """A small query set: column expressions serve it."""
    return as_queries(df.where("id % 25 = 0"))


def few_sql(sql: str, queries: str) -> str:
    return sql.replace(f"FROM {queries} q CROSS", f"FROM (SELECT * FROM {queries} WHERE id % 25 = 0) q CROSS")


@query("dense_l2_expr", few_sql(BRUTE_L2, "v"))
def dense_l2_expr(spark, d):
    v = dense_table(spark, d)
    return rounded(knn_join(few(v), v, K, DataType.DENSE_FLOAT, Metric.L2, "expr"))


@query("dense_cosine_expr", few_sql(BRUTE_COS, "v"))
def dense_cosine_expr(spark, d):
    v = dense_table(spark, d)
    return rounded(knn_join(few(v), v, K, DataType.DENSE_FLOAT, Metric.COSINE, "expr"))


@query("sparse_cosine_expr", few_sql(f"WITH {SP}, {pairs_sql(COS, 'b', 'b')} {TOP.format('', K)}", "b"))
def sparse_cosine_expr(spark, d):
    s = sparse_table(spark, d)
    return rounded(knn_join(few(s), s, K, DataType.SPARSE_FLOAT, Metric.COSINE, "expr"))


@query("sparse_l2_expr", few_sql(f"WITH {SP}, {pairs_sql(SPL2, 'b', 'b')} {TOP.format('', K)}", "b"))
def sparse_l2_expr(spark, d):
    s = sparse_table(spark, d)
    return rounded(knn_join(few(s), s, K, DataType.SPARSE_FLOAT, Metric.L2, "expr"))


@query("binary_tanimoto_expr", few_sql(SIGN_BITS, "n"))
def binary_tanimoto_expr(spark, d):
    b = bits_table(spark, d)
    return rounded(knn_join(few(b), b, K, DataType.BINARY, Metric.TANIMOTO, "expr"))


@query("sparse_cosine_inverted", f"WITH {SP}, {pairs_sql(COS, 'b', 'b')} {TOP.format('', K)}")
def sparse_cosine_inverted(spark, d):
    s = sparse_table(spark, d)
    return rounded(knn_join(as_queries(s), s, K, DataType.SPARSE_FLOAT, Metric.COSINE, "inverted"))


@query("sparse_l2_inverted", f"WITH {SP}, {pairs_sql(SPL2, 'b', 'b')} {TOP.format('', K)}")
def sparse_l2_inverted(spark, d):
    s = sparse_table(spark, d)
    return rounded(knn_join(as_queries(s), s, K, DataType.SPARSE_FLOAT, Metric.L2, "inverted"))


FAR = f"WITH v AS (SELECT vec_id AS id, [x * 0.01::DOUBLE + 100000 FOR x IN embedding::DOUBLE[]] AS vec FROM embeddings), {pairs_sql(L2)} {TOP.format('', K)}"


def far_table(spark, d):
    return dense_table(spark, d).select("id", F.transform("vec", lambda x: x.cast("double") * 0.01 + 100000).alias("vec"))


@query("dense_l2_far_from_origin", FAR)
def dense_l2_far_from_origin(spark, d):
    """Norms that are large against distances."""
    v = far_table(spark, d)
    return rounded(knn_join(as_queries(v), v, K, DataType.DENSE_FLOAT, Metric.L2))


@query("dense_l2_far_block", FAR)
def dense_l2_far_block(spark, d):
    v = far_table(spark, d)
    return rounded(knn_join(as_queries(v), v, K, DataType.DENSE_FLOAT, Metric.L2, "block"))


@query("ivf_trained_l2", BRUTE_L2)
def ivf_trained_l2(spark, d):
    """train, add, search with every list probed: the same rows as an exact search, whatever the lists are."""
    v = dense_table(spark, d)
    index = IVFIndex(Metric.L2, LISTS, LISTS).train(v, 3).add(v)
    index.validate()
    return rounded(index.search(as_queries(v), K))


@query("ivf_trained_cosine", BRUTE_COS)
def ivf_trained_cosine(spark, d):
    v = dense_table(spark, d)
    return rounded(IVFIndex(Metric.COSINE, LISTS, LISTS).train(v, 3).add(v).search(as_queries(v), K))


U = f"u AS ({UV[UV.index('SELECT') : -1]})"
COSINE_LISTS = f"{V}, {U}, {C0.replace('FROM v ', 'FROM u ')}, {angle_sql('a', 'c0').replace('FROM v CROSS', 'FROM u v CROSS')}, lists AS (SELECT v.id, v.vec, a.list_id FROM v JOIN a USING (id)), probes AS (SELECT id, list_id FROM (SELECT q.id, c.list_id, row_number() OVER (PARTITION BY q.id ORDER BY 1 - list_inner_product(q.vec, c.vec), c.list_id) AS r FROM u q CROSS JOIN c0 c) WHERE r <= 2), p AS (SELECT q.id AS query_id, l.id AS id, {COS.format('q.vec', 'l.vec')} AS distance FROM probes JOIN v q USING (id) JOIN lists l USING (list_id))"


@query("ivf_cosine_nprobe2", f"WITH {COSINE_LISTS.replace('AS query_id, l.id AS id,', 'AS query_id, l.id AS id,')} {TOP.format('', K)}")
def ivf_cosine_nprobe2(spark, d):
    v = dense_table(spark, d)
    index = IVFIndex(Metric.COSINE, LISTS, 2).use_centroids(unit(seeds(spark, d))).add(v)
    return rounded(index.search(as_queries(v), K))


@query("ivf_search_dealt", f"WITH {ivf_sql(2)} {TOP.format('', K)}")
def ivf_search_dealt(spark, d):
    """The way for query sets of any size."""
    v = dense_table(spark, d)
    return rounded(IVFIndex(Metric.L2, LISTS, 2).use_centroids(seeds(spark, d)).add(v).search(as_queries(v), K, strategy="dealt"))


@query("ivf_padded", f"WITH {ivf_sql(1)}, t AS ({TOP.format('', 200)}), n AS (SELECT least(200, count(*)) AS n FROM v), s AS (SELECT v.id AS query_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS rank FROM v CROSS JOIN n) SELECT s.query_id, s.rank, coalesce(t.id, -1) AS id, coalesce(t.distance, 0.0::DOUBLE) AS distance FROM s LEFT JOIN t ON t.query_id = s.query_id AND t.rank = s.rank")
def ivf_padded(spark, d):
    v = dense_table(spark, d)
    return rounded(IVFIndex(Metric.L2, LISTS, 1).use_centroids(seeds(spark, d)).add(v).search(as_queries(v), 200, pad=True))


@query("kmeans_plus_plus", f"SELECT count(*) AS n, {LISTS}::BIGINT AS lists, 0::BIGINT AS misplaced, true AS cheaper FROM embeddings")
def kmeans_plus_plus(spark, d):
    """k-means++ and Lloyd: every row has a list, no list is empty, each row's list is the nearest, and the total cost is no more
    than that under the seeds of fixed_ivf."""
    v = dense_table(spark, d)
    centroids, lists = kmeans(v, LISTS, Metric.L2)
    placed = lists.join(assign(v, centroids, Metric.L2).select("id", F.col("list_id").alias("near")), "id")
    cost = lambda c: assign(v, c, Metric.L2).join(F.broadcast(centroids_frame(spark, c)), "list_id").agg(F.sum(M.centroid_distance("vec", "centroid", Metric.L2))).first()[0] or 0.0
    cheaper = cost(centroids) <= cost(seeds(spark, d)) + 1e-9
    return placed.agg(F.count("*").alias("n"), F.count_distinct("list_id").alias("lists"), F.count_if(F.col("list_id") != F.col("near")).alias("misplaced"), F.lit(cheaper).alias("cheaper"))


@query("kmeans_converged", "SELECT 0.0::DOUBLE AS drift, 0::BIGINT AS moved")
def kmeans_converged(spark, d):
    """After the last pass no row moves, and the centroids are the means of their rows."""
    v = dense_table(spark, d)
    centroids, lists = kmeans(v, LISTS, Metric.L2, 200, init=seeds(spark, d))
    sums, counts, _ = step(v, centroids, Metric.L2)
    new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    moved = lists.join(assign(v, new, Metric.L2).select("id", F.col("list_id").alias("now")), "id").where("list_id <> now").count()
    drift = round(float(np.abs(new - centroids).max()), 6) if len(new) else 0.0
    return spark.createDataFrame([(drift, moved)], "drift double, moved long")


@query("kmeans_reseeded", f"SELECT {LISTS}::BIGINT AS lists")
def kmeans_reseeded(spark, d):
    """Lists that begin empty (all but one seed lie far away) are seeded anew from the data."""
    init = seeds(spark, d)
    init[1:] += 1000.0 * np.arange(1, len(init))[:, None]
    return kmeans(dense_table(spark, d), LISTS, Metric.L2, 10, init=init)[1].agg(F.count_distinct("list_id").alias("lists"))


@query("latency_percentiles", "SELECT v[(50 * (n - 1)) // 100 + 1] AS p50, v[(95 * (n - 1)) // 100 + 1] AS p95, v[(99 * (n - 1)) // 100 + 1] AS p99 FROM (SELECT list_sort(list(value)) AS v, count(value) AS n FROM events)")
def percentiles_of_events(spark, d):
    return latency_percentiles(table(spark, d, "events"), "value")


@query("median_time", "SELECT v[n // 2 + 1] AS median FROM (SELECT list_sort(list(value)) AS v, count(value) AS n FROM events)")
def median_of_events(spark, d):
    return median_time(table(spark, d, "events"), "value")


CELLS = "SELECT CAST(o_orderkey % 7 AS INTEGER) AS n_queries, CAST(o_custkey % 5 AS INTEGER) AS n_db, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS backend, CAST(min(o_totalprice) AS DOUBLE) AS ms FROM orders GROUP BY ALL"


@query("speedup_cells", f"WITH t AS ({CELLS}), c AS (SELECT n_queries, n_db, max(CASE WHEN backend = 'a' THEN ms END) AS a, max(CASE WHEN backend = 'b' THEN ms END) AS b FROM t GROUP BY ALL) SELECT count(*) FILTER (WHERE a / b > 1) AS faster, count(*) AS cells FROM c WHERE a IS NOT NULL AND b IS NOT NULL")
def speedup_of_orders(spark, d):
    o = table(spark, d, "orders")
    t = o.groupBy((F.col("o_orderkey") % 7).cast("int").alias("n_queries"), (F.col("o_custkey") % 5).cast("int").alias("n_db"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("backend")).agg(F.min("o_totalprice").cast("double").alias("ms"))
    return speedup_cells(t, "a", "b")


NEXT = "FROM v JOIN v w ON w.id = v.id + 1"


def neighbours(df):
    """Each row beside that with the next id."""
    return df.alias("a").join(df.select((F.col("id") - 1).alias("id"), F.col("vec").alias("next")), "id")


@query("column_measures", f"WITH {V} SELECT v.id, round(1 - list_inner_product(v.vec, w.vec) / sqrt(list_inner_product(v.vec, v.vec) * list_inner_product(w.vec, w.vec)), 6) + 0.0 AS cosine, round(list_distance(v.vec, w.vec), 6) + 0.0 AS l2, round(1 - list_inner_product(v.vec, w.vec), 6) + 0.0 AS angle {NEXT}")
def column_measures(spark, d):
    pairs = neighbours(dense_table(spark, d))
    return rounded(pairs.select("id", M.cosine_distance("vec", "next").alias("cosine"), M.l2_distance("vec", "next").alias("l2"), M.centroid_distance("vec", "next", Metric.COSINE).alias("angle")), "cosine", "l2", "angle")


@query("column_sparse_measures", f"WITH {SP.replace('b AS', 'v AS')} SELECT v.id, round(list_inner_product(v.vec, w.vec), 6) + 0.0 AS dot, round({COS.format('v.vec', 'w.vec')}, 6) + 0.0 AS cosine, round({SPL2.format('v.vec', 'w.vec')}, 6) + 0.0 AS l2 {NEXT}")
def column_sparse_measures(spark, d):
    pairs = neighbours(sparse_table(spark, d))
    return rounded(pairs.select("id", M.sparse_dot("vec", "next").alias("dot"), M.sparse_cosine_distance("vec", "next").alias("cosine"), M.sparse_l2_distance("vec", "next").alias("l2")), "dot", "cosine", "l2")


BITS = "v AS (SELECT vec_id AS id, [x > 0 FOR x IN embedding] AS vec FROM embeddings)"
SHARED = "len([x FOR x IN list_zip(v.vec, w.vec) IF x[1] {} x[2]])"


@query("column_tanimoto", f"WITH {BITS} SELECT v.id, round({SHARED.format('AND')}::DOUBLE / {SHARED.format('OR')}, 6) AS similarity {NEXT}")
def column_tanimoto(spark, d):
    return rounded(neighbours(bits_table(spark, d)).select("id", M.tanimoto_similarity("vec", "next").alias("similarity")), "similarity")


@query("sql_functions", f"WITH {V} SELECT v.id, round(list_inner_product(v.vec, w.vec), 6) + 0.0 AS dot, round(list_distance(v.vec, w.vec), 6) + 0.0 AS l2, round({COS.format('v.vec', 'w.vec')}, 6) + 0.0 AS cosine {NEXT}")
def sql_functions(spark, d):
    M.register_sql(spark)
    pairs = neighbours(dense_table(spark, d))
    each = pairs.select("id", F.col("vec").cast("array<double>").alias("a"), F.col("next").cast("array<double>").alias("b"))
    return rounded(each.select("id", F.expr("vec_dot(a, b)").alias("dot"), F.expr("vec_l2(a, b)").alias("l2"), F.expr("vec_cosine(a, b)").alias("cosine")), "dot", "l2", "cosine")


@query("sql_tanimoto", f"WITH {BITS} SELECT v.id, round({SHARED.format('AND')}::DOUBLE / {SHARED.format('OR')}, 6) AS similarity {NEXT}")
def sql_tanimoto(spark, d):
    M.register_sql(spark)
    return rounded(neighbours(bits_table(spark, d)).select("id", F.expr("vec_tanimoto(vec, next)").alias("similarity")), "similarity")


PAIRS = "('dense_float', 'l2'), ('dense_int32', 'l2'), ('sparse_float', 'l2'), ('dense_float', 'cosine'), ('dense_int32', 'cosine'), ('sparse_float', 'cosine'), ('sparse_int32', 'cosine'), ('binary', 'tanimoto')"


@query("admissible_pairs", f"SELECT d.name AS dtype, m.name AS metric, EXISTS (SELECT 1 FROM (VALUES {PAIRS}) p(d, m) WHERE p.d = d.name AND p.m = m.name) AS valid FROM (VALUES ('dense_float'), ('dense_int32'), ('sparse_float'), ('sparse_int32'), ('binary')) d(name) CROSS JOIN (VALUES ('l2'), ('cosine'), ('tanimoto')) m(name)")
def admissible_pairs(spark, d):
    return spark.createDataFrame([(data_type_name(t), metric_name(m), is_valid_combination(t, m)) for t in DataType for m in Metric], "dtype string, metric string, valid boolean")


@query("sparse_validation", "SELECT vec_id AS id, CASE vec_id % 5 WHEN 1 THEN 'lengths differ' WHEN 2 THEN 'indices not ascending' WHEN 3 THEN 'index out of range' WHEN 4 THEN 'null' END AS problem FROM embeddings")
def sparse_validation(spark, d):
    """Rows that break the encoding in one way each."""
    i = F.array(F.lit(1), F.lit(3))
    kind = F.col("vec_id") % 5
    indices = F.when(kind == 2, F.array(F.lit(3), F.lit(1))).when(kind == 3, F.array(F.lit(1), F.lit(64))).otherwise(i)
    values = F.when(kind == 1, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).cast("array<float>")
    whole = F.struct(F.lit(64).alias("dim"), indices.alias("indices"), values.alias("values")).cast(vector_type(DataType.SPARSE_FLOAT))
    vec = F.when(kind != 4, whole)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vec.alias("vec")).select("id", E.sparse_problem("vec", 64).alias("problem"))


@query("csr_rows", "SELECT CAST(n_regionkey AS BIGINT) AS id, CAST(n_nationkey AS INTEGER) AS dim_idx, CAST(n_nationkey + 1 AS DOUBLE) AS value FROM nation")
def csr_rows(spark, d):
    """A compressed matrix on the driver (regions by nations), row by row, in long form."""
    cells = sorted((r.n_regionkey, r.n_nationkey) for r in table(spark, d, "nation").select("n_regionkey", "n_nationkey").collect())  # 25 rows at any scale
    regions = sorted({r for r, _ in cells})
    indptr = [0, *np.cumsum([sum(c[0] == r for c in cells) for r in regions]).tolist()]
    rows = [(int(r), E.csr_row(indptr, [int(c[1]) for c in cells], [float(c[1] + 1) for c in cells], i, 25)) for i, r in enumerate(regions)]
    df = spark.createDataFrame(rows, f"id long, vec {vector_type(DataType.SPARSE_FLOAT).simpleString()}")
    return E.sparse_to_long(df)


@query("blocked_rows", f"WITH {SP}, e AS (SELECT id, unnest(range(64)) AS i, unnest(vec) AS x FROM b), nz AS (SELECT id // 32 AS block, id % 32 AS lane, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k, i, x FROM e WHERE x <> 0), w AS (SELECT block, max(k) + 1 AS width FROM nz GROUP BY block), p AS (SELECT block, unnest(range(width * 32)) AS place FROM w) SELECT p.block, CAST(p.place AS INTEGER) AS place, CAST(coalesce(nz.i, 0) AS INTEGER) AS dim_idx, coalesce(nz.x, 0)::DOUBLE AS value FROM p LEFT JOIN nz ON nz.block = p.block AND nz.k * 32 + nz.lane = p.place")
def blocked_rows(spark, d):
    """Sparse rows in padded blocks of 32, cell by cell."""
    b = E.blocked_rows(sparse_table(spark, d))
    return b.select("block", F.posexplode(F.arrays_zip("indices", "values")).alias("place", "c")).select("block", "place", F.col("c.indices").alias("dim_idx"), F.col("c.values").alias("value"))


@query("generators", "SELECT 2000::BIGINT AS n, 16 AS dim, 0::BIGINT AS outside, true AS centred")
def generators(spark, d):
    """Uniform rows stay within their bounds, and normal ones have a mean near 0 and a variance near 1."""
    u = uniform(spark, 2000, 16, -1.0, 3.0)
    outside = u.where(F.exists("vec", lambda x: (x < -1) | (x > 3))).count()
    g = gaussian(spark, 2000, 16).select(F.explode("vec").alias("x")).agg(F.avg("x").alias("m"), F.var_samp("x").alias("v")).first()
    return u.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.lit(outside).cast("long").alias("outside"), F.lit(abs(g.m) < 0.05 and abs(g.v - 1) < 0.05).alias("centred"))


@query("nearest_ranking", f"WITH {V}, r AS (SELECT vec FROM v QUALIFY row_number() OVER (ORDER BY id) = 1) SELECT v.id, round(list_distance(v.vec, r.vec) * list_distance(v.vec, r.vec), 6) + 0.0 AS ranking FROM v CROSS JOIN r")
def nearest_ranking(spark, d):
    """What nearest-list searches rank on, as a column; the numpy form gives the same numbers."""
    c = seeds(spark, d)[:1]
    v = dense_table(spark, d)
    first = v.orderBy("id").limit(1).select("vec").collect()
    if first:
        assert float(rank_distances(np.array([first[0][0]], np.float64), c, Metric.L2)[0, 0]) == 0.0
    return rounded(v.join(F.broadcast(centroids_frame(spark, c))).select("id", M.centroid_distance("vec", "centroid", Metric.L2).alias("ranking")), "ranking")
