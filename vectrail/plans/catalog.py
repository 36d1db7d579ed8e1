"""Registered queries of the vector operators and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.functions import encoding as E
from vectrail.functions import metrics as M
from vectrail.operators.evaluate import recall_at_k
from vectrail.operators.ivf import IVFIndex, probe
from vectrail.operators.kmeans import assign, centroids_frame, kmeans, step, unit
from vectrail.operators.knn import knn_join, sparse_apart, sparse_dots, top_k
from vectrail.sources.tables import as_queries, dense_table, table
from vectrail.types import DataType, Metric

K, LISTS = 10, 8
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names or ("distance",)})


def rounded_pairs(df: DataFrame, name: str) -> DataFrame:
    """The same without a decimal for each number, for results that are as many as pairs."""
    x = F.abs(name)
    y = F.when(x < 1e9, F.floor(x * 1e6 + 0.5) / 1e6).otherwise(F.round(x, 6))
    return df.withColumn(name, F.when(F.col(name) < 0, -y).otherwise(y) + F.lit(0.0))


V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
TOP = "SELECT query_id, rank, id, round(distance, 6) + 0.0 AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance {}, id) AS INTEGER) AS rank FROM p) WHERE rank <= {}"
L2 = "sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip({0}, {1})]))"
L2 = "list_distance({0}, {1})"
COS = "CASE WHEN list_inner_product({0}, {0}) = 0 OR list_inner_product({1}, {1}) = 0 THEN 1.0::DOUBLE ELSE 1 - list_inner_product({0}, {1}) / sqrt(list_inner_product({0}, {0}) * list_inner_product({1}, {1})) END"


def pairs_sql(distance: str, corpus: str = "v", queries: str = "v") -> str:
    return f"p AS (SELECT q.id AS query_id, c.id AS id, {distance.format('q.vec', 'c.vec')} AS distance FROM {queries} q CROSS JOIN {corpus} c)"


def dense_knn(spark, d, metric, corpus=None, k=K):
    v = dense_table(spark, d)
    return rounded(knn_join(as_queries(v), v if corpus is None else corpus, k, DataType.DENSE_FLOAT, metric))


@query("dense_l2_knn", f"WITH {V}, {pairs_sql(L2)} {TOP.format('', K)}")
def dense_l2_knn(spark, d):
    return dense_knn(spark, d, Metric.L2)


@query("dense_cosine_knn", f"WITH {V}, {pairs_sql(COS)} {TOP.format('', K)}")
def dense_cosine_knn(spark, d):
    return dense_knn(spark, d, Metric.COSINE)


@query("dense_l2_knn_block", f"WITH {V}, {pairs_sql(L2)} {TOP.format('', K)}")
def dense_l2_knn_block(spark, d):
    v = dense_table(spark, d)
    return rounded(knn_join(as_queries(v), v, K, DataType.DENSE_FLOAT, Metric.L2, "block"))


@query("dense_int32_l2_knn", f"WITH v AS (SELECT vec_id AS id, [CAST(floor(x::DOUBLE * 100) AS DOUBLE) FOR x IN embedding] AS vec FROM embeddings), {pairs_sql(L2)} {TOP.format('', K)}")
def dense_int32_l2_knn(spark, d):
    v = dense_table(spark, d).select("id", F.transform("vec", lambda x: F.floor(x.cast("double") * 100).cast("int")).alias("vec"))
    return rounded(knn_join(as_queries(v), v, K, DataType.DENSE_INT32, Metric.L2))


@query("dense_centroid_measures", f"WITH {V}, s AS (SELECT label, id, vec, first_value(vec) OVER (PARTITION BY label ORDER BY id) AS ref FROM v) SELECT id, label, round(list_inner_product(vec, ref), 6) + 0.0 AS dot, round(list_distance(vec, ref) * list_distance(vec, ref), 6) + 0.0 AS l2_sq, round(sqrt(list_inner_product(vec, vec)), 6) AS norm FROM s")
def dense_centroid_measures(spark, d):
    v = dense_table(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    ref = v.groupBy("label").agg(F.min_by("vec", "id").alias("ref"))
    return rounded(v.join(ref, "label").select("id", "label", M.dot("vec", "ref").alias("dot"), M.l2_distance_sq("vec", "ref").alias("l2_sq"), M.norm("vec").alias("norm")), "dot", "l2_sq", "norm")


@query("dense_normalise", "SELECT vec_id AS id, round(list_sum([x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding::DOUBLE[]]), 6) + 0.0 AS total FROM embeddings")
def dense_normalise(spark, d):
    return rounded(dense_table(spark, d).select("id", F.aggregate(M.normalise("vec"), F.lit(0.0), lambda s, x: s + x).alias("total")), "total")


ZERO = "z AS (SELECT id, CASE WHEN id % 7 = 0 THEN [0.0::DOUBLE FOR x IN vec] ELSE vec END AS vec FROM v)"


@query("dense_knn_zero_vector", f"WITH {V}, {ZERO}, {pairs_sql(COS, 'z', 'z')} {TOP.format('', K)}")
def dense_knn_zero_vector(spark, d):
    v = dense_table(spark, d).select("id", F.when(F.col("id") % 7 == 0, F.transform("vec", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("vec")).alias("vec"))
    return rounded(knn_join(as_queries(v), v, K, DataType.DENSE_FLOAT, Metric.COSINE))


@query("dense_knn_k_gt_n", f"WITH {V}, few AS (SELECT label AS id, arg_min(vec, id) AS vec FROM v GROUP BY label), {pairs_sql(L2, 'few')} {TOP.format('', 50)}")
def dense_knn_k_gt_n(spark, d):
    e = table(spark, d, "embeddings")
    few = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).select(F.col("label").cast("long").alias("id"), "vec")
    return dense_knn(spark, d, Metric.L2, few, 50).withColumn("id", F.col("id").cast("int"))


@query("dense_incremental_add", f"WITH {V}, grown AS (SELECT id, vec FROM v UNION ALL SELECT id + 1000000, [-x FOR x IN vec] FROM v), {pairs_sql(L2, 'grown')} {TOP.format('', K)}")
def dense_incremental_add(spark, d):
    v = dense_table(spark, d)
    grown = v.unionByName(v.select((F.col("id") + 1000000).alias("id"), F.transform("vec", lambda x: -x).alias("vec")))
    return dense_knn(spark, d, Metric.L2, grown)


@query("knn_filtered", f"WITH {V}, near AS (SELECT id, vec FROM v WHERE label <> 3), {pairs_sql(COS, 'near')} {TOP.format('', K)}")
def knn_filtered(spark, d):
    near = table(spark, d, "embeddings").where("label <> 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dense_knn(spark, d, Metric.COSINE, near)


def bits_table(spark, d, words: int = 1):
    v = dense_table(spark, d)
    bits = F.transform("vec", lambda x: x > 0)
    if words == 2:
        bits = F.concat(bits, F.transform("vec", lambda x: x > F.lit(0.1).cast("float")))
    return v.select("id", E.pack_bits(bits, 64 * words).alias("vec"))


def tanimoto_sql(lists: str) -> str:
    return f"WITH b AS (SELECT vec_id AS id, {lists} AS vec FROM embeddings), e AS (SELECT id, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS x FROM b), o AS (SELECT id, i FROM e WHERE x), n AS (SELECT b.id, count(o.i) AS n FROM b LEFT JOIN o USING (id) GROUP BY b.id), s AS (SELECT q.id AS qid, c.id AS cid, count(*) AS shared FROM o q JOIN o c USING (i) GROUP BY ALL), p AS (SELECT q.id AS query_id, c.id AS id, CASE WHEN q.n + c.n = 0 THEN 1.0::DOUBLE ELSE coalesce(shared, 0)::DOUBLE / (q.n + c.n - coalesce(shared, 0)) END AS distance FROM n q CROSS JOIN n c LEFT JOIN s ON s.qid = q.id AND s.cid = c.id) {TOP.format('DESC', K)}"


@query("binary_tanimoto_knn", tanimoto_sql("[x > 0 FOR x IN embedding]"))
def binary_tanimoto_knn(spark, d):
    b = bits_table(spark, d)
    return rounded(knn_join(as_queries(b), b, K, DataType.BINARY, Metric.TANIMOTO))


@query("binary_tanimoto_128", tanimoto_sql("list_concat([x > 0 FOR x IN embedding], [x > 0.1::FLOAT FOR x IN embedding])"))
def binary_tanimoto_128(spark, d):
    b = bits_table(spark, d, 2)
    return rounded(knn_join(as_queries(b), b, K, DataType.BINARY, Metric.TANIMOTO))


@query("binary_empty_union", tanimoto_sql("[x > 0.45::FLOAT FOR x IN embedding]"))
def binary_empty_union(spark, d):
    b = dense_table(spark, d).select("id", E.pack_bits(F.transform("vec", lambda x: x > F.lit(0.45).cast("float")), 64).alias("vec"))
    return rounded(knn_join(as_queries(b), b, K, DataType.BINARY, Metric.TANIMOTO))


@query("binary_pack_popcount", "SELECT vec_id AS id, CAST(len([x FOR x IN embedding IF x > 0]) AS INTEGER) AS bits FROM embeddings")
def binary_pack_popcount(spark, d):
    return bits_table(spark, d).select("id", E.popcount("vec").alias("bits"))


def sparse_table(spark, d, threshold: float = 0.25):
    return dense_table(spark, d).select("id", E.dense_to_sparse(F.transform("vec", lambda x: x.cast("double")), threshold).alias("vec"))


SP = "b AS (SELECT vec_id AS id, [CASE WHEN abs(x) > 0.25 THEN x ELSE 0 END FOR x IN embedding::DOUBLE[]] AS vec FROM embeddings)"
SPL2 = "sqrt(greatest(0.0::DOUBLE, list_inner_product({0}, {0}) + list_inner_product({1}, {1}) - 2 * list_inner_product({0}, {1})))"


@query("sparse_cosine_knn", f"WITH {SP}, {pairs_sql(COS, 'b', 'b')} {TOP.format('', K)}")
def sparse_cosine_knn(spark, d):
    s = sparse_table(spark, d)
    return rounded(knn_join(as_queries(s), s, K, DataType.SPARSE_FLOAT, Metric.COSINE))


@query("sparse_l2_knn", f"WITH {SP}, {pairs_sql(SPL2, 'b', 'b')} {TOP.format('', K)}")
def sparse_l2_knn(spark, d):
    s = sparse_table(spark, d)
    return rounded(knn_join(as_queries(s), s, K, DataType.SPARSE_FLOAT, Metric.L2))


@query("sparse_dot_pairs", f"WITH {SP}, e AS (SELECT id, unnest(range(1, 65)) AS i, unnest(vec) AS x FROM b), o AS (SELECT * FROM e WHERE x <> 0) SELECT q.id AS query_id, c.id AS id, round(sum(q.x * c.x), 6) + 0.0 AS dot FROM o q JOIN o c USING (i) GROUP BY ALL")
def sparse_dot_pairs(spark, d):
    s = sparse_table(spark, d)
    return rounded_pairs(sparse_dots(as_queries(s), s), "dot")


@query("sparse_zero_overlap", f"WITH {SP}, {pairs_sql('list_inner_product({0}, {1})', 'b', 'b')} SELECT query_id, count(*) AS apart FROM p WHERE distance = 0 GROUP BY query_id")
def sparse_zero_overlap(spark, d):
    s = sparse_table(spark, d)
    return sparse_apart(as_queries(s), s).where("apart > 0")


SI = "g AS (SELECT l_suppkey AS id, l_partkey AS i, sum(l_quantity) AS x FROM lineitem GROUP BY ALL), n AS (SELECT id, sum(x * x) AS sq FROM g GROUP BY id), s AS (SELECT q.id AS qid, c.id AS cid, sum(q.x * c.x) AS dot FROM g q JOIN g c USING (i) GROUP BY ALL), p AS (SELECT q.id AS query_id, c.id AS id, 1 - coalesce(dot, 0) / sqrt(q.sq * c.sq) AS distance FROM n q CROSS JOIN n c LEFT JOIN s ON s.qid = q.id AND s.cid = c.id)"


@query("sparse_int_supplier_part_knn", f"WITH {SI} {TOP.format('', K)}")
def sparse_int_supplier_part_knn(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("dim_idx")).agg(F.sum("l_quantity").alias("value"))
    top = g.agg(F.max("dim_idx")).first()[0] or 0
    s = E.long_to_sparse(g, int(top) + 1)
    return rounded(knn_join(as_queries(s), s, K, DataType.SPARSE_INT32, Metric.COSINE))


TERMS = "t AS (SELECT item_id AS id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), g AS (SELECT id, w AS i, count(*)::DOUBLE AS x FROM t GROUP BY ALL)"


@query("term_cosine_knn", f"WITH {TERMS}, {SI[SI.index('n AS'):]} {TOP.format('', K)}")
def term_cosine_knn(spark, d):
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.split(F.lower("text"), " ")).alias("w"))
    g = words.groupBy("id", "w").count()
    vocabulary = E.with_ids(g.select("w").distinct(), ["w"]).select("w", F.col("id").alias("dim_idx"))
    s = E.long_to_sparse(g.join(vocabulary, "w").select("id", "dim_idx", F.col("count").cast("double").alias("value")), 2**31 - 1)
    return rounded(knn_join(as_queries(s), s, K, DataType.SPARSE_FLOAT, Metric.COSINE))


def seeds(spark, d) -> np.ndarray:
    """The first vectors by id as fixed centroids, so that SQL can follow."""
    return np.array([r[0] for r in dense_table(spark, d).orderBy("id").limit(LISTS).select("vec").collect()], np.float64)


C0 = f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS list_id, vec FROM v QUALIFY row_number() OVER (ORDER BY id) <= {LISTS})"


def nearest_sql(name: str, centroids: str) -> str:
    return f"{name} AS (SELECT v.id, v.vec, arg_min(c.list_id, (list_distance(v.vec, c.vec), c.list_id)) AS list_id FROM v CROSS JOIN {centroids} c GROUP BY v.id, v.vec)"


def means_sql(name: str, lists: str) -> str:
    return f"{name}_e AS (SELECT list_id, unnest(range(1, 65)) AS pos, unnest(vec) AS x FROM {lists}), {name}_m AS (SELECT list_id, pos, avg(x) AS x FROM {name}_e GROUP BY ALL), {name} AS (SELECT list_id, list(x ORDER BY pos) AS vec FROM {name}_m GROUP BY list_id)"


CENTRES = "SELECT list_id, CAST(unnest(range(0, 64)) AS INTEGER) AS pos, round(unnest(vec), 6) + 0.0 AS x FROM {}"


def centres(spark, m: np.ndarray) -> DataFrame:
    return rounded(centroids_frame(spark, m).select("list_id", F.posexplode("centroid").alias("pos", "x")), "x")


@query("kmeans_assign", f"WITH {V}, {C0}, {nearest_sql('a', 'c0')} SELECT id, list_id FROM a")
def kmeans_assign(spark, d):
    return assign(dense_table(spark, d), seeds(spark, d), Metric.L2).select("id", "list_id")


@query("kmeans_update_once", f"WITH {V}, {C0}, {nearest_sql('a', 'c0')}, {means_sql('c1', 'a')} {CENTRES.format('c1')}")
def kmeans_update_once(spark, d):
    sums, counts, _ = step(dense_table(spark, d), seeds(spark, d), Metric.L2)
    return centres(spark, sums / counts[:, None])


@query("kmeans_lloyd_3", f"WITH {V}, {C0}, {nearest_sql('a', 'c0')}, {means_sql('c1', 'a')}, {nearest_sql('b', 'c1')}, {means_sql('c2', 'b')}, {nearest_sql('g', 'c2')}, {means_sql('c3', 'g')} {CENTRES.format('c3')}")
def kmeans_lloyd_3(spark, d):
    return centres(spark, kmeans(dense_table(spark, d), LISTS, Metric.L2, 3, init=seeds(spark, d))[0])


UNIT = "SELECT list_id, [x / sqrt(list_inner_product(vec, vec)) FOR x IN vec] AS vec FROM {}"
UV = "v AS (SELECT vec_id AS id, [x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding::DOUBLE[]] AS vec FROM embeddings)"


def angle_sql(name: str, centroids: str) -> str:
    return nearest_sql(name, centroids).replace("list_distance(v.vec, c.vec)", "1 - list_inner_product(v.vec, c.vec)")


@query("kmeans_spherical_2", f"WITH {UV}, {C0}, {angle_sql('a', 'c0')}, {means_sql('m1', 'a')}, c1 AS ({UNIT.format('m1')}), {angle_sql('b', 'c1')}, {means_sql('m2', 'b')}, c2 AS ({UNIT.format('m2')}) {CENTRES.format('c2')}")
def kmeans_spherical_2(spark, d):
    return centres(spark, kmeans(dense_table(spark, d), LISTS, Metric.COSINE, 2, init=unit(seeds(spark, d)))[0])


def fixed_ivf(spark, d, n_probe: int, metric: Metric = Metric.L2) -> IVFIndex:
    return IVFIndex(metric, LISTS, n_probe).use_centroids(seeds(spark, d)).add(dense_table(spark, d))


def ivf_sql(n_probe: int, k: int = K) -> str:
    return f"{V}, {C0}, {nearest_sql('lists', 'c0')}, probes AS (SELECT id, vec, list_id FROM (SELECT q.id, q.vec, c.list_id, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, c.vec), c.list_id) AS r FROM v q CROSS JOIN c0 c) WHERE r <= {n_probe}), p AS (SELECT q.id AS query_id, l.id AS id, list_distance(q.vec, l.vec) AS distance FROM probes q JOIN lists l USING (list_id))"


@query("ivf_list_sizes", f"WITH {V}, {C0}, {nearest_sql('a', 'c0')} SELECT list_id, count(*) AS n FROM a GROUP BY list_id")
def ivf_list_sizes(spark, d):
    return fixed_ivf(spark, d, 1).list_sizes()


@query("ivf_probe", f"WITH {ivf_sql(3)} SELECT id AS query_id, list_id FROM probes")
def ivf_probe(spark, d):
    return probe(as_queries(dense_table(spark, d)), seeds(spark, d), 3, Metric.L2).select("query_id", "list_id")


@query("ivf_search_nprobe2", f"WITH {ivf_sql(2)} {TOP.format('', K)}")
def ivf_search_nprobe2(spark, d):
    return rounded(fixed_ivf(spark, d, 2).search(as_queries(dense_table(spark, d)), K))


@query("ivf_full_probe", f"WITH {V}, {pairs_sql(L2)} {TOP.format('', K)}")
def ivf_full_probe(spark, d):
    return rounded(fixed_ivf(spark, d, LISTS).search(as_queries(dense_table(spark, d)), K))


def recall_sql(n_probe: int) -> str:
    return f"SELECT {n_probe} AS n_probe, round(avg(r), 6) AS recall FROM (WITH {ivf_sql(n_probe)}, found AS ({TOP.format('', K)}), x AS (SELECT q.id AS query_id, c.id AS id, list_distance(q.vec, c.vec) AS distance FROM v q CROSS JOIN v c), truth AS (SELECT query_id, id FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= {K}) SELECT t.query_id, count(f.id) / {K}::DOUBLE AS r FROM truth t LEFT JOIN found f ON f.query_id = t.query_id AND f.id = t.id GROUP BY t.query_id)"


@query("ivf_recall_sweep", " UNION ALL ".join(map(recall_sql, (1, 2, 4, 8))))
def ivf_recall_sweep(spark, d):
    """One exact search and one of the lists for all numbers of probed lists."""
    v, numbers = dense_table(spark, d), [1, 2, 4, 8]
    each = F.struct("n_probe", "query_id")
    truth = knn_join(as_queries(v), v, K, DataType.DENSE_FLOAT, Metric.L2).withColumn("n_probe", F.explode(F.array(*map(F.lit, numbers))))
    found = fixed_ivf(spark, d, LISTS).search_each(as_queries(v), K, numbers)
    recall = recall_at_k(found.withColumn("query_id", each), truth.withColumn("query_id", each), K)
    return recall.groupBy("query_id.n_probe").agg(F.round(F.avg("recall"), 6).alias("recall"))


@query("label_purity_topk", f"WITH {V}, {pairs_sql(L2)}, t AS ({TOP.format('', K)}) SELECT q.label AS label, round(avg(CASE WHEN q.label = c.label THEN 1.0::DOUBLE ELSE 0 END), 6) AS purity FROM t JOIN v q ON q.id = t.query_id JOIN v c ON c.id = t.id GROUP BY q.label")
def label_purity_topk(spark, d):
    v = dense_table(spark, d)
    labels = table(spark, d, "embeddings")
    found = knn_join(as_queries(v), v, K, DataType.DENSE_FLOAT, Metric.L2)
    named = found.join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("near")), "id")
    return named.groupBy("label").agg(F.round(F.avg(F.when(F.col("label") == F.col("near"), 1.0).otherwise(0.0)), 6).alias("purity"))


@query("events_top_values", "SELECT event_type AS kind, rank, event_id AS id, value AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 10")
def events_top_values(spark, d):
    """The top-k operator on its own, over (key, id, distance) rows that no search made."""
    e = table(spark, d, "events").select(F.col("event_type").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("distance"))
    return top_k(e, K).withColumnRenamed("query_id", "kind")
