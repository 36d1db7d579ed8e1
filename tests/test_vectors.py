import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.functions import encoding as E
from vectrail.functions import metrics as M
from vectrail.operators.evaluate import latency_percentiles, mean_recall, median_time, speedup_cells
from vectrail.operators.index import BinaryIndex, DenseIndex, SparseIndex, TiledDenseIndex, VectorIndex, wide
from vectrail.operators.ivf import IVFIndex
from vectrail.operators.kmeans import kmeans
from vectrail.operators.knn import knn_join
from vectrail.sources.tables import clustered
from vectrail.types import DataType, Metric, is_valid_combination

VEC = "id long, vec array<float>"


def frame(spark, rows, schema=VEC):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], schema)


def queries(spark, rows, schema="query_id long, vec array<float>"):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], schema)


def rows(df):
    return [(r.query_id, r["rank"], r.id, r.distance) for r in df.orderBy("query_id", "rank").collect()]


def value(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(f("a", "b")).first()[0]


def test_dense_measures(spark):
    assert value(spark, [0.0, 0.0, 0.0], [3.0, 4.0, 0.0], M.l2_distance_sq) == 25
    assert value(spark, [3.0], [7.0], M.l2_distance) == 4
    assert value(spark, [1.0] * 1024, [0.0] * 1024, M.l2_distance) == 32
    for a, b, want in (([1.0, 0.0], [2.0, 0.0], 0), ([1.0, 0.0], [0.0, 1.0], 1), ([1.0, 0.0], [-1.0, 0.0], 2), ([0.0, 0.0], [1.0, 2.0], 1)):
        assert value(spark, a, b, M.cosine_distance) == pytest.approx(want)
        assert value(spark, b, a, M.cosine_distance) == pytest.approx(want)


def test_tanimoto(spark):
    df = spark.createDataFrame([([0b1100], [0b1010]), ([0], [0]), ([0], [1]), ([-1, -1], [-1, -1]), ([0b1100] * 4, [0b1010] * 4)], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(M.tanimoto_similarity("a", "b")).collect()] == pytest.approx([1 / 3, 1, 0, 1, 1 / 3])


def test_pack_bits(spark):
    for bits, want in (([1, 0, 1, 0], [5]), ([1, 1, 0], [3]), ([1] + [0] * 63 + [1], [1, 1]), ([0] * 63 + [1], [-(2**63)])):
        df = spark.createDataFrame([([bool(b) for b in bits],)], "b array<boolean>")
        assert df.select(E.pack_bits("b", len(bits))).first()[0] == want


SPARSE = "struct<dim:int,indices:array<int>,values:array<float>>"


def sparse(v):
    i = [j for j, x in enumerate(v) if x]
    return (len(v), i, [float(v[j]) for j in i])


@pytest.mark.parametrize("a,b,dot,cos,l2", [([1, 0, 2], [0, 3, 0], 0, 1, math.sqrt(14)), ([1, 2, 3], [4, 5, 6], 32, 1 - 32 / math.sqrt(14 * 77), math.sqrt(27)), ([0, 0, 0], [1, 0, 0], 0, 1, 1)])
def test_sparse_measures(spark, a, b, dot, cos, l2):
    df = spark.createDataFrame([(sparse(a), sparse(b))], f"a {SPARSE}, b {SPARSE}")
    assert list(df.select(M.sparse_dot("a", "b"), M.sparse_cosine_distance("a", "b"), M.sparse_l2_distance("a", "b")).first()) == pytest.approx([dot, cos, l2])


def test_long_form(spark):
    df = spark.createDataFrame([(0, sparse([1, 0, 2])), (1, sparse([0, 3, 0]))], f"id long, vec {SPARSE}")
    assert {r.id: r.vec.indices for r in E.long_to_sparse(E.sparse_to_long(df), 3).collect()} == {0: [0, 2], 1: [1]}
    assert E.csr_row([0, 2, 3], [0, 2, 1], [1.0, 2.0, 3.0], 1, 3) == (3, [1], [3.0])


@pytest.mark.parametrize("strategy", ["expr", "broadcast", "block"])
def test_ties_and_order(spark, strategy):
    corpus = frame(spark, [[1.0], [2.0], [2.0], [3.0], [1.0]])
    got = rows(knn_join(queries(spark, [[0.0], [2.0]]), corpus, 3, DataType.DENSE_FLOAT, Metric.L2, strategy))
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 0), (0, 2, 4), (0, 3, 1), (1, 1, 1), (1, 2, 2), (1, 3, 0)]
    assert [d for *_, d in got] == pytest.approx([1, 1, 2, 0, 0, 1])


def brute(q, c, k, metric, kind):
    out = []
    for i, a in enumerate(q):
        ds = []
        for j, b in enumerate(c):
            if metric is Metric.TANIMOTO:
                union = (a | b).sum()
                ds.append((-(1.0 if not union else (a & b).sum() / union), j))
            elif metric is Metric.L2:
                ds.append((float(np.sqrt(((a - b) ** 2).sum())), j))
            else:
                n = np.sqrt((a * a).sum() * (b * b).sum())
                ds.append((1.0 if n == 0 else float(1 - (a * b).sum() / n), j))
        ds = sorted((round(d, 9), j) for d, j in ds)[:k]
        out += [(i, r + 1, j, -d if metric is Metric.TANIMOTO else d) for r, (d, j) in enumerate(ds)]
    return out


@pytest.mark.parametrize("metric", [Metric.L2, Metric.COSINE])
@pytest.mark.parametrize("strategy", ["expr", "broadcast", "block", "inverted"])
def test_sparse_against_brute_force(spark, metric, strategy):
    rng = np.random.default_rng(3)
    c = np.where(rng.random((40, 12)) < 0.15, rng.integers(-3, 4, (40, 12)), 0).astype(float)
    q = np.where(rng.random((6, 12)) < 0.2, rng.integers(-3, 4, (6, 12)), 0).astype(float)
    got = rows(knn_join(queries(spark, [sparse(x) for x in q], f"query_id long, vec {SPARSE}"), frame(spark, [sparse(x) for x in c], f"id long, vec {SPARSE}"), 15, DataType.SPARSE_FLOAT, metric, strategy))
    want = brute(q, c, 15, metric, "sparse")
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-6)


@pytest.mark.parametrize("strategy", ["expr", "broadcast", "block"])
def test_binary_against_brute_force(spark, strategy):
    rng = np.random.default_rng(4)
    c, q = rng.random((30, 100)) < 0.3, rng.random((5, 100)) < 0.3
    pack = lambda t, i: t.select(i, E.pack_bits("vec", 100).alias("vec"))
    cf = pack(frame(spark, c.tolist(), "id long, vec array<boolean>"), "id")
    qf = pack(queries(spark, q.tolist(), "query_id long, vec array<boolean>"), "query_id")
    got = rows(knn_join(qf, cf, 7, DataType.BINARY, Metric.TANIMOTO, strategy))
    want = brute(q, c, 7, Metric.TANIMOTO, "binary")
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_index_contract(spark):
    index = DenseIndex()
    with pytest.raises(RuntimeError):
        index.search(queries(spark, [[0.0, 0.0]]), 1)
    index.add(frame(spark, [[0.0, 0.0]])).add(spark.createDataFrame([(1, [10.0, 10.0])], VEC))
    assert index.size() == 2 and rows(index.search(queries(spark, [[0.1, 0.1]]), 10))[0][2] == 0
    assert rows(index.search(queries(spark, [[0.1, 0.1]]), 0)) == []
    index.validate()
    with pytest.raises(ValueError):
        index.add(frame(spark, [[1.0, 2.0, 3.0]]))
    index.add(spark.createDataFrame([], VEC))
    assert rows(TiledDenseIndex().add(frame(spark, [[0.0, 1.0]])).search(queries(spark, [[0.0, 1.0]]), 1)) == [(0, 1, 0, 0.0)]
    with pytest.raises(ValueError):
        VectorIndex(DataType.DENSE_FLOAT, Metric.TANIMOTO)
    with pytest.raises(ValueError):
        SparseIndex(0)
    with pytest.raises(ValueError):
        SparseIndex(3).add(spark.createDataFrame([(0, (3, [2, 1], [1.0, 1.0]))], f"id long, vec {SPARSE}"))
    with pytest.raises(ValueError):
        BinaryIndex(64).add(frame(spark, [[1.0]]))
    b = BinaryIndex(64).add_bits(frame(spark, [[True] + [False] * 63, [False] * 63 + [True]], "id long, bits array<boolean>"))
    assert wide(b.search(queries(spark, [[1]], "query_id long, vec array<long>"), 2)).first().ids == [0, 1]
    assert sum(is_valid_combination(t, m) for t in DataType for m in Metric) == 8


def test_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    assert [(r.id, r.k) for r in E.with_ids(df, ["k"], 5).orderBy("id").collect()] == [(5, "a"), (6, "b"), (7, "c")]


@pytest.mark.parametrize("metric", [Metric.L2, Metric.COSINE])
def test_ivf(spark, metric):
    data = clustered(spark, 600, 16, 8).cache()
    q = data.where("id < 40").select(F.col("id").alias("query_id"), "vec")
    index = IVFIndex(metric, 8, 1)
    with pytest.raises(RuntimeError):
        index.add(data)
    index.train(data, 5).add(data)
    index.validate()
    truth = knn_join(q, data, 5, DataType.DENSE_FLOAT, metric).cache()
    recalls = []
    for n in (1, 3, 8):
        index.set_n_probe(n)
        recalls.append(mean_recall(index.search(q, 5), truth, 5))
    assert recalls == sorted(recalls) and recalls[0] >= 0.8 and recalls[-1] == 1.0
    index.set_n_probe(1)
    padded = index.search(q.limit(1), 600, pad=True)
    assert padded.count() == 600 and padded.where("id = -1 AND distance = 0.0").count() > 0
    with pytest.raises(ValueError):
        index.train(data)
    for bad in (dict(metric=Metric.TANIMOTO), dict(n_lists=0), dict(n_probe=0)):
        with pytest.raises(ValueError):
            IVFIndex(**bad)


def test_ivf_saved(spark, tmp_path):
    data = clustered(spark, 100, 4, 4).cache()
    index = IVFIndex(Metric.L2, 4, 4).train(data, 3).add(data)
    index.save(str(tmp_path / "ivf"))
    q = data.limit(3).select(F.col("id").alias("query_id"), "vec")
    assert rows(IVFIndex.load(spark, str(tmp_path / "ivf"), Metric.L2, 4).search(q, 5)) == rows(index.search(q, 5))


def test_kmeans(spark):
    data = frame(spark, [[0.0, 0.0], [0.0, 1.0], [10.0, 10.0], [10.0, 11.0]])
    c, lists = kmeans(data, 2, Metric.L2)
    assert sorted(map(tuple, c.round(6).tolist())) == [(0.0, 0.5), (10.0, 10.5)]
    assert kmeans(data, 1, Metric.L2)[0].tolist() == [[5.0, 5.5]]
    same = frame(spark, [[1.0, 1.0]] * 4)
    assert kmeans(same, 3, Metric.COSINE)[1].select("list_id").distinct().count() >= 1
    for bad in (0, 9):
        with pytest.raises(ValueError):
            kmeans(data, bad, Metric.L2)


def test_summaries(spark):
    t = spark.createDataFrame([(float(i),) for i in range(1, 101)], "us double")
    assert list(latency_percentiles(t).first()) == [50.0, 95.0, 99.0] and median_time(t).first()[0] == 51.0
    cells = spark.createDataFrame([(1, 10, "a", 2.0), (1, 10, "b", 1.0), (4, 10, "a", 1.0), (4, 10, "b", 2.0)], "n_queries int, n_db int, backend string, ms double")
    assert list(speedup_cells(cells, "a", "b").first()) == [1, 2]


def test_sql_functions(spark):
    M.register_sql(spark)
    assert spark.sql("SELECT vec_l2(array(0D, 0D), array(3D, 4D)), vec_cosine(array(0D), array(1D)), vec_tanimoto(array(12L), array(10L))").first()[0] == 5.0


def test_stream_into_lists(spark, tmp_path):
    from vectrail.streaming.ingest import stream_into_lists

    data = clustered(spark, 60, 4, 4)
    data.write.parquet(str(tmp_path / "in"))
    index = IVFIndex(Metric.L2, 4, 4).train(data, 2)
    q = stream_into_lists(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), index, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
