import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.functions import encoding as E
from vectrail.functions import metrics as M
from vectrail.operators import block
from vectrail.operators.evaluate import latency_percentiles, median_time
from vectrail.operators.index import DenseIndex
from vectrail.operators.ivf import IVFIndex
from vectrail.operators.kmeans import kmeans, kmeans_pp_init, step
from vectrail.operators.knn import knn_join
from vectrail.sources.tables import as_queries, clustered, uniform, write_records
from vectrail.streaming import ingest
from vectrail.types import DataType, Metric, vector_type

VEC = "id long, vec array<double>"


def frame(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], VEC)


def brute(q, c, k):
    out = {}
    for i, a in enumerate(q):
        d = np.sqrt(((a - c) ** 2).sum(axis=1))
        out[i] = [int(j) for j in np.lexsort((np.arange(len(c)), d))[:k]]
    return out


@pytest.mark.parametrize("offset,spread", [(0.0, 1.0), (1e5, 0.01), (1e4, 0.001), (-1e6, 0.1)])
def test_neighbours_far_from_the_origin(offset, spread):
    rng = np.random.default_rng(1)
    c = offset + spread * rng.normal(size=(5000, 64))
    q = offset + spread * rng.normal(size=(600, 64))
    qi, ids, _ = block.block_top_k(q, c, np.arange(5000), 10, DataType.DENSE_FLOAT, Metric.L2)
    want = brute(q, c, 10)
    assert all(ids[qi == i].tolist() == want[i] for i in range(600))


@pytest.mark.parametrize("strategy", ["broadcast", "block"])
def test_tiles_and_groups(spark, monkeypatch, strategy):
    monkeypatch.setattr(block, "TILE_QUERIES", 7)
    monkeypatch.setattr(block, "TILE_ROWS", 11)
    monkeypatch.setattr(block, "GROUP_BYTES", 2000)
    monkeypatch.setattr(block, "SHARE_BYTES", 3000)
    rng = np.random.default_rng(2)
    m = rng.integers(0, 4, (120, 5)).astype(float)
    got = knn_join(as_queries(frame(spark, m)), frame(spark, m), 6, DataType.DENSE_FLOAT, Metric.L2, strategy).orderBy("query_id", "rank").collect()
    want = brute(m, m, 6)
    for i in range(120):
        assert [r.id for r in got if r.query_id == i] == want[i]
    few = knn_join(as_queries(frame(spark, m)).where("query_id < 3"), frame(spark, m), 200, DataType.DENSE_FLOAT, Metric.L2, strategy)
    assert few.count() == 360
    assert knn_join(as_queries(frame(spark, m)).limit(0), frame(spark, m), 3, DataType.DENSE_FLOAT, Metric.L2, strategy).count() == 0


@pytest.mark.parametrize("metric", [Metric.L2, Metric.COSINE])
def test_inverted_file_ways_agree(spark, monkeypatch, metric):
    data = clustered(spark, 500, 8, 6).cache()
    q = as_queries(data)
    index = IVFIndex(metric, 6, 2).train(data, 3).add(data.where("id < 300")).add(data.where("id >= 300"))
    rows = lambda s: sorted(tuple(r) for r in index.search(q, 7, strategy=s).collect())
    one = rows("broadcast")
    monkeypatch.setattr("vectrail.operators.ivf.GROUP_BYTES", 1000)
    monkeypatch.setattr("vectrail.operators.ivf.SHARE_BYTES", 1500)
    assert rows("dealt") == one and len(one) == 3500
    assert index.search(q.limit(0), 3).count() == 0


def test_rows_without_ids(spark):
    a = spark.createDataFrame([("b", [1.0]), ("a", [2.0])], "k string, vec array<float>")
    b = spark.createDataFrame([("z", [3.0]), ("y", [4.0])], "k string, vec array<float>")
    index = DenseIndex().add(a, ["k"]).add(b, ["k"])
    assert {r.id: r.vec[0] for r in index.corpus.collect()} == {0: 2.0, 1: 1.0, 2: 4.0, 3: 3.0}
    many = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"))
    assert [r.id for r in E.with_ids(many, ["k"]).orderBy("k").collect()] == list(range(5000))


def test_seeds_of_a_hot_vector(spark):
    """A vector with most of the copies does not fill the sample of seeds."""
    rows = [[1.0, 1.0]] * 900 + [[10.0, 0.0]] * 3 + [[0.0, 10.0]] * 3
    df = frame(spark, np.array(rows))
    assert len({tuple(s) for s in kmeans_pp_init(df, 3, Metric.L2, sample_rows=3)}) == 3
    c, _ = kmeans(df, 3, Metric.L2)
    assert sorted(map(tuple, c.round(6).tolist())) == [(0.0, 10.0), (1.0, 1.0), (10.0, 0.0)]
    sums, counts, name = step(df, c, Metric.L2)
    assert counts.sum() == 906 and name == step(df.repartition(3), c, Metric.L2)[2] != step(df, c[::-1], Metric.L2)[2]


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "us double")
    assert list(latency_percentiles(none).first()) == [None] * 3 and median_time(none).first()[0] is None
    odd = spark.createDataFrame([(1.5,), (None,), (1.5,), (9.0,)], "us double")
    assert list(latency_percentiles(odd).first()) == [1.5, 1.5, 1.5] and median_time(odd).first()[0] == 1.5


def test_records_and_generators(spark, tmp_path):
    rows = uniform(spark, 50, 3, 2.0, 4.0)
    assert rows.where(F.exists("vec", lambda x: (x < 2) | (x > 4))).count() == 0
    write_records(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 50
    assert vector_type(DataType.BINARY).simpleString() == "array<bigint>"
    assert rows.select(M.norm("vec").alias("n")).where("n < 3").count() == 0


def test_streams_of_queries(spark, tmp_path, monkeypatch):
    data = clustered(spark, 40, 4, 4)
    data.write.parquet(str(tmp_path / "corpus"))
    corpus = spark.read.parquet(str(tmp_path / "corpus"))
    as_queries(corpus).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(as_queries(corpus).schema).parquet(str(tmp_path / "in"))
    pairs = ingest.stream_pair_distances(stream(), corpus, Metric.L2)
    q = pairs.writeStream.format("parquet").option("path", str(tmp_path / "pairs")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1600
    found = ingest.search_stream(stream(), lambda b: knn_join(b, corpus, 3, DataType.DENSE_FLOAT, Metric.L2), str(tmp_path / "found"), str(tmp_path / "c2"))
    found.processAllAvailable()
    found.stop()
    out = spark.read.parquet(str(tmp_path / "found"))
    assert out.count() == 120 and out.where("rank = 1 AND id = query_id").count() == 40
    monkeypatch.setattr(ingest, "BROADCAST_ROWS", 10)
    with pytest.raises(ValueError):
        ingest.stream_pair_distances(stream(), corpus, Metric.L2)
