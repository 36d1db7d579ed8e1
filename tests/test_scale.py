"""What must not grow with the square of the rows: candidates of ties, rows of pairs in a plan, a task's share."""

import numpy as np
import pytest

from vectrail.operators import block
from vectrail.operators.ivf import IVFIndex
from vectrail.operators.knn import knn_join, sparse_apart, sparse_dots
from vectrail.plans import catalog
from vectrail.sources.tables import as_queries, clustered
from vectrail.types import DataType, Metric

SPARSE = "id long, vec struct<dim:int,indices:array<int>,values:array<float>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def packed(m):
    offsets = np.concatenate([[0], np.cumsum((m != 0).sum(axis=1))])
    return offsets, np.nonzero(m)[1].astype(np.int32), m[m != 0]


def sparse_frame(spark, m):
    return spark.createDataFrame([(i, (len(r), [int(j) for j in np.nonzero(r)[0]], [float(x) for x in r[r != 0]])) for i, r in enumerate(m)], SPARSE)


@pytest.mark.parametrize("kind", ["zero vectors", "empty bits"])
def test_ties_are_not_candidates(monkeypatch, kind):
    """Most rows are one vector, which ties with all others: no candidate for each pair of them."""
    rng = np.random.default_rng(5)
    if kind == "zero vectors":
        m, dtype, metric = rng.normal(size=(3000, 8)), DataType.DENSE_FLOAT, Metric.COSINE
    else:
        m, dtype, metric = rng.integers(0, 1 << 62, (3000, 1)).astype(np.uint64), DataType.BINARY, Metric.TANIMOTO
    m[rng.permutation(3000)[:2500]] = 0
    met, merge = [0], block.TopK._merge

    def counted(self, some, qi, ids, dist):
        met[0] += len(qi)
        merge(self, some, qi, ids, dist)

    monkeypatch.setattr(block.TopK, "_merge", counted)
    ids = rng.permutation(3000)
    work = block.Nearest(np.arange(3000), m, 5, dtype, metric)
    for lo in range(0, 3000, 1000):
        work.add(m[lo : lo + 1000], ids[lo : lo + 1000])
    got = {q: [] for q in range(3000)}
    for b in work.finish():
        for q, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got[q].append(i)
    zero = np.nonzero(~m.any(axis=1))[0]
    first = sorted(ids.tolist())[:5] if metric is Metric.COSINE else sorted(ids[zero].tolist())[:5]
    assert all(got[q] == first for q in zero) and met[0] < 3000 * 100


@pytest.mark.parametrize("metric,strategy", [(Metric.L2, "expr"), (Metric.COSINE, "expr"), (Metric.L2, "inverted"), (Metric.COSINE, "inverted")])
def test_many_queries_make_no_row_for_each_pair(spark, metric, strategy):
    rng = np.random.default_rng(6)
    m = np.where(rng.random((60, 9)) < 0.3, rng.integers(-3, 4, (60, 9)), 0).astype(float)
    s = sparse_frame(spark, m)
    many = knn_join(as_queries(s), s, 4, DataType.SPARSE_FLOAT, metric, strategy)
    assert "Join" not in plan(many)
    few = knn_join(as_queries(s.where("id < 20")), s, 4, DataType.SPARSE_FLOAT, metric, strategy)
    key = lambda rows: {(r.query_id, r["rank"]): (r.id, round(r.distance, 6)) for r in rows}
    found = key(many.collect())
    assert len(found) == 240 and all(found[k] == v for k, v in key(few.collect()).items())


def test_pairs_are_not_shuffled(spark):
    rng = np.random.default_rng(7)
    m = np.where(rng.random((80, 12)) < 0.3, rng.integers(1, 4, (80, 12)), 0).astype(float)
    m[0], m[1] = 0, 0
    m[0, :2], m[1, :2] = (1, 1), (1, -1)  # these share dimensions, and their product is 0
    s = sparse_frame(spark, m)
    dots = sparse_dots(as_queries(s), s)
    assert "Join" not in plan(dots) and "hashpartitioning(query_id" not in plan(dots)
    met = (m != 0).astype(float) @ (m != 0).T
    assert {(r.query_id, r.id): r.dot for r in dots.collect()} == {(i, j): (m @ m.T)[i, j] for i, j in zip(*np.nonzero(met), strict=True)}
    assert {r.query_id: r.apart for r in sparse_apart(as_queries(s), s).collect()} == dict(enumerate((m @ m.T == 0).sum(axis=1).tolist()))


@pytest.mark.parametrize("rows", [10_000, 600_000, 20_000_000])
def test_cells_are_bounded(rows):
    cells = block._cells({0: (rows, rows * 256)}, {0: (rows, rows * 256)}, 10, 12, block.GROUP_BYTES, block.SHARE_BYTES)
    _, groups, shares = cells[0]
    assert rows * 256 / groups <= block.GROUP_BYTES and rows * 256 / shares <= block.SHARE_BYTES and rows * rows / (groups * shares) <= block.TASK_PAIRS * 1.01
    assert groups * shares >= 12 or rows < 100_000


def test_sparse_products_in_parts(monkeypatch):
    rng = np.random.default_rng(8)
    m = np.where(rng.random((50, 7)) < 0.5, rng.normal(size=(50, 7)), 0)
    e = block._Entries(packed(m))
    whole = block._dots(e, e)
    monkeypatch.setattr(block, "PRODUCTS", 3)
    assert np.array_equal(block._dots(e, e), whole) and np.allclose(whole, m @ m.T)


def test_rounding_of_pairs(spark):
    df = spark.createDataFrame([(x,) for x in (0.1234565, -0.1234565, 1e12 / 7, -1e-9, 2.5, 0.0)], "dot double")
    assert [r.dot for r in catalog.rounded_pairs(df, "dot").collect()] == [0.123457, -0.123457, round(1e12 / 7, 6), 0.0, 2.5, 0.0]


def test_recall_sweep_searches_once(spark):
    """One exact search, and one of the lists: numbers and places of lists, two sides in blocks and the search."""
    assert plan(catalog.QUERIES["ivf_recall_sweep"](spark, "/root/testdata/sf0.001")).count("MapInArrow") <= 6


def test_searches_for_several_numbers_of_lists(spark):
    data = clustered(spark, 300, 6, 5).cache()
    q = as_queries(data)
    index = IVFIndex(Metric.COSINE, 5, 5).train(data, 2).add(data)
    rows = sorted(tuple(r) for r in index.search_each(q, 4, [1, 3, 5]).collect())
    for n in (1, 3, 5):
        index.set_n_probe(n)
        assert [r[1:] for r in rows if r[0] == n] == sorted(tuple(r) for r in index.search(q, 4).collect())


def test_many_dimensions_are_met_at_once(monkeypatch):
    """Work follows the entries that meet, not a loop over dimensions."""
    rng = np.random.default_rng(9)
    dims = rng.permutation(1 << 20)[:40_000].astype(np.int32).reshape(400, 100)
    dims[200:] = dims[:200]  # each row and its double share all dimensions, and no others
    dims.sort(axis=1)
    rows = np.arange(401) * 100, dims.ravel(), rng.integers(1, 9, 40_000).astype(np.float32)
    parts, products = [0], block._products

    def counted(q, c):
        for p in products(q, c):
            parts[0] += 1
            yield p

    monkeypatch.setattr(block, "_products", counted)
    qi, ids, dist = block.block_top_k(rows, rows, np.arange(400), 3, DataType.SPARSE_FLOAT, Metric.COSINE)
    near = {q: [(i, round(d, 9)) for i, d in zip(ids[qi == q].tolist(), dist[qi == q].tolist(), strict=True)] for q in (0, 399)}
    assert parts[0] == 1 and [i for i, _ in near[0]] == [0, 200, 1] and [i for i, _ in near[399]] == [399, 199, 0] and near[0][2][1] == near[399][2][1] == 1.0
