"""Approximate maximum inner product search by score-aware anisotropic quantisation.

Vectors are coded with 4 bits for each component. Codes are chosen to minimise a loss in which the part of the
residual that is parallel to the vector weighs more than the rest, since it is what changes large inner products.
Queries scan the codes by table lookups, two codes a byte, and the best rows are scored again on the original vectors.
Codes are dealt into shares that a task holds whole, and queries stream past them: what is moved is the codes, a few times at
most, and the queries, once for each share.

Rows beyond the KEEP best codes are left out only if that is safe: where the last of a query's best exact scores is not
clear of the cut by the spread of the coding errors (near copies of one vector have nearly one code), the query meets
all vectors in blocks and is searched exactly.

Equal vectors share one code. Since ties go to smaller ids, no result needs more than the first k + 1 copies of a
vector, so a vector with any number of copies costs no more than that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.common import map_batches, table, written

#: Codebooks are fitted on at most this many vectors, those with the smallest hash; every vector is coded.
FIT_ROWS = 20_000
CENTRES = 16
#: Inner products over this share of the norms are what the loss is made for.
THRESHOLD = 0.2
KEEP = 200
#: A query is settled if its k-th exact score is so many standard deviations of the coding error above the cut.
CLEAR = 2.5
#: Queries of a block; rows that are scanned at once; bytes of a share of codes or vectors that a task holds.
QUERY_ROWS, SCAN_ROWS, SHARE_BYTES = 256, 1 << 14, 32 << 20


class Quantiser:
    def __init__(self, width: int = 1):
        self.width = width
        self.books: np.ndarray | None = None

    def _split(self, x: np.ndarray) -> np.ndarray:
        """Rows as (n, subspaces, width), padded with zeros to an even number of subspaces."""
        step = 2 * self.width
        pad = -x.shape[1] % step
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, self.width)

    def _weight(self, dim: int) -> float:
        """How much more the parallel part weighs."""
        return max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 3) -> Quantiser:
        rng = np.random.default_rng(seed)
        parts = self._split(x)
        m = parts.shape[1]
        self.books = np.stack([parts[rng.integers(0, len(x), CENTRES), j] for j in range(m)])
        for _ in range(4):  # plain k-means first
            for j in range(m):
                c = ((parts[:, j, None] - self.books[j]) ** 2).sum(2).argmin(1)
                for k in range(CENTRES):
                    if (c == k).any():
                        self.books[j, k] = parts[c == k, j].mean(0)
        extra = self._weight(x.shape[1]) - 1
        for _ in range(rounds):
            codes, par, unit = self._code(parts, 1)
            for j in range(m):
                u, p = unit[:, j], parts[:, j]
                rest = par - ((p - self.books[j][codes[:, j]]) * u).sum(1)
                for k in range(CENTRES):
                    at = codes[:, j] == k
                    if at.any():
                        a = at.sum() * np.eye(self.width) + extra * u[at].T @ u[at]
                        b = p[at].sum(0) + extra * (u[at] * (rest[at] + (u[at] * p[at]).sum(1))[:, None]).sum(0)
                        self.books[j, k] = np.linalg.solve(a, b)
                par = rest + ((p - self.books[j][codes[:, j]]) * u).sum(1)
        return self

    def _code(self, parts: np.ndarray, passes: int):
        """Coordinate descent over subspaces on |r|^2 + (weight - 1) * (parallel part)^2."""
        n, m, w = parts.shape
        norm = np.sqrt((parts**2).sum((1, 2)))
        unit = parts / np.where(norm > 0, norm, 1)[:, None, None]
        codes = np.stack([((parts[:, j, None] - self.books[j]) ** 2).sum(2).argmin(1) for j in range(m)], axis=1)
        res = parts - self.books[np.arange(m), codes]
        par = (res * unit).sum((1, 2))
        extra = self._weight(m * w) - 1
        for _ in range(passes):
            for j in range(m):
                rest = par - (res[:, j] * unit[:, j]).sum(1)
                r = parts[:, j, None] - self.books[j]
                loss = (r**2).sum(2) + extra * (rest[:, None] + (r * unit[:, j, None]).sum(2)) ** 2
                codes[:, j] = loss.argmin(1)
                res[:, j] = parts[:, j] - self.books[j][codes[:, j]]
                par = rest + (res[:, j] * unit[:, j]).sum(1)
        return codes, par, unit

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two 4-bit codes a byte."""
        codes = self._code(self._split(x), 2)[0].astype(np.uint8)
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte, the inner product that each of its 256 values stands for."""
        t = np.einsum("qmw,mkw->qmk", self._split(q), self.books).astype(np.float32)
        return (t[:, 0::2, None, :] + t[:, 1::2, :, None]).reshape(len(q), -1, 256)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part: a vector that is not null or zero, without null or non-finite components.

    If dimensions differ, only vectors of the commonest (ties: the smallest) take part. Rows without an id do not.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    v = v.where(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))
    dims = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("vec") == (dims["d"] if dims else 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, is_query, k: int = 20, keep: int = KEEP, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that is_query picks, itself left out.

    Ties go to the smaller vec_id, between copies of a vector too. Rows that usable() leaves out are neither queries nor
    candidates; vectors may have any number of components; columns besides vec_id and embedding are only read by is_query.
    An empty table gives no row.
    """
    spark = vectors.sparkSession
    v = usable(vectors)
    w = Window.partitionBy("vec").orderBy("vec_id")
    copies = v.select("vec_id", "vec", F.row_number().over(w).alias("copy")).where(F.col("copy") <= k + 1)
    copies = written(copies.withColumn("rep", F.first("vec_id").over(w)), "copies")
    reps = copies.where("copy = 1").select("rep", "vec")
    asked = v.where(is_query).join(reps, "vec").select(F.col("vec_id").alias("query_id"), "rep")
    asked = written(asked, "asked")
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(fit_rows).select("vec").toArrow().combine_chunks()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(Quantiser().fit(matrix(sample["vec"].combine_chunks())))

    def code(batches):
        """Blocks of ids and codes."""
        for b in batches:
            for lo in range(0, b.num_rows, SCAN_ROWS):
                part = b.slice(lo, SCAN_ROWS)
                yield packed(part, held.value.encode(matrix(part.column(1))))

    def whole(batches):
        """Blocks of ids and vectors."""
        for b in batches:
            for lo in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(lo, QUERY_ROWS)
                yield packed(part, matrix(part.column(1)))

    def packed(rows, data):
        ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["ids", "data"])

    def scan(coded):
        """Each query's best rows in a share, by codes or by vectors, and the least score kept if rows were left out."""

        def best_of(ids, data, qids, queries):
            best_s, best_i = np.full((len(qids), keep), -np.inf), np.full((len(qids), keep), -1, np.int64)
            tables = held.value.tables(queries) if coded else None
            for lo in range(0, len(ids), SCAN_ROWS):
                some = ids[lo : lo + SCAN_ROWS]
                block = data[:, lo : lo + SCAN_ROWS] if coded else data[lo : lo + SCAN_ROWS]
                dots = None if coded else queries @ block.T
                for r in range(len(qids)):
                    if coded:
                        t = tables[r]
                        s = t[0][block[0]]
                        for j in range(1, len(block)):
                            s += t[j][block[j]]
                    else:
                        s = dots[r]
                    near = np.arange(len(s))
                    if len(s) > keep:
                        least = np.partition(s, len(s) - keep)[len(s) - keep]
                        near = np.nonzero(s >= least - 1e-9 * (1 + abs(least)))[0]
                    s = np.concatenate([best_s[r], s[near]])
                    i = np.concatenate([best_i[r], some[near]])
                    top = np.lexsort((i, -s))[:keep]
                    best_s[r], best_i[r] = s[top], i[top]
            ok = best_i >= 0
            cut = best_s[:, -1] if coded and len(ids) > keep else np.full(len(qids), -np.inf)
            n = ok.sum(1)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(best_i[ok]), pa.array(best_s[ok]), pa.array(np.repeat(cut, n))], ["asked", "rep", "approx", "cut"])

        def run(batches):
            key, blocks, share = None, [], None
            for b in batches:
                for part, group, side, ids, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    if (part, group) != key:
                        key, blocks, share = (part, group), [], None
                    ids = np.frombuffer(ids, np.int64)
                    rows = np.frombuffer(data, np.uint8 if coded and side == 0 else np.float64).reshape(len(ids), -1)
                    if side == 0:
                        blocks.append((ids, rows))
                        continue
                    if share is None and blocks:
                        together = np.concatenate([x[1] for x in blocks])
                        share = np.concatenate([x[0] for x in blocks]), np.ascontiguousarray(together.T) if coded else together
                        blocks = []
                    if share is not None:
                        yield best_of(*share, ids, rows)

        return run

    n_reps, dim = reps.count(), len(reps.first()["vec"])
    parallel = spark.sparkContext.defaultParallelism
    order = [F.desc("score"), F.asc("vec_id")]
    score = F.aggregate(F.zip_with("q", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def best(asked_reps: DataFrame, index: DataFrame, coded: bool) -> DataFrame:
        """(asked, vec_id, score, r, settled) of the k + 1 best rows of each query."""
        row_bytes = 8 + (-(-dim // 2) if coded else 8 * dim)
        shares = max(1, -(-n_reps * row_bytes // SHARE_BYTES))
        groups = -(-parallel // shares)  # of queries, so that all cores have work
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
        q = map_batches(reps.join(asked_reps, "rep").select("rep", "vec"), whole, "ids binary, data binary")
        left = index.select(dealt(shares).alias("part"), every(groups).alias("group"), F.lit(0).alias("side"), "ids", "data")
        # The query set meets all codes (or vectors) in blocks: no pairs of rows.
        right = q.select(every(shares).alias("part"), dealt(groups).alias("group"), F.lit(1).alias("side"), "ids", "data")
        both = left.unionByName(right).repartition("part", "group").sortWithinPartitions("part", "group", "side")
        near = map_batches(both, scan(coded), "asked long, rep long, approx double, cut double")
        exact = near.join(copies.select("rep", "vec_id", "vec"), "rep").join(reps.select(F.col("rep").alias("asked"), F.col("vec").alias("q")), "asked").select("asked", "rep", "vec_id", "approx", "cut", score.alias("score"))
        of_query = Window.partitionBy("asked")
        error = F.when(F.col("rep") == F.col("vec_id"), F.col("score") - F.col("approx"))
        top = exact.withColumn("r", F.row_number().over(of_query.orderBy(*order)))
        top = top.withColumn("least", F.max(F.when(F.col("r") == k + 1, F.col("score"))).over(of_query))
        top = top.withColumn("bound", F.max("cut").over(of_query) + F.avg(error).over(of_query) + CLEAR * F.stddev_pop(error).over(of_query))
        settled = (F.col("bound") == F.lit(float("-inf"))) | F.coalesce(F.col("least") > F.col("bound"), F.lit(False))
        return written(top.where(F.col("r") <= k + 1).select("asked", "vec_id", "score", settled.alias("settled")), "best")

    index = map_batches(reps.select("rep", "vec"), code, "ids binary, data binary")
    top = best(asked.select("rep").distinct(), index, True)
    crowded = top.where("NOT settled").select(F.col("asked").alias("rep")).distinct()
    if crowded.limit(1).count():
        top = top.where("settled").unionByName(best(crowded, map_batches(reps.select("rep", "vec"), whole, "ids binary, data binary"), False))
    rows = asked.join(top, asked["rep"] == top["asked"]).where("query_id <> vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_anisotropic(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
), p AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.vec, c.vec) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
