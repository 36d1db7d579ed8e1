"""Exact search over blocks of vectors.

A query set of bounded size travels with the tasks, and the corpus stays where it is. Larger ones are dealt into groups, and
the corpus into shares, by a hash of the row's id; a task (cell) holds one group and streams one share past it, and the
number of cells follows the work, so that a task's time and memory stay the same when the tables grow. Nothing of the size
queries x corpus is ever held or shuffled: distances are taken for tiles of queries and rows, and a task's memory is a group,
a tile and k results a query.

Copies of a vector are all equally near. So a query's copies in a group are searched once, and of the copies in a block of
the corpus only the k with the smallest ids can be among the k nearest.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.types import DENSE, SPARSE, DataType, Metric

#: An id that no row has.
NO_ID = np.iinfo(np.int64).max
#: Queries and corpus rows of a tile of distances (at most 8 MB), and bytes of a group of queries that a task holds.
TILE_QUERIES, TILE_ROWS, GROUP_BYTES = 512, 2048, 32 << 20
#: Bytes of the corpus that a task streams past a group of queries, at most.
SHARE_BYTES = 64 << 20
#: Pairs that a task compares, about, and bytes of a block of rows and of all blocks that a task fills at once.
TASK_PAIRS, BLOCK_BYTES, HELD_BYTES = 2 << 30, 256 << 10, 32 << 20
#: Products of a sparse tile that are held at once, and results of a batch.
PRODUCTS, BATCH_ROWS = 1 << 20, 1 << 18
#: Partitions of a shuffle at most; more cells share them.
PARTITIONS = 4096


def _payload(column: pa.Array, dtype: DataType):
    """The vectors of an Arrow column: a matrix, or (offsets, dimensions, values) of sparse rows."""
    if dtype in DENSE:
        n = len(column)
        return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
    if dtype is DataType.BINARY:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(len(column), -1)
    idx, val = column.field("indices"), column.field("values")
    offsets = np.asarray(idx.offsets).astype(np.int64)
    return offsets - offsets[0], idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)


def _rows(block, dtype: DataType) -> int:
    return len(block[0]) - 1 if dtype in SPARSE else len(block)


def _take(block, rows: np.ndarray, dtype: DataType):
    """The named rows of a block."""
    if dtype not in SPARSE:
        return block[rows]
    offsets, dims, values = block
    sizes = np.diff(offsets)[rows]
    new = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(new[-1]) + np.repeat(offsets[rows] - new[:-1], sizes)
    return new, dims[at], values[at]


def _slice(block, lo: int, hi: int, dtype: DataType):
    """Rows lo to hi of a block."""
    if dtype not in SPARSE:
        return block[lo:hi]
    offsets, dims, values = block
    part = offsets[lo : hi + 1]
    return part - part[0], dims[part[0] : part[-1]], values[part[0] : part[-1]]


def _joined(blocks: list, dtype: DataType):
    """One block of several."""
    if len(blocks) == 1:
        return blocks[0]
    if dtype not in SPARSE:
        return np.concatenate(blocks)
    starts = np.cumsum([0, *(b[0][-1] for b in blocks)])
    return np.concatenate([[0], *(b[0][1:] + s for b, s in zip(blocks, starts, strict=False))]), np.concatenate([b[1] for b in blocks]), np.concatenate([b[2] for b in blocks])


def _same(block, dtype: DataType) -> tuple[np.ndarray, np.ndarray]:
    """(the first row of each different vector, the place among these of every row's vector); vectors are compared by their bytes."""
    n = _rows(block, dtype)
    if dtype in SPARSE:
        edge, dims, values = block[0].tolist(), block[1], block[2]
        keys = [dims[a:b].tobytes() + values[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    else:
        data, size = np.ascontiguousarray(block).tobytes(), block.shape[1] * block.itemsize if n else 0
        keys = [data[i * size : (i + 1) * size] for i in range(n)]
    seen: dict[bytes, int] = {}
    place = np.fromiter((seen.setdefault(key, len(seen)) for key in keys), np.int64, n)
    return (np.arange(n), place) if len(seen) == n else (np.unique(place, return_index=True)[1], place)


def _fold(ids: np.ndarray, block, k: int, dtype: DataType):
    """A block of the corpus without copies that k others with smaller ids precede."""
    first, place = _same(block, dtype)
    if len(first) == len(ids):
        return ids, block
    order = np.lexsort((ids, place))
    sorted_place = place[order]
    keep = np.sort(order[np.arange(len(order)) - np.searchsorted(sorted_place, sorted_place) < max(k, 1)])
    return ids[keep], _take(block, keep, dtype)


class _Entries:
    """The entries of sparse rows that are not zero in the order of dimensions, rows in order within one."""

    def __init__(self, block):
        offsets, dims, values = block
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        order = np.argsort(dims, kind="stable")
        order = order[values[order] != 0]
        self.n, self.rows, self.values = len(offsets) - 1, rows[order], values[order].astype(np.float64)
        dims = dims[order]
        self.first = np.concatenate([[0], np.nonzero(dims[1:] != dims[:-1])[0] + 1]) if len(dims) else np.zeros(0, np.int64)
        self.dims, self.last = dims[self.first], np.append(self.first[1:], len(dims))[: len(self.first)]
        self.norms = np.bincount(self.rows, self.values**2, self.n)


def _products(q: _Entries, c: _Entries):
    """(cells of the tile, products) of the entries that share a dimension, in the order of dimensions; a part at a time."""
    few, many = (q, c) if len(q.dims) <= len(c.dims) else (c, q)
    at = np.searchsorted(many.dims, few.dims)
    hit = at < len(many.dims)
    hit[hit] = many.dims[at[hit]] == few.dims[hit]
    a, b = np.nonzero(hit)[0], at[hit]
    qd, cd = (a, b) if few is q else (b, a)
    if not len(qd):
        return
    sizes = q.last[qd] - q.first[qd]
    starts = np.cumsum(sizes) - sizes
    entries = np.arange(sizes.sum()) + np.repeat(q.first[qd] - starts, sizes)
    first, count = (np.repeat(x, sizes) for x in (c.first[cd], c.last[cd] - c.first[cd]))
    total = np.cumsum(count)
    lo = 0
    while lo < len(entries):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PRODUCTS, side="right")))
        e, f, n = entries[lo:hi], first[lo:hi], count[lo:hi]
        ends = np.cumsum(n)
        ce = np.arange(ends[-1]) + np.repeat(f - ends + n, n)
        yield np.repeat(q.rows[e] * c.n, n) + c.rows[ce], np.repeat(q.values[e], n) * c.values[ce]
        lo = hi


def _dots(q: _Entries, c: _Entries) -> np.ndarray | None:
    """Inner products of all pairs, added in the order of dimensions, wherever a row stands; None if no pair shares one."""
    out = None
    for cells, products in _products(q, c):
        if out is None:
            out = np.zeros(q.n * c.n)
        np.add.at(out, cells, products)
    return None if out is None else out.reshape(q.n, c.n)


def _bits(words):
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def _ones(words) -> np.ndarray:
    """The bits of packed rows as numbers: products of such matrices are exact."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1).astype(np.float32)


def _true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix that is true in few places."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    some = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    some = np.concatenate([some[flat[some]], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(some, mask.shape[1])


def _exact(a, b, metric: Metric) -> np.ndarray:
    """Distances of dense rows pair by pair, which do not depend on where a row stands in its block, so that copies tie exactly."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if metric is Metric.L2:
        return np.sqrt(((a - b) ** 2).sum(axis=1))
    return _cosine((a * b).sum(axis=1), (a * a).sum(axis=1), (b * b).sum(axis=1))


def _cosine(dots, na, nb):
    prod = np.sqrt(na * nb)
    return np.where(prod == 0, 1.0, 1.0 - dots / np.where(prod == 0, 1.0, prod))


def _units(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return m / np.where(n > 0, n, 1.0)


def _first_k(coarse: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of each row, ties to the earlier column."""
    k = min(k, coarse.shape[1])
    return np.repeat(np.arange(len(coarse)), k), np.argsort(coarse, axis=1, kind="stable")[:, :k].ravel()


class TopK:
    """The k nearest corpus rows of each query among the blocks added so far, ties to the smaller id.

    Distances are taken by matrix products, tile by tile, in single precision where its error is small against the distances.
    Rows that may be among the k nearest within the error of these, given what has been found before, are scored directly,
    so that the result does not depend on tiles or on their order. Negated similarity for TANIMOTO.
    """

    def __init__(self, q, k: int, dtype: DataType, metric: Metric):
        self.q, self.k, self.dtype, self.metric = q, max(k, 0), dtype, metric
        n = _rows(q, dtype)
        self.dist = np.full((n, self.k), np.inf)
        self.ids = np.full((n, self.k), NO_ID)
        self.tiles: dict[int, _Entries] = {}
        self._near = self._near_dense if dtype in DENSE else self._near_sparse if dtype in SPARSE else self._near_binary

    def add(self, c, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Takes a block; rows names the queries that meet it, all of them if it is left out."""
        if not self.k or not len(ids):
            return
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, c = ids[order], _take(c, order, self.dtype)
        queries = np.arange(len(self.dist)) if rows is None else rows
        for lo in range(0, len(ids), TILE_ROWS):
            tile, part = ids[lo : lo + TILE_ROWS], self._side(_slice(c, lo, lo + TILE_ROWS, self.dtype))
            for at in range(0, len(queries), TILE_QUERIES):
                some = queries[at : at + TILE_QUERIES]
                q = self._entries(at) if self.dtype in SPARSE and rows is None else _take(self.q, some, self.dtype)
                dist, last = self.dist[some, -1], self.ids[some, -1]
                qi, ci, d = self._near(q, part, tile, dist, last)
                better = (d < dist[qi]) | ((d == dist[qi]) & (tile[ci] < last[qi]))
                if better.any():
                    self._merge(some, qi[better], tile[ci[better]], d[better])

    def _entries(self, at: int) -> _Entries:
        if at not in self.tiles:
            self.tiles[at] = _Entries(_slice(self.q, at, min(at + TILE_QUERIES, _rows(self.q, self.dtype)), self.dtype))
        return self.tiles[at]

    def _side(self, c):
        """What the tiles of queries that meet a tile of the corpus have in common."""
        if self.dtype in SPARSE:
            return _Entries(c)
        if self.dtype is DataType.BINARY:
            return c, _ones(c), _bits(c)
        far = c.astype(np.float64)
        if self.metric is Metric.COSINE:
            return c, None, np.hstack([_units(far), np.zeros((len(far), 1))])
        # Differences do not change about the mean, but the norms, and with them the rounding error, do.
        middle = far.mean(axis=0)
        far -= middle
        return c, middle, np.hstack([far, np.einsum("ij,ij->i", far, far)[:, None]])

    # Each of these gives (query, row, distance) of the rows of a tile that may be among the k nearest; dist and last are the
    # k-th distances so far and their ids. Ids of a tile rise.

    def _near_dense(self, q, side, ids, dist, last):
        c, middle, far = side
        near = q.astype(np.float64)
        if self.metric is Metric.COSINE:
            near, norms, largest = -_units(near), np.zeros(len(near)), 1.0
            base, limit = np.ones(len(near)), dist
        else:
            near = near - middle
            norms, largest = np.einsum("ij,ij->i", near, near), far[:, -1].max()
            near, base, limit = -2.0 * near, norms, dist**2
        # The product is the distance (squared for L2) less base; slack is twice a bound on its error.
        near = np.hstack([near, np.ones((len(near), 1))])
        slack = lambda t: 16 * np.finfo(t).eps * (near.shape[1] + 3) * (norms + largest)
        single = slack(np.float32)
        small = np.isfinite(limit).all() and 1e-20 < norms.max() + largest < 1e30 and np.median(single) <= 0.02 * np.median(limit)
        kind, slack = (np.float32, single) if small else (np.float64, slack(np.float64))
        coarse = near.astype(kind, copy=False) @ far.astype(kind, copy=False).T
        bound = limit - base + slack + 1e-12 * np.abs(np.where(np.isinf(limit), 0.0, limit))
        mask = coarse <= np.nextafter(bound.astype(kind), kind(np.inf))[:, None]
        k = min(self.k, coarse.shape[1])
        if np.count_nonzero(mask) > 2 * k * len(coarse):  # not many rows to compare with as yet
            kth = np.partition(coarse, k - 1, axis=1)[:, k - 1].astype(np.float64)
            bound = kth + slack + 1e-12 * (np.abs(kth) + norms)
            mask &= coarse <= np.nextafter(bound.astype(kind), kind(np.inf))[:, None]
        qi, ci = _true(mask)
        return qi, ci, _exact(q[qi], c[ci], self.metric)

    def _near_binary(self, q, side, ids, dist, last):
        c, far, nc = side
        nq = _bits(q)
        near = _ones(q)
        if np.isinf(dist).any():
            shared = (near @ far.T).astype(np.float64)
            union = nq[:, None] + nc[None, :] - shared
            coarse = -np.where(union == 0, 1.0, shared / np.maximum(union, 1))
            qi, ci = _first_k(np.where(coarse <= dist[:, None], coarse, np.inf), self.k)
        else:
            # shared / union >= t where shared - part * nc >= part * nq
            part = -dist / (1.0 - dist)
            bound = part * nq - 1e-6 * (nq + nc.max() + near.shape[1])
            bound = np.where((dist == 0) & (last < ids[0]), 0.5, bound)  # rows without a common bit tie, and have larger ids
            mask = np.hstack([near, -part[:, None].astype(np.float32)]) @ np.hstack([far, nc[:, None].astype(np.float32)]).T >= bound.astype(np.float32)[:, None]
            qi, ci = _true(mask)
        shared = _bits(q[qi] & c[ci])
        union = nq[qi] + nc[ci] - shared
        return qi, ci, -np.where(union == 0, 1.0, shared / np.maximum(union, 1))

    def _near_sparse(self, q, c, ids, dist, last):
        q = q if isinstance(q, _Entries) else _Entries(q)
        dots = _dots(q, c)
        open_ = np.isinf(dist)
        if self.metric is Metric.COSINE:
            least = np.where(open_, 0.0, (1.0 - np.where(open_, 1.0, dist) - 2e-12) * np.sqrt(q.norms))
            # Rows without a common dimension are at 1: only these queries need look at them.
            far = np.nonzero(least <= 0)[0]
            if dots is None:
                qi, ci = np.zeros((2, 0), np.int64)
            else:
                mask = dots >= np.multiply.outer(least, np.sqrt(c.norms))
                mask[far] = False
                qi, ci = _true(mask)
            score = lambda i, j, dot: _cosine(dot, q.norms[i], c.norms[j])
        else:
            bound = np.where(open_, 0.0, dist) ** 2 - q.norms
            bound += 1e-12 * (np.abs(bound) + 2.0 * q.norms + c.norms.max())
            far = np.nonzero(open_)[0]
            mask = (0.0 if dots is None else dots) >= np.subtract.outer(-0.5 * bound, -0.5 * c.norms)
            mask[far] = False
            qi, ci = _true(mask)
            score = lambda i, j, dot: np.sqrt(np.maximum(0.0, q.norms[i] + c.norms[j] - 2.0 * dot))
        d = score(qi, ci, 0.0 if dots is None else dots[qi, ci])
        if len(far):
            whole = score(far[:, None], np.arange(c.n)[None, :], 0.0 if dots is None else dots[far])
            worse = (whole > dist[far][:, None]) | ((whole == dist[far][:, None]) & (ids[None, :] >= last[far][:, None]))
            some = np.nonzero(~worse.all(axis=1))[0]
            if len(some):
                fi, fc = _first_k(np.where(worse[some], np.inf, whole[some]), self.k)
                qi, ci, d = np.concatenate([qi, far[some[fi]]]), np.concatenate([ci, fc]), np.concatenate([d, whole[some[fi], fc]])
        return qi, ci, d

    def _merge(self, some: np.ndarray, qi: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        which, slot = np.unique(qi, return_inverse=True)
        rows = some[which]
        slot = np.concatenate([np.repeat(np.arange(len(rows)), self.k), slot])
        dist = np.concatenate([self.dist[rows].ravel(), dist])
        ids = np.concatenate([self.ids[rows].ravel(), ids])
        order = np.lexsort((ids, dist, slot))
        order = order[np.arange(len(order)) - np.searchsorted(slot[order], slot[order]) < self.k]
        self.dist[rows], self.ids[rows] = dist[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)

    def result(self):
        """(query index, corpus id, distance) of what was found, queries in order."""
        qi, place = np.nonzero(self.ids != NO_ID)
        return qi, self.ids[qi, place], self.dist[qi, place]

    def batches(self, query_ids: np.ndarray, of: np.ndarray | None = None, place: np.ndarray | None = None):
        """The result as batches of RESULT. Query query_ids[i] is row of[i], or row i if that is left out; place[of[i]] is a
        further column where it is given."""
        of = np.arange(len(query_ids)) if of is None else of
        for lo in range(0, len(of), max(1, BATCH_ROWS // max(self.k, 1))):
            rows = of[lo : lo + max(1, BATCH_ROWS // max(self.k, 1))]
            ids = self.ids[rows]
            qi, at = np.nonzero(ids != NO_ID)
            if len(qi):
                found = query_ids[lo + qi], ids[qi, at], self.dist[rows[qi], at]
                yield _batch(RESULT, *found) if place is None else _batch(PLACED, *found, place[rows[qi]])


def block_top_k(q, c, ids: np.ndarray, k: int, dtype: DataType, metric: Metric):
    """(query index, corpus id, distance) of each query's k nearest in a block, ties to the smaller id."""
    best = TopK(q, k, dtype, metric)
    best.add(c, ids)
    return best.result()


RESULT = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
DDL = "query_id long, id long, distance double"
PLACED = RESULT.append(pa.field("place", pa.int32()))
APART = pa.schema([("query_id", pa.int64()), ("apart", pa.int64())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Nearest:
    """What a cell of a search does: the k nearest of its queries among the blocks of its share."""

    def __init__(self, query_ids: np.ndarray, q, k: int, dtype: DataType, metric: Metric):
        first, self.of = _same(q, dtype)
        self.query_ids, self.best = query_ids, TopK(_take(q, first, dtype) if len(first) < len(query_ids) else q, k, dtype, metric)

    def add(self, c, ids: np.ndarray):
        self.best.add(c, ids)
        return ()

    def finish(self):
        return self.best.batches(self.query_ids, self.of)


class _SparsePairs:
    """Sparse queries of a cell, tile by tile."""

    def __init__(self, query_ids: np.ndarray, q):
        self.query_ids = query_ids
        self.tiles = [_Entries(_slice(q, at, min(at + TILE_QUERIES, len(query_ids)), DataType.SPARSE_FLOAT)) for at in range(0, len(query_ids), TILE_QUERIES)]

    def add(self, c, ids: np.ndarray):
        for lo in range(0, len(ids), TILE_ROWS):
            part = _Entries(_slice(c, lo, min(lo + TILE_ROWS, len(ids)), DataType.SPARSE_FLOAT))
            for i, q in enumerate(self.tiles):
                yield from self.tile(i * TILE_QUERIES, q, part, ids[lo : lo + TILE_ROWS])

    def finish(self):
        return ()


class Dots(_SparsePairs):
    """Inner products of the pairs that share a dimension."""

    def tile(self, at: int, q: _Entries, c: _Entries, ids: np.ndarray):
        dots, met = np.zeros(q.n * c.n), np.zeros(q.n * c.n, bool)
        for cells, products in _products(q, c):
            np.add.at(dots, cells, products)
            met[cells] = True
        cells = np.flatnonzero(met)
        for lo in range(0, len(cells), BATCH_ROWS):
            some = cells[lo : lo + BATCH_ROWS]
            qi, ci = np.divmod(some, c.n)
            yield _batch(RESULT, self.query_ids[at + qi], ids[ci], dots[some])


class Apart(_SparsePairs):
    """How many rows of the share have an inner product of 0 with each query."""

    def __init__(self, query_ids: np.ndarray, q):
        super().__init__(query_ids, q)
        self.n = np.zeros(len(query_ids), np.int64)

    def tile(self, at: int, q: _Entries, c: _Entries, ids: np.ndarray):
        dots = _dots(q, c)
        self.n[at : at + q.n] += c.n - (0 if dots is None else np.count_nonzero(dots, axis=1))
        return ()

    def finish(self):
        if len(self.n):
            yield _batch(APART, self.query_ids, self.n)


def _vector_bytes(df: DataFrame, dtype: DataType):
    """Bytes of a row's vector in a block, as a column."""
    if dtype in SPARSE:
        return F.size("vec.indices") * 8 + 8
    return F.size("vec") * (4 if df.schema["vec"].dataType.elementType.simpleString() in ("float", "int") else 8)


def sizes(queries: DataFrame, corpus: DataFrame, dtype: DataType) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int]]]:
    """{list: (rows, bytes)} of both sides, in one job; one list 0 where rows have none."""
    out = {}, {}
    parts = []
    for side, df in enumerate((queries, corpus)):
        lists = F.col("list_id") if "list_id" in df.columns else F.lit(0)
        parts.append(df.groupBy(lists.alias("list_id")).agg(F.count("*").alias("n"), F.sum(_vector_bytes(df, dtype).cast("long")).alias("b")).withColumn("side", F.lit(side)))
    for r in parts[0].unionByName(parts[1]).collect():  # a row for each list and side
        out[r["side"]][r["list_id"]] = r["n"], r["b"] or 0
    return out


def _cells(queries: dict, corpus: dict, k: int, parallel: int, group_bytes: int, share_bytes: int) -> dict[int, tuple[int, int, int]]:
    """{list: (its first cell, groups, shares)} for sizes of both sides; lists that no query asks for have none.

    Bytes bound groups and shares, and pairs the work of a cell. Between groups and shares the cells are divided so that few
    bytes are shuffled: queries and their results once a share, the corpus once a group.
    """
    out, first = {}, 0
    total = sum(n * corpus[name][0] for name, (n, _) in queries.items() if name in corpus)
    for name in sorted(set(queries) & set(corpus)):
        (nq, bq), (nc, bc) = queries[name], corpus[name]
        cells = max(-(-nq * nc // TASK_PAIRS), min(-(-nq * nc >> 22), -(-3 * parallel * nq * nc // max(total, 1))), 1)
        shares = max(1, min(nc, max(round((cells * bc / (bq + 24 * max(k, 1) * nq + 1)) ** 0.5), -(-bc // share_bytes))))
        groups = max(1, min(nq, max(-(-cells // shares), -(-bq // group_bytes))))
        out[name] = first, groups, shares
        first += groups * shares
    return out


def _hash(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h >> np.uint64(33)


def _packer(dtype: DataType, cells: dict[int, tuple[int, int, int]], side: int, fold: int | None):
    """Rows (id, vec[, list_id]) to blocks and the cells that they go to: n cells from first on, step apart.

    Side 0 is of queries, dealt into groups, and side 1 of the corpus, dealt into shares. Where fold is given, copies beyond so
    many are left out of a block."""

    def pack(batches):
        held: dict[tuple[int, int], list] = {}
        held_bytes: dict[tuple[int, int], int] = {}

        def flush(key):
            parts = held.pop(key)
            held_bytes.pop(key)
            ids, block = np.concatenate([p[0] for p in parts]), _joined([p[1] for p in parts], dtype)
            if fold is not None:
                ids, block = _fold(ids, block, fold, dtype)
            first, groups, shares = cells[key[0]]
            at = (first + key[1] * shares, 1, shares) if side == 0 else (first + key[1], shares, groups)
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in at), pa.array([pickle.dumps((ids, block), protocol=5)], pa.binary())], ["first", "step", "n", "block"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, block = b.column(0).to_numpy(), _payload(b.column(1), dtype)
            lists = b.column(2).to_numpy() if b.num_columns > 2 else np.zeros(len(ids), np.int64)
            for name in np.unique(lists).tolist():
                if name not in cells:
                    continue
                rows = np.nonzero(lists == name)[0]
                number = (_hash(ids[rows]) % np.uint64(cells[name][1 + side])).astype(np.int64)
                order = np.argsort(number, kind="stable")
                edge = np.append(np.nonzero(np.diff(number[order], prepend=-1))[0], len(order))
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    some = rows[order[lo:hi]]
                    key, part = (name, int(number[order[lo]])), _take(block, some, dtype)
                    held.setdefault(key, []).append((ids[some], part))
                    held_bytes[key] = held_bytes.get(key, 0) + 8 * len(some) + (sum(x.nbytes for x in part) if dtype in SPARSE else part.nbytes)
                    if held_bytes[key] >= BLOCK_BYTES:
                        yield flush(key)
            if sum(held_bytes.values()) > HELD_BYTES:
                for key in list(held):
                    yield flush(key)
        for key in list(held):
            yield flush(key)

    return pack


def search_cells(queries: DataFrame, corpus: DataFrame, cells: dict[int, tuple[int, int, int]], dtype: DataType, make: Callable, schema: str, fold: int | None = None) -> DataFrame:
    """What make(list, query ids, queries) yields for the blocks of the corpus that its cell meets; rows (id, vec[, list_id]) on both sides."""
    total = sum(g * s for _, g, s in cells.values())
    if not total:
        return queries.sparkSession.createDataFrame([], schema)
    packed = "first int, step int, n int, block binary"
    left = queries.mapInArrow(_packer(dtype, cells, 0, None), packed).withColumn("side", F.lit(0))
    right = corpus.mapInArrow(_packer(dtype, cells, 1, fold), packed).withColumn("side", F.lit(1))
    # A stated query set against all rows, in blocks.
    both = left.unionByName(right).select(F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("first") + i * F.col("step"))).alias("cell"), "side", "block")
    names, firsts = list(cells), [first for first, _, _ in cells.values()]
    partitions = min(total, PARTITIONS)
    dealt = both.repartitionById(partitions, F.pmod("cell", F.lit(partitions)).cast("int")).sortWithinPartitions("cell", "side")

    def search(batches):
        key, held, rows, work = None, [], 0, None

        def stream():
            nonlocal held, rows
            ids, block = np.concatenate([h[0] for h in held]), _joined([h[1] for h in held], dtype)
            held, rows = [], 0
            yield from work.add(block, ids)

        for b in batches:
            for cell, side, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if cell != key:
                    if work is not None:
                        if held:
                            yield from stream()
                        yield from work.finish()
                    key, held, rows, work = cell, [], 0, None
                if side and work is None:
                    if not held:  # no query has come to this cell
                        continue
                    work, held = make(names[bisect_right(firsts, cell) - 1], np.concatenate([h[0] for h in held]), _joined([h[1] for h in held], dtype)), []
                ids, block = pickle.loads(data.as_buffer())
                held.append((ids, block))
                if side:
                    rows += len(ids)
                    if rows >= TILE_ROWS:
                        yield from stream()
        if work is not None:
            if held:
                yield from stream()
            yield from work.finish()

    return dealt.mapInArrow(search, schema)


def _planned(queries: DataFrame, corpus: DataFrame, k: int, dtype: DataType) -> dict[int, tuple[int, int, int]]:
    return _cells(*sizes(queries, corpus, dtype), k, corpus.sparkSession.sparkContext.defaultParallelism, GROUP_BYTES, SHARE_BYTES)


def block_knn(queries: DataFrame, corpus: DataFrame, k: int, dtype: DataType, metric: Metric) -> DataFrame:
    """Candidates (query_id, id, distance), at most k for each query and share, holding its k nearest.

    queries (query_id, vec) and corpus (id, vec) may both be of any size. Negated similarity for TANIMOTO.
    """
    q, c = queries.select("query_id", "vec"), corpus.select("id", "vec")
    return search_cells(q, c, _planned(q, c, k, dtype), dtype, lambda _, ids, m: Nearest(ids, m, k, dtype, metric), DDL, k)


def block_dots(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, id, distance): the inner products of the sparse pairs that share a dimension. Only the two sides are shuffled."""
    q, c = queries.select("query_id", "vec"), corpus.select("id", "vec")
    return search_cells(q, c, _planned(q, c, 1, DataType.SPARSE_FLOAT), DataType.SPARSE_FLOAT, lambda _, ids, m: Dots(ids, m), DDL)


def block_apart(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, apart): how many sparse rows of a share have an inner product of 0 with the query, a row for each share."""
    q, c = queries.select("query_id", "vec"), corpus.select("id", "vec")
    return search_cells(q, c, _planned(q, c, 1, DataType.SPARSE_FLOAT), DataType.SPARSE_FLOAT, lambda _, ids, m: Apart(ids, m), "query_id long, apart long")


def block_knn_broadcast(queries: DataFrame, corpus: DataFrame, k: int, dtype: DataType, metric: Metric, held: pa.Table | None = None) -> DataFrame:
    """The same for a query set whose size the caller has checked: it travels with the tasks, so the corpus is not shuffled.

    held are its rows, if the caller has them."""
    t = (queries.select("query_id", "vec").toArrow() if held is None else held).combine_chunks()
    batches = t.to_batches()
    spark = corpus.sparkSession
    if not batches:
        return spark.createDataFrame([], DDL)
    held = spark.sparkContext.broadcast((batches[0].column(0).to_numpy(zero_copy_only=False), _payload(batches[0].column(1), dtype)))

    def search(parts):
        work = Nearest(*held.value, k, dtype, metric)
        for b in parts:
            if b.num_rows:
                work.add(*reversed(_fold(b.column(0).to_numpy(zero_copy_only=False), _payload(b.column(1), dtype), k, dtype)))
        yield from work.finish()

    return corpus.select("id", "vec").mapInArrow(search, DDL)
