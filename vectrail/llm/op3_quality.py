"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is taken in linear time as half of
the square of sums minus the sum of squares, factor by factor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import documents, map_batches, null_safe_text, row_chunks, runs, table, text_buffers, word_hash, written

#: At most this many labelled rows are fitted on: those with the smallest hash of their doc_id.
FIT_ROWS = 12_000
#: Bytes of features that are fitted on at once; of more, block after block is read in each pass.
BLOCK_BYTES = 64 << 20
WORD_BUCKETS = 1 << 15
STATS = 13
BINS = 24
FACTORS = 8
EPOCHS = 5
HOLD_OUT = 5
CUT = 0.3
SIZE = WORD_BUCKETS + STATS * BINS
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
ALPHA = UPPER.copy()
ALPHA[97:123] = ALPHA[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK = ~(ALPHA | DIGIT | SPACE)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def features(data: np.ndarray, cuts: np.ndarray, n_chars: np.ndarray):
    """(row, feature, value) of texts laid end to end, features unique within a row; each part of a row has unit norm.

    n_chars, the metadata, may differ from the text's length or be negative where it is null.
    """
    n = len(cuts) - 1
    starts, ends = runs(~SPACE[data], cuts)
    first = np.searchsorted(starts, cuts)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    h = word_hash(data, starts, ends)
    key, count = np.unique(row * WORD_BUCKETS + (h & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), return_counts=True)
    wrow, value = key // WORD_BUCKETS, np.sqrt(count)
    value = value / np.sqrt(np.bincount(wrow, value**2, n))[wrow] if len(key) else value
    sums = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[cuts])
    size, upper, alpha, digit, mark, lines, bars = (*(sums(t[data]) for t in (np.ones(256, bool), UPPER, ALPHA, DIGIT, MARK)), sums(data == 10), sums(data == 124))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    per = lambda a, b: a / np.maximum(b, 1)
    lstarts, lends = runs(data != 10, cuts)
    lrow = np.searchsorted(cuts, lstarts, "right") - 1
    lh = word_hash(data, lstarts, lends)
    lorder = np.lexsort((lh, lrow))
    lagain = np.zeros(len(lh), bool)
    lagain[1:] = (lh[lorder][1:] == lh[lorder][:-1]) & (lrow[lorder][1:] == lrow[lorder][:-1])
    pairs = np.zeros(len(data), bool)
    pairs[1:] = MARK[data[1:]] & (data[1:] == data[:-1])
    pairs[cuts[:-1][cuts[:-1] < len(data)]] = False
    stats = np.stack(
        [
            np.log2(size + 1) / 20,
            np.log2(np.maximum(n_chars, 0) + 1) / 20,
            per(upper, alpha),
            per(mark, size) * 3,
            per(digit, size) * 5,
            per(lines, words) * 5,
            per(bars, words),
            np.minimum(per(size, words) / 20, 1),
            per(np.bincount(row, again, n), words),
            per(np.bincount(row[order], fresh, n), words),
            per(np.bincount(lrow[lorder], lagain, n), np.bincount(lrow, minlength=n)),
            per(sums(pairs), words),
            per(np.bincount(row, UPPER[data[starts]], n) if len(starts) else np.zeros(n), words),
        ],
        axis=1,
    )
    # Bins are finer near 0, where most texts lie.
    bin_ = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64), BINS - 1)
    srow = np.repeat(np.arange(n), STATS)
    sfeat = (WORD_BUCKETS + np.arange(STATS) * BINS + bin_).ravel()
    rows, feats, vals = np.concatenate([wrow, srow]), np.concatenate([key % WORD_BUCKETS, sfeat]), np.concatenate([value, np.full(n * STATS, 1 / np.sqrt(STATS))])
    o = np.argsort(rows, kind="stable")
    return rows[o], feats[o], vals[o].astype(np.float64)


class Machine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b, self.w, self.v = 0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, FACTORS))

    def raw(self, n, rows, feats, vals):
        """(score before the sigmoid, factor sums): linear in the number of entries."""
        out = self.b + np.bincount(rows, self.w[feats] * vals, n)
        vx = self.v[feats] * vals[:, None]
        sums = np.stack([np.bincount(rows, vx[:, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(rows, (vx**2).sum(axis=1), n)
        return out + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, n, rows, feats, vals):
        return 1 / (1 + np.exp(-np.clip(self.raw(n, rows, feats, vals)[0], -30, 30)))

    def fit(self, load: Callable[[int], tuple[list, np.ndarray]], n_blocks: int, mean: float | None, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.15, decay: float = 1e-6, seed: int = 7) -> Machine:
        """AdaGrad on the logistic loss, block by block. load gives a block's (features, values) of each row and its labels, mean is
        the share of label 1. One class alone, or no row, gives its rate."""
        if mean is None:
            return self
        rng = np.random.default_rng(seed)
        clipped = np.clip(mean, 1e-3, 1 - 1e-3)
        self.b = float(np.log(clipped / (1 - clipped)))
        if mean in (0.0, 1.0):
            return self
        gw, gv, gb = np.full(SIZE, 1e-4), np.full((SIZE, FACTORS), 1e-4), 1e-4
        for block in (b for _ in range(epochs) for b in rng.permutation(n_blocks).tolist()):
            entries, labels = load(block)
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                feats = np.concatenate([entries[i][0] for i in part]).astype(np.int64)
                vals = np.concatenate([entries[i][1] for i in part]).astype(np.float64)
                rows = np.repeat(np.arange(len(part)), [len(entries[i][0]) for i in part])
                z, sums = self.raw(len(part), rows, feats, vals)
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
                used, slot = np.unique(feats, return_inverse=True)
                ge = g[rows] * vals / len(part) * 16
                dw = np.bincount(slot, ge, len(used)) + decay * self.w[used]
                dv = np.stack([np.bincount(slot, ge * (sums[rows, f] - self.v[feats, f] * vals), len(used)) for f in range(FACTORS)], axis=1) + decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                gb += g.mean() ** 2
                self.b -= rate * float(g.mean()) / np.sqrt(gb)
        return self


def _batch_features(b, offset: int):
    """Runs of rows of a batch (.., text, n_chars) as (first row, number of rows, rows, features, values)."""
    offsets, data = text_buffers(b.column(offset))
    meta = np.array([-1 if x is None else x for x in b.column(offset + 1).to_pylist()], np.float64)
    for lo, hi in row_chunks(offsets):
        yield lo, hi - lo, *features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], meta[lo:hi])


def _inputs(docs: DataFrame, *keep: str) -> DataFrame:
    docs = docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))
    return null_safe_text(docs, *keep, "n_chars").select(*keep, "text", F.col("n_chars").cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fits on at most fit_rows labelled rows outside the held-out fold (rows without a label or text take no part).

    Their features are written to the shared folder, and at most about BLOCK_BYTES of them are on the driver. A label's repeated
    rows and a document's count each; without any row the machine gives 1/2 plus the little that its random start adds.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)

    def run(batches):
        for b in batches:
            for lo, n, rows, feats, vals in _batch_features(b, 2):
                cut = np.searchsorted(rows, np.arange(n + 1))
                f, v = feats.astype(np.uint16), vals.astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array([f[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([v[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "quality", "f", "v"])

    # fit_rows bounds the broadcast side.
    rows = map_batches(_inputs(docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id"), "doc_id", "quality"), run, "doc_id long, quality int, f binary, v binary")
    rows = written(rows, "fit-rows")
    size, mean = rows.agg(F.sum(F.octet_length("f") + F.octet_length("v")), F.avg("quality")).first()
    n_blocks = max(1, -(-(size or 0) // BLOCK_BYTES))
    held: dict[int, tuple] = {}

    def load(block: int):
        if block not in held:
            held.clear()
            got = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)) == block).toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("f", "ascending")])
            entries = [(np.frombuffer(f, np.uint16), np.frombuffer(v, np.float32)) for f, v in zip(got["f"].to_pylist(), got["v"].to_pylist(), strict=True)]
            held[block] = entries, got["quality"].to_numpy().astype(np.float64)
        return held[block]

    return Machine().fit(load, n_blocks, mean)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs: score from 0 to 1, predicted its side of CUT.

    A null or empty text is scored on its statistics; repeated rows have equal scores; texts are read whole; an empty table gives
    no row. Columns other than doc_id, text and n_chars are not read, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    plain = _inputs(docs, "doc_id")

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, n, *entries in _batch_features(b, 1):
                out[lo : lo + n] = held.value.score(n, *entries)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    return map_batches(plain, run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs that the machine accepts, with docs' own columns, repeated rows and null ids among them."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns
    text = names.index("text")
    meta = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            chars = b.column(meta).cast(pa.int64()) if meta is not None else pa.nulls(b.num_rows, pa.int64())
            two = pa.RecordBatch.from_arrays([b.column(text), chars], ["text", "n_chars"])
            good = np.zeros(b.num_rows, bool)
            for lo, n, *entries in _batch_features(two, 0):
                good[lo : lo + n] = held.value.score(n, *entries) >= CUT
            yield b.filter(pa.array(good))

    return map_batches(docs, run, docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
