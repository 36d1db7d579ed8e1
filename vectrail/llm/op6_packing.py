"""Packing by optimal length buckets.

Texts become pieces of at most MAX_LENGTH tokens (the last piece holds the rest). A dynamic programme over the global
histogram of piece lengths chooses the bucket boundaries with the least padding, and inside each bucket pieces form
batches of at most BUDGET tokens, padding included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.common import documents, map_batches, null_safe_text, written
from vectrail.llm.tokens import encode_column

MAX_LENGTH = 2048
BUCKETS = 16
BUDGET = 1 << 16
#: Pieces that are numbered in one task; the number of tasks follows from it.
PART_ROWS = 20_000


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, the end id counted; a null or empty text has 1, repeated rows equal numbers.

    Texts are read whole, however long; columns other than doc_id and text are not read.
    """

    def run(batches):
        for b in batches:
            n = np.ones(b.num_rows, np.int64)
            for lo, _, bounds in encode_column(b.column(1), tokenizer):
                n[lo : lo + len(bounds) - 1] += np.diff(bounds)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return map_batches(null_safe_text(docs, "doc_id"), run, "doc_id long, n_tokens long")


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most so many buckets with the least total padding; ties go to fewer and lower boundaries."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    count = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])])
    mass = np.concatenate([[0], np.cumsum([histogram[int(x)] * int(x) for x in lengths])])
    n = len(lengths)
    # best[j]: least padding of the first j lengths in the buckets so far. The last bucket takes lengths i..j-1.
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choice = []
    results = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (count[j] - count[:j]) - (mass[j] - mass[:j])
            cut[j] = int(cost.argmin())
            new[j] = cost[cut[j]]
        choice.append(cut)
        best = new
        results.append(best[n])
    k = int(np.argmin(results))
    out, j = [], n
    while k >= 0:
        out.append(int(lengths[j - 1]))
        j, k = int(choice[k][j]), k - 1
    return out[::-1]


def pack(lengths: DataFrame, *, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, boundary, batch, slot, padding) of every piece of lengths (doc_id, n_tokens).

    Batch numbers run from 0 in each bucket. Only the histogram, of at most max_length rows, comes to the driver. Rows whose
    n_tokens is null or not positive have no piece; null ids are packed like others and come first; rows that repeat an id are
    packed each, in the order of their lengths; other columns are not read. An empty table gives no row.
    """
    whole = F.ceil(F.col("n_tokens") / max_length).cast("int")
    pieces = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * max_length).alias("start"), F.least(F.lit(max_length).cast("long"), F.col("n_tokens") - F.col("piece").cast("long") * max_length).alias("n_tokens"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("n_tokens").count().collect()}
    edges = boundaries(histogram, buckets)
    if not edges:
        return pieces.select("doc_id", "piece", "start", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("boundary"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("padding"))
    parts = max(1, -(-sum(histogram.values()) // part_rows))
    at = F.lit(None)
    for i, e in reversed(list(enumerate(edges))):
        at = F.when(F.col("n_tokens") <= e, F.struct(F.lit(i).alias("bucket"), F.lit(e).cast("long").alias("boundary"))).otherwise(at)
    dealt = pieces.withColumn("b", at).select("*", "b.*").drop("b").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(parts)))
    # A bucket's pieces are numbered part by part: a part's first number is the size of the parts before it.
    sizes = dealt.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    firsts = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    numbered = dealt.withColumn("i", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "piece", "n_tokens")) - 1).join(firsts, ["bucket", "part"])
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("boundary")))
    number = F.col("first") + F.col("i")
    return numbered.select("doc_id", "piece", "start", "n_tokens", "bucket", "boundary", F.floor(number / room).alias("batch"), F.pmod(number, room).cast("long").alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(written(token_lengths(documents(spark, sf_dir)), "token-lengths"))
