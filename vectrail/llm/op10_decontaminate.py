"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask says which words of a window count. Windows of documents and of benchmark items are hashed under each mask and
joined; a hit names an alignment (document, item, offset). The hits of a document and an item become one row with their
different offsets, so a text of one word repeated costs no more rows than another. Along each offset the words are compared
one by one, and the document is contaminated if some window of WINDOW item words (the whole item, if shorter) has at
least the share SHARE of its words in the same places. Words between the counted ones may be replaced without losing the hit.
"""

from __future__ import annotations

import math
import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import documents, small, table, written

#: 1: the word counts. Whichever words are replaced, if SHARE of a window of SHORT to WINDOW words is left, a mask meets
#: only words that are left (a test goes through all choices). With five counted words that takes seven masks.
MASKS = ("11101", "100111", "1101001")
WINDOW = 13
SHARE = 0.75
#: Items with fewer words have masks of their own length: short_masks.
SHORT = 8
#: Seeds or documents up to these numbers are broadcast (16 bytes each); beyond them both sides are shuffled.
BROADCAST_SEEDS, BROADCAST_DOCS = 500_000, 500_000


def words_of(text: str = "text") -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def short_masks(n: int) -> tuple[str, ...]:
    """For items of n words: every choice of as many words as make a leak, cut to its span."""
    choices = combinations(range(n), math.ceil(n * SHARE))
    return tuple(sorted({"".join("01"[i in c] for i in range(n)).strip("0") for c in choices}))


def row_key() -> Column:
    """Names a row by its id and text: rows alike in both have the same result."""
    return F.xxhash64("doc_id", "text")


def window_hash(h: Column, mask: str, kept: list[int]):
    return lambda i: F.xxhash64(F.lit(mask), *[F.get(h, i + k if k else i) for k in kept])


def seed_array(hashes: str, masks: tuple[str, ...]) -> Column:
    """For each mask, the hashes of all windows in order of their first word."""
    h, n = F.col(hashes), F.size(hashes)
    arrays = []
    for mask in masks:
        kept = [i for i, c in enumerate(mask) if c == "1"]
        empty = F.array().cast("array<long>")
        arrays.append(F.when(n >= len(mask), F.transform(F.sequence(F.lit(0), n - len(mask)), window_hash(h, mask, kept))).otherwise(empty))
    return F.array(*arrays)


def seeds(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """(keep.., pos, seed) of rows with word hashes h."""
    out = None
    for mask in masks:
        part = rows.select(*keep, F.posexplode(seed_array("h", (mask,))[0]).alias("pos", "seed"))
        out = part if out is None else out.unionByName(part)
    return out


def document_seeds(docs: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(key, pos, seed): all masks in one pass over the texts."""
    rows = docs.select(row_key().alias("key"), F.transform(words_of(), lambda w: F.xxhash64(w)).alias("h"))
    arrays = rows.select("key", F.explode(seed_array("h", masks)).alias("s"))
    return arrays.select("key", F.posexplode("s").alias("pos", "seed"))


def best_window(offset: Column) -> Column:
    """The most words that a window of the item iw has in the same places of the document dw, moved by the offset."""
    same = F.transform("iw", lambda w, j: F.when(F.get("dw", offset + j) == w, 1).otherwise(0))
    compared = F.least(F.size("iw"), F.lit(WINDOW))
    of_window = lambda i: F.aggregate(F.slice(same, i, compared), F.lit(0), lambda n, x: n + x)
    return F.array_max(F.transform(F.sequence(F.lit(1), F.size("iw") - compared + 1), of_window))


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(key, doc_id, item_id, offset, matched, compared): of each document and item the best alignment, if its best window
    reaches SHARE.

    Every such pair is found. Items without words and null ids take no part; documents without words have no leaks. Of
    repeated rows one is returned, whose key names them all.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words_of().alias("iw")).where(F.size("iw") > 0)
    items = written(items.withColumn("h", F.transform("iw", lambda w: F.xxhash64(w))), "items")
    short = {r[0]: short_masks(r[0]) for r in items.where(F.size("iw") < SHORT).select(F.size("iw")).distinct().collect()}
    of_items = seeds(items.where(F.size("iw") >= SHORT), ["item_id"], masks)
    for n in sorted(short):
        of_items = of_items.unionByName(seeds(items.where(F.size("iw") == n), ["item_id"], short[n]))
    of_items = written(of_items.select("item_id", F.col("pos").alias("ipos"), "seed"), "item-seeds")
    more = sorted({m for ms in short.values() for m in ms} - set(masks))
    few = small(of_items, BROADCAST_SEEDS)
    hits = document_seeds(docs, (*masks, *more)).join(F.broadcast(of_items) if few else of_items, "seed")
    # A pair's offsets are no more than the document's and the item's words.
    hits = hits.groupBy("key", "item_id").agg(F.sort_array(F.collect_set(F.col("pos") - F.col("ipos"))).alias("offsets"))
    hits = written(hits, "hits")
    keys = hits.select("key").distinct()
    rows = docs.select("doc_id", "text", row_key().alias("key"))
    rows = rows.join(F.broadcast(keys) if small(keys, BROADCAST_DOCS) else keys, "key", "left_semi").dropDuplicates(["key"])
    rows = rows.select("key", "doc_id", words_of().alias("dw"))
    aligned = rows.join(hits, "key").join(items.select("item_id", "iw"), "item_id")
    best = F.array_max(F.transform("offsets", lambda o: F.struct(best_window(o).alias("matched"), (-o).alias("before"))))
    aligned = aligned.select("key", "doc_id", "item_id", F.least(F.size("iw"), F.lit(WINDOW)).alias("compared"), best.alias("best"))
    return aligned.select("key", "doc_id", "item_id", (-F.col("best.before")).alias("offset"), F.col("best.matched").alias("matched"), "compared").where(F.col("matched") >= F.ceil(F.col("compared") * SHARE))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated row of docs: doc_id, its items, their number and the best share of matched words.

    Repeated rows have equal results, each its own; null ids and texts, empty tables and columns of any other name are allowed.
    """
    found = leaks(docs, benchmark).groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.round(F.max(F.col("matched") / F.col("compared")), 6).alias("best"))
    rows = docs.select("doc_id", row_key().alias("key"))
    return rows.join(found, "key").select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("item_ids"), "best")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows, columns as they are, whatever their names; rows without text stay."""
    name = f"key_{uuid.uuid4().hex}"
    bad = written(leaks(docs, benchmark).select(F.col("key").alias(name)).distinct(), "leaks")
    bad = F.broadcast(bad) if small(bad, BROADCAST_DOCS) else bad
    return docs.join(bad, row_key() == F.col(name), "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
