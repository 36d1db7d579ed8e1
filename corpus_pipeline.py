"""Corpus preparation in stages: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of docs as they are, in their order,
whatever further ones there are and however they are called. Every stage takes empty tables, whole texts of any length,
empty and null texts, and null and repeated ids; what it does with them stands beside it.
"""

from __future__ import annotations

from vectrail.llm import op3_quality, op5_ngram_join, op6_packing, op7_pii, op10_decontaminate
from vectrail.llm.common import table, written


def quality(spark, docs, sf_dir):
    """Documents that the classifier accepts; it is fitted on the labelled rows outside the held-out fold.

    The machine is fitted on the table documents, not on docs. Null and empty texts are scored on their statistics; equal rows
    share their fate. Without labels every score is near 1/2, over the cut, and all documents stay.
    """
    machine = op3_quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return op3_quality.keep_good(docs, machine)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies: five-word grams, similarity 0.8.

    The smallest doc_id of a group stays (null ids come last), once if its row is repeated. Documents without words all stay.
    """
    return op5_ngram_join.keep_one(docs, 5, 80, 100)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents without passages of the benchmark; those without text stay, and equal rows share their fate."""
    return op10_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """All documents, identifiers replaced by their kind; null and empty texts and all other columns but n_chars stay as they are."""
    return op7_pii.redact(docs)


def packing(spark, docs, sf_dir):
    """Every piece of every document, with its bucket, batch and slot; a null or empty text is one piece, the end id."""
    return op6_packing.pack(written(op6_packing.token_lengths(docs), "token-lengths"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("packing", packing)]

#: Stages use a fitted model, connected components and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
