"""Choices made when a plan is built, from measured sizes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

#: Query rows that may be broadcast; at 1,024 doubles a row this is 64 MB. Tasks work on them in tiles.
BROADCAST_ROWS = 8_192
#: Up to this many queries, expressions inside the JVM cost less than starting Python workers.
EXPR_ROWS = 32


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has no more rows; reads no further than it must."""
    return df.limit(rows + 1).count() <= rows


def choose_strategy(queries: DataFrame) -> tuple[str, pa.Table]:
    """The strategy for a query set (query_id, vec), and its first rows: all of them unless the strategy is "block"."""
    first = queries.select("query_id", "vec").limit(BROADCAST_ROWS + 1).toArrow()
    n = first.num_rows
    return "expr" if n <= EXPR_ROWS else "broadcast" if n <= BROADCAST_ROWS else "block", first
