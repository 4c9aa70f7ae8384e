"""Joins with tables that are small as a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vidlake.operators.storage import size_in_bytes, written

#: Rows, and bytes of its files, up to which the small side is broadcast.
SMALL_ROWS, SMALL_BYTES = 100_000, 8 << 20


def join_small(rows: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", limit: int = SMALL_ROWS, most_bytes: int = SMALL_BYTES, stored: bool = True) -> DataFrame:
    """rows joined with a table of lines, labels or cameras: broadcast while it has at most `limit` rows in `most_bytes`, else merged.

    The small side is computed once and written; its rows and bytes are those of its
    files. Beyond either limit the sides are shuffled, and adaptive execution splits a
    hot key. stored=False: small is a configuration of short rows, cheap to compute, whose
    rows alone are counted; what is constant in it then stays so in the plan.
    """
    if stored:
        small = written(small, "small")
        few = size_in_bytes(small) <= most_bytes and small.count() <= limit
    else:
        few = small.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(small) if few else small.hint("merge"), on, how)
