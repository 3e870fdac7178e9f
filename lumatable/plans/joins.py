"""Joins of a large table with a per-key table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 50_000


def has_few_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Counts at most ``limit + 1`` rows: the proof a broadcast needs.

    Spark's own estimate multiplies the sizes of joined inputs, so it never broadcasts a table
    that is itself the result of a join; this looks at the real number instead.
    """
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def join_per_image(
    facts: DataFrame, dims: DataFrame, small: bool, key: str = "image_id", how: str = "inner"
) -> DataFrame:
    """Join of many rows per key with one row per key.

    ``small`` says that ``dims`` was counted and found below the limit; it is broadcast then.
    Otherwise both sides are sorted and merged, and AQE splits the partition of a dominant key.
    """
    return facts.join(F.broadcast(dims), key, how) if small else join_large(facts, dims, key, how)


def join_large(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of tables that both grow with the library: sorted and merged, whatever Spark estimates.

    Spark takes an exploded table (the pixels of a photo table) for as small as the table it came from,
    and would send all of its rows through the driver as a broadcast.
    """
    return left.join(right.hint("merge"), on, how)
