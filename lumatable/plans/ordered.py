"""Lag and lead over keys of any size.

A plain window puts a whole key into one task. Here rows are range-partitioned by key and order
first, so a key of any length is many ranges, cut by rank and not by value. Windows run inside a
range; only the edge row of each (range, key) pair travels between ranges, through a table with one
row per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .session import cut_lineage


def _neighbour(df, keys, order, cols, forward, prefix):
    turned = lambda names: [F.col(c).desc() if forward else F.col(c).asc() for c in names]
    placed = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    placed = cut_lineage(placed)  # range numbers must be the same for rows and edges
    inner = Window.partitionBy("_range", *keys).orderBy(*turned(order))
    # the value struct is never null itself, so "no neighbour" stays distinguishable
    value = F.struct(*[F.col(c).alias(c) for c in cols])
    placed = placed.withColumn("_near", F.lag(value, 1).over(inner))

    pick = F.min_by if forward else F.max_by
    edges = placed.groupBy("_range", *keys).agg(pick(value, F.struct(*order)).alias("_edge"))
    outer = Window.partitionBy(*keys).orderBy(*turned(["_range"]))
    carry = edges.select(*keys, "_range", F.lag("_edge", 1).over(outer).alias("_carry"))
    placed = placed.join(carry, [*keys, "_range"], "left")
    found = F.coalesce(F.col("_near"), F.col("_carry"))
    return placed.withColumns(
        {f"{prefix}{c}": found[c] for c in cols} | {f"{prefix}exists": found.isNotNull()}
    ).drop("_near", "_carry", "_range")


def with_previous(df: DataFrame, keys, order, cols) -> DataFrame:
    """Add ``prev_<col>`` and ``prev_exists`` from the preceding row of the same keys."""
    return _neighbour(df, keys, [order] if isinstance(order, str) else list(order), cols, False, "prev_")


def with_next(df: DataFrame, keys, order, cols) -> DataFrame:
    """Add ``next_<col>`` and ``next_exists`` from the following row of the same keys."""
    return _neighbour(df, keys, [order] if isinstance(order, str) else list(order), cols, True, "next_")
