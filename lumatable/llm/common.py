"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumatable.plans.session import checkpoint_dir

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def stage_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage so that a lost executor costs a reread, and gives Spark the real size of the
    table: whether it is broadcast is then decided by ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a table from :func:`stage_table` that nothing reads any more."""
    spark = df.sparkSession
    jvm, base = spark._jvm, checkpoint_dir(spark)
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        root = jvm.org.apache.hadoop.fs.Path(base)
        if path.toUri().getPath().startswith(root.toUri().getPath() + "/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, size: str):
    """Python stages planned inside get batches of at most about ``size``, whatever the length of a row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on Python stages of the session get batches of about ``size``.

    For results that are computed after the function that plans them has returned. Spark's own limit
    is ten thousand rows, which the JVM holds outside its heap and Python holds again as texts.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def running_totals(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """Add, for each name in ``sums``, the sum of its column over all rows before this one.

    ``order`` must be a total order. Rows are range-partitioned, so no task sees more than its
    range; only one row per partition travels between ranges.
    """
    placed = stage_table(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_o_{n}") for n, c in sums.items()])
    offsets = offsets.select("_range", *[F.sum(f"_o_{n}").over(across).alias(f"_o_{n}") for n in sums])
    out = placed.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    out = out.join(F.broadcast(offsets), "_range")
    out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in sums})
    return out.drop("_range", *[f"_o_{n}" for n in sums])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordIds:
    """Numbers for words (bytes), the same for equal words within one task."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}

    def of(self, words: list) -> np.ndarray:
        ids = self.ids
        for w in words:
            if w not in ids:
                ids[w] = len(ids)
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def give_back() -> None:
    """Return memory that this Python worker has freed to the system.

    Workers are reused, and idle ones would hold it beside the next stage. Where the C library has no
    such call, only Arrow's pool is released.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now.

    It drops them when the driver collects its garbage, which can be long after the disk is needed.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every word; each different word is hashed once."""
    import xxhash

    known = dict.fromkeys(words)
    for w in known:
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
