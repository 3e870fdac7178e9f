"""Session settings the plans in this package rely on."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A photo holding a large share of all pixels makes its join partition hot; AQE splits it.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The tone chain compiles to one method too large for the JIT; past this size Spark
    # generates several small projections instead of one fused loop, which then do get compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Tables dealt out by photo meet on (photo, x, y) without another exchange of their pixels.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

#: Photos whose pixels, curves or parameters one task makes: keeps a task's memory the same however many there are.
PHOTOS_A_TASK = 2000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "lumatable", master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a private one only in local mode, where none is needed."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df):
    """Reliable checkpoint, so that iterative jobs survive the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df, *keys, rows: int = 0):
    """Repartition few rows that are about to be exploded into many.

    The count is explicit, since AQE judges the small input and would merge it into one task. It
    grows with ``rows``, where the caller has counted them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, df.sparkSession.sparkContext.defaultParallelism, -(-rows // PHOTOS_A_TASK))
    return df.repartition(parts, *keys)
