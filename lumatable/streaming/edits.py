"""Settling, throttling and catalogue refresh on streams, from built-in operators only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.files import file_hash, file_id, import_rows


def deduplicated(log: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Watermarked log without repeated deliveries of the same edit."""
    return log.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["photo_id", "seq"])


def stream_settled_edits(log: DataFrame, gap: str = "30 milliseconds", lateness: str = "1 minute") -> DataFrame:
    """Last edit of every burst, emitted once the watermark has closed the burst.

    Repeated deliveries count once.
    """
    return (
        deduplicated(log, lateness)
        .groupBy("photo_id", F.session_window("ts", gap).alias("session"))
        .agg(F.max_by(F.struct("seq", "action", "key", "value"), F.struct("ts", "seq")).alias("e"))
        .select("photo_id", "session", "e.*")
    )


def stream_throttled(log: DataFrame, slot: str = "100 milliseconds", lateness: str = "1 minute") -> DataFrame:
    """Latest edit of each photo per time slot; repeated deliveries count once.

    The value a photo settles on is the output of ``stream_settled_edits``; run both queries and
    unite their sinks for a live view that ends on it.
    """
    return (
        deduplicated(log, lateness)
        .groupBy("photo_id", F.window("ts", slot).alias("slot"))
        .agg(F.max_by(F.struct("seq", "action", "key", "value"), F.struct("ts", "seq")).alias("e"))
        .select("photo_id", "slot", "e.*")
    )


def refresh_catalogue(files: DataFrame, table_path: str, checkpoint: str):
    """Append library rows of newly arrived image files, with their identities.

    The rows are those of ``scan_photos`` plus ``content_hash``. Each batch is written once: the batch
    id names the partition and replaces it, so a batch repeated after a failure does not add its rows
    twice.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        hashes = batch.select(file_id(F.col("path")).alias("image_id"), file_hash("content").alias("content_hash"))
        (
            import_rows(batch, batch_id).join(hashes, "image_id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("import_batch")
            .parquet(table_path)
        )

    return (
        files.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
