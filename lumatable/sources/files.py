"""Reading photo files: listing, identity and pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamReader

from ..operators.catalog import new_photos, prepend
from ..plans.session import cut_lineage, spread

# Accepted image extensions and their MIME types.
IMAGE_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "webp": "image/webp",
    "svg": "image/svg+xml",
}
BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_id(path) -> Column:
    """Id of a file: the hash of its location, however the reader spells the scheme's slashes.

    Stable across rescans and the same for listings, pixels and streams; no global counter needed.
    """
    return F.xxhash64(F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/"))


def file_hash(content) -> Column:
    return F.sha2(content, 256)


def _listed(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    types = F.create_map(*[F.lit(v) for item in IMAGE_TYPES.items() for v in item])
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumns({"name": name, "mime": F.try_element_at(types, ext)}).filter(
        F.col("mime").startswith("image/")
    )


def scan_photos(spark: SparkSession, path: str, import_batch: int = 0) -> DataFrame:
    """New library rows for the image files under a path; the bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return import_rows(files, import_batch)


def import_rows(files: DataFrame, import_batch: int) -> DataFrame:
    """Library rows of a listing, the same for scans and streams.

    ``import_pos`` counts the files of the batch in the order of their paths. The batch is ordered by
    range partitions; only one row per partition is gathered for the offsets.
    """
    listed = _listed(files.select("path", "modificationTime", "length"))
    ranged = listed.repartitionByRange(F.col("path")).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy("path")
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranged = cut_lineage(ranged)  # partition numbers must not change between the two uses
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    placed = ranged.join(F.broadcast(offsets), "_part").withColumn(
        "import_pos", F.col("_before") + F.row_number().over(inside) - 1
    )
    rows = placed.select(
        file_id(F.col("path")).alias("image_id"), "path", "name", "mime",
        F.col("length").alias("byte_length"),
        F.lit(import_batch).cast("long").alias("import_batch"),
        "import_pos",
    )
    return new_photos(rows)


def import_photos(spark: SparkSession, path: str, library: DataFrame) -> DataFrame:
    """Import a folder into a library: files it doesn't hold yet come first, as a new batch."""
    batch = library.agg(F.coalesce(F.max("import_batch") + 1, F.lit(0))).first()[0]
    new = scan_photos(spark, path, int(batch)).join(library.select("image_id"), "image_id", "left_anti")
    return prepend(new, library)


def source_identity(spark: SparkSession, path: str) -> DataFrame:
    """Path, SHA-256 and length of every file; opened for reading only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", file_hash("content").alias("content_hash"), F.col("length").alias("byte_length")
    )


PIXEL_ROWS = "image_id long, x int, y int, r int, g int, b int, a int"


def _pixels_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scanlines of BGR, BGRA or grey bytes to pixel rows, a line at a time as arrays."""
    names = ["image_id", "x", "y", "r", "g", "b", "a"]
    for batch in batches:
        parts, rows = [], 0
        for image, y, n, line in zip(*[batch.column(c).to_pylist() for c in ("image_id", "y", "n", "line")]):
            v = np.frombuffer(line, np.uint8).reshape(-1, n).astype(np.int32)
            b, g, r = (v[:, 0], v[:, 1], v[:, 2]) if n > 2 else (v[:, 0],) * 3
            full = lambda k: np.full(len(v), k, np.int32)
            parts.append([np.full(len(v), image, np.int64), np.arange(len(v), dtype=np.int32), full(y), r, g, b, v[:, 3] if n == 4 else full(255)])
            rows += len(v)
            if rows > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)
                parts, rows = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)


def scan_pixels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decode the image files below a path: (images, pixels, quarantined).

    The built-in image source stores rows of BGR or BGRA bytes, or single grey bytes; files are cut
    into scanlines, which are spread over tasks before they become pixels. Files that can't be
    decoded are in the third table (image_id, path, name, reason), so no listed file is missing.
    """
    src = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    src = src.withColumns({
        "image_id": file_id(F.col("origin")), "name": F.regexp_extract("origin", r"([^/]+)$", 1),
        "_ok": (F.col("width") > 0) & (F.col("height") > 0) & F.col("nChannels").isin(1, 3, 4),
    })
    good = src.filter("_ok")
    images = good.select("image_id", "name", F.col("origin").alias("path"), "width", "height")
    bad = src.filter("NOT coalesce(_ok, false)").select(
        "image_id", F.col("origin").alias("path"), "name", F.lit("not decodable").alias("reason")
    )
    size = F.col("width") * F.col("nChannels")
    lines = spread(good, "image_id").select(
        "image_id", F.col("nChannels").alias("n"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.col("height") - 1),
                lambda y: F.substring(F.col("data"), y * size + 1, size),
            )
        ).alias("y", "line"),
    )
    pixels = spread(lines, "image_id", "y").mapInArrow(_pixels_of_lines, PIXEL_ROWS)
    return images, pixels, bad


def stream_photos(spark: SparkSession, path: str) -> DataFrame:
    """Image files arriving under a path, as a stream of (path, name, mime, length, content)."""
    reader: DataStreamReader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
    return _listed(reader.option("recursiveFileLookup", "true").load(path))
