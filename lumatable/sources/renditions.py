"""Writing graded pixels without ever touching the originals."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..operators.capture import stage_hashes
from ..operators.grade import complete_recipes, grade
from ..plans.joins import BROADCAST_ROWS, join_large, join_per_image
from ..plans.session import cut_lineage

#: Pixels that one round of ``refresh_renditions`` exchanges and writes, a bucket at least: bounds the scratch disk.
PIXELS_A_ROUND = 50_000_000
#: Ids alone are far narrower than the rows that ``BROADCAST_ROWS`` is meant for.
BROADCAST_IDS = 10 * BROADCAST_ROWS

PIXEL_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.PIXELS.fields)


def rendition_name(name: Column, suffix: str = "-graded.jpg") -> Column:
    """Base name without its last extension, plus a suffix."""
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(suffix))


def write_renditions(pixels: DataFrame, path: str, buckets: int = 64, photos: DataFrame | None = None) -> None:
    """Pixel table in buckets of images; fails if the target exists.

    ``photos`` (image_id, name) adds the table ``<path>-names`` with each rendition's file name.

    Rows are spread by (image, band of rows), so a huge photo is written by many tasks, and
    each file stays clustered by image, y, x for later scans.
    """
    if photos is not None:
        names = photos.select("image_id", "name", rendition_name(F.col("name")).alias("rendition"))
        names.write.mode("errorifexists").parquet(f"{path}-names")
    (
        pixels.withColumn("image_bucket", F.pmod(F.hash("image_id"), F.lit(buckets)))
        .repartition("image_bucket", "image_id", F.floor(F.col("y") / 1024))
        .sortWithinPartitions("image_bucket", "image_id", "y", "x")
        .write.mode("errorifexists")
        .partitionBy("image_bucket")
        .parquet(path)
    )


# --- keeping a stored table of renditions up to date ---------------------------


def render_hashes(images: DataFrame, recipes: DataFrame) -> DataFrame:
    """``image_id, source`` and a hash per render stage, for every image.

    A photo without a recipe has the hashes of the neutral one. ``source`` covers the frame size and, where
    the image table has it, ``content_hash``: another file under the same id is rendered anew.
    """
    held = [c for c in ("width", "height", "content_hash") if c in images.columns]
    source = images.select("image_id", F.xxhash64(*held).alias("source"))
    return join_large(source, stage_hashes(complete_recipes(images, recipes)), "image_id")


def stale_renditions(now: DataFrame, stored: DataFrame) -> DataFrame:
    """``image_id, reason``: what a stored table lacks, holds in an old form or holds too much.

    Reasons: ``new``, ``removed``, or the first stage whose hash differs (``source`` before all others).
    Both inputs are tables of :func:`render_hashes`.
    """
    stages = [c for c in now.columns if c not in ("image_id", "image_bucket")]
    side = lambda df, p: df.select("image_id", F.lit(True).alias(f"{p}there"), *[F.col(c).alias(p + c) for c in stages])
    both = join_large(side(now, "_n_"), side(stored, "_s_"), "image_id", "full")
    first = F.coalesce(*[F.when(~F.col(f"_n_{c}").eqNullSafe(F.col(f"_s_{c}")), F.lit(c)) for c in stages])
    reason = F.when(F.col("_s_there").isNull(), "new").when(F.col("_n_there").isNull(), "removed").otherwise(first)
    return both.select("image_id", reason.alias("reason")).filter("reason IS NOT NULL")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("image_id"), F.lit(buckets))


def _write_buckets(df: DataFrame, path: str, keys: list) -> None:
    """Replace the buckets that ``df`` has rows of; Spark swaps them in when the job commits."""
    (
        df.repartition("image_bucket", *keys)
        .sortWithinPartitions("image_bucket", "image_id", *[c for c in ("y", "x") if c in df.columns])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("image_bucket")
        .parquet(path)
    )


def _drop_buckets(spark: SparkSession, path: str, numbers: list[int]) -> None:
    """Remove the folders of buckets that have no photo any more; an overwrite leaves them as they are."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for n in numbers:
        folder = hadoop(f"{path}/image_bucket={n}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def read_renditions(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of a table kept by :func:`refresh_renditions`."""
    return _stored(spark, path, f"{PIXEL_SCHEMA}, image_bucket int").drop("image_bucket")


def _rounds(photos: dict[int, int], pixels: dict[int, int]) -> list[list[int]]:
    """The buckets of ``photos`` in groups of at most ``PIXELS_A_ROUND`` pixels, or of one bucket."""
    rounds, held = [], 0
    for bucket in sorted(photos):
        n = pixels.get(bucket) or 0
        if not rounds or held + n > PIXELS_A_ROUND:
            rounds.append([])
            held = 0
        rounds[-1].append(bucket)
        held += n
    return rounds


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files go when the query that made them ends; otherwise they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def refresh_renditions(
    path: str, pixels: DataFrame, images: DataFrame, recipes: DataFrame, render=grade, buckets: int = 64
) -> DataFrame:
    """Bring a stored table of renditions up to date; returns ``image_id, reason`` of what was done.

    ``<path>`` holds the pixels and ``<path>-hashes`` the stage hashes of the recipes they were rendered with,
    both in buckets of photos. Only photos whose hashes differ are rendered, and only their buckets are
    written: the other photos of such a bucket are copied, all other files stay as they are. The first call
    finds nothing stored and renders everything.

    Buckets are done in rounds of a bounded number of pixels, so that beside the table itself the disk holds one
    round's exchange and new files, however large the library.

    Pixels are replaced before hashes. A run that fails in between leaves old hashes, so the next run
    does the same photos again. The number of buckets must stay the same for a table.
    """
    spark = pixels.sparkSession
    now = render_hashes(images, recipes).withColumn("image_bucket", _bucket(buckets))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema.fields)
    stored = _stored(spark, f"{path}-hashes", schema)
    with _shuffles_dropped(spark):
        now, stale = cut_lineage(now), cut_lineage(stale_renditions(now, stored))
        # at most one row per bucket
        by_bucket = lambda df, n: {r[0]: r[1] for r in df.groupBy(_bucket(buckets).alias("b")).agg(n).collect()}
        photos = by_bucket(stale, F.count("*"))
        if not photos:
            return stale
        here = now.filter(F.col("image_bucket").isin([*photos]))
        filled = {r[0] for r in here.select("image_bucket").distinct().collect()}
        rounds = _rounds(photos, by_bucket(images, F.sum(F.col("width").cast("long") * F.col("height"))))
        for some in rounds:
            inputs, changed = (pixels, images, recipes), stale
            if len(rounds) > 1:
                *inputs, changed = (df.filter(_bucket(buckets).isin(some)) for df in (*inputs, stale))
            again = changed.filter("reason != 'removed'").select("image_id")
            few = sum(photos[b] for b in some) <= BROADCAST_IDS
            fresh = render(*[join_per_image(df, again, few, how="left_semi") for df in inputs])
            columns = S.PIXELS.fieldNames()
            old = _stored(spark, path, f"{PIXEL_SCHEMA}, image_bucket int").filter(F.col("image_bucket").isin(some))
            kept = join_per_image(old, changed.select("image_id"), few, how="left_anti")
            whole = fresh.select(*columns).unionByName(kept.select(*columns)).withColumn("image_bucket", _bucket(buckets))
            _write_buckets(whole, path, ["image_id", F.floor(F.col("y") / 1024)])
        _drop_buckets(spark, path, [b for b in photos if b not in filled])
        _write_buckets(here, f"{path}-hashes", [])
        _drop_buckets(spark, f"{path}-hashes", [b for b in photos if b not in filled])
    return stale
