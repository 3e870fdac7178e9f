"""The photo library as a table: albums, ratings, edit flags, identity and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.numeric import all_of, is_finite
from ..functions.recipe import (
    count_edits,
    default_curve,
    default_mask,
    has_adjustments,
    has_curve_edits,
    has_mask_edits,
    is_edited,
)

ALBUMS = ("all", "recent", "five-star", "edited")


def album_predicate(album: str) -> Column:
    rules = {
        "all": lambda: F.lit(True),
        "recent": lambda: F.col("imported"),
        "five-star": lambda: F.col("rating") == 5,
        "edited": is_edited,
    }
    if album not in rules:
        raise ValueError(f"unknown album {album!r}; choose one of {', '.join(ALBUMS)}")
    return rules[album]()


def smart_album(photos: DataFrame, album: str) -> DataFrame:
    return photos.filter(album_predicate(album))


def album_counts(photos: DataFrame) -> DataFrame:
    return photos.agg(
        F.count("*").alias("all"),
        *[
            F.count_if(album_predicate(a)).alias(name)
            for a, name in (("recent", "recent"), ("five-star", "five"), ("edited", "edited"))
        ],
    )


def library_order() -> list[Column]:
    """Newest import first; inside a batch the order of import."""
    return [F.col("import_batch").desc(), F.col("import_pos").asc()]


def album_head(photos: DataFrame, album: str, by=()) -> DataFrame:
    """First photo of the album in library order, per group of ``by`` columns if given.

    An aggregate with a map-side partial, so one dominant group costs nothing extra.
    """
    rank = F.struct((-F.col("import_batch")).alias("b"), F.col("import_pos").alias("p"))
    first = F.min_by(F.struct("image_id", "name"), rank).alias("h")
    heads = smart_album(photos, album).groupBy(*by).agg(first)
    return heads.filter(F.col("h").isNotNull()).select(*by, "h.image_id", "h.name")


def edit_flags(photos: DataFrame) -> DataFrame:
    return photos.withColumns(
        {
            "has_adjustments": has_adjustments(),
            "has_curve_edits": has_curve_edits(F.col("curve")),
            "has_mask_edits": has_mask_edits(F.col("mask")),
            "is_edited": is_edited(),
            "n_edits": count_edits(),
        }
    )


def toggle_rating(photos: DataFrame) -> DataFrame:
    return photos.withColumn("rating", F.when(F.col("rating") == 5, 0).otherwise(5))


def prepend(imported: DataFrame, photos: DataFrame) -> DataFrame:
    """Union of new and old rows; the new batch number sorts first in library order."""
    return imported.unionByName(photos, allowMissingColumns=True)


def remove_photos(photos: DataFrame, ids: DataFrame, library="library_id") -> DataFrame:
    """Drop the listed photos, but leave a library as it is when that would empty it.

    ``ids`` holds ``image_id``. The guard compares per-library counts, which are aggregated
    before they are joined back. Photos without a library form one of their own.
    """
    marked = photos.join(
        ids.select("image_id").distinct().withColumn("_gone", F.lit(True)), "image_id", "left"
    ).withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    left = marked.groupBy(library).agg(F.count_if(~F.col("_gone")).alias("_left"))
    emptied = left.filter("_left = 0").select(F.col(library).alias("_library"))
    restored = F.col(library).eqNullSafe(F.col("_library"))
    stay = marked.filter(~F.col("_gone")).unionByName(
        marked.filter("_gone").join(emptied, restored, "left_semi")
    )
    return stay.select(*photos.columns)


def verify_unchanged(manifest: DataFrame, rescan: DataFrame) -> DataFrame:
    """Compare stored identities with a fresh scan: unchanged, changed, missing, new or unreadable.

    A path is new or missing if the other side has no row for it. One with rows on both sides is
    ``unreadable`` if the scan has no hash, and ``unverified`` if only the stored hash is missing.
    """
    old = manifest.select("path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("_old"))
    new = rescan.select("path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "missing")
        .when(F.col("new_hash").isNull(), "unreadable")
        .when(F.col("old_hash").isNull(), "unverified")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, "path", "full").select("path", status.alias("status"))


def _kept(proposed: Column, current: Column, lo: float, hi: float) -> Column:
    return F.when(is_finite(proposed), F.least(F.lit(hi), F.greatest(F.lit(lo), proposed))).otherwise(
        current
    )


def sanitize_recipe(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """Accept typed-in values: ignore non-finite ones, clamp the others into their range.

    ``current`` supplies the value that stays when the input is ignored (neutral where the
    photo has no recipe yet). A curve with a coordinate that is not finite is ignored as a whole, a
    mask field by itself. Reports which keys were clamped and which ignored, mask fields as
    ``mask.<field>``.
    """
    kept = [c for c in ("mask", "curve") if c in proposed.columns]
    held = {c: F.col(c) if c in current.columns else F.lit(None) for c in kept}
    old = current.select(
        "image_id", *[F.col(k).alias(f"_old_{k}") for k in S.KEYS], *[v.alias(f"_old_{c}") for c, v in held.items()]
    )
    j = proposed.join(old, "image_id", "left")
    values, clamped, ignored = {}, [], []
    for k, (lo, hi) in S.ADJUSTMENT_RANGES.items():
        before = F.coalesce(F.col(f"_old_{k}"), F.lit(S.ADJUSTMENT_DEFAULTS[k]))
        values[k] = _kept(F.col(k), before, lo, hi).alias(k)
        clamped.append(F.when(is_finite(F.col(k)) & ~F.col(k).between(lo, hi), F.lit(k)))
        ignored.append(F.when(~is_finite(F.col(k)), F.lit(k)))
    out = [F.col("image_id"), *values.values()]
    if "mask" in proposed.columns:
        fields = []
        for f, (lo, hi) in S.MASK_RANGES.items():
            v, before = F.col("mask")[f], F.lit(S.MASK_DEFAULTS[f])
            if "mask" in current.columns:
                before = F.coalesce(F.col("_old_mask")[f], before)
            fields.append(_kept(v, before, lo, hi).alias(f))
            clamped.append(F.when(is_finite(v) & ~v.between(lo, hi), F.lit(f"mask.{f}")))
            ignored.append(F.when(~is_finite(v), F.lit(f"mask.{f}")))
        out.append(F.struct(*fields).alias("mask"))
    if "curve" in proposed.columns:
        unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
        sound = F.coalesce(F.forall("curve", lambda p: is_finite(p["x"]) & is_finite(p["y"])), F.lit(False))
        before = default_curve()
        if "curve" in current.columns:
            before = F.coalesce(F.col("_old_curve"), before)
        taken = F.transform(
            "curve",
            lambda p: F.struct(
                p["id"].alias("id"),
                F.when(p["id"] == "black", 0.0)
                .when(p["id"] == "white", 1.0)
                .otherwise(unit(p["x"]))
                .alias("x"),
                unit(p["y"]).alias("y"),
            ),
        )
        out.append(F.when(sound, taken).otherwise(before).alias("curve"))
        ignored.append(F.when(~sound, F.lit("curve")))
    return j.select(
        *out,
        F.array_compact(F.array(*clamped)).alias("clamped_keys"),
        F.array_compact(F.array(*ignored)).alias("ignored_keys"),
    )


def adjustments_valid(prefix: str = "") -> Column:
    """All ten sidecar values finite and exposure within five stops."""
    cols = [F.col(f"{prefix}{k}") for k in S.SIDECAR_KEYS]
    return all_of(is_finite(c) for c in cols) & F.coalesce(
        F.col(f"{prefix}exposureEv").between(-5.0, 5.0), F.lit(False)
    )


def validate_adjustments(sidecars: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Split into (valid, quarantined) rows."""
    ok = adjustments_valid(prefix)
    return sidecars.filter(ok), sidecars.filter(~ok)


def new_photos(files: DataFrame) -> DataFrame:
    """Library rows for freshly imported files: rating 0, neutral recipe, empty stacks."""
    stack = F.expr(
        "cast(array() as array<struct<adjustments:array<double>,"
        "curve:array<struct<id:string,x:double,y:double>>,"
        "mask:struct<x:double,y:double,width:double,height:double,rotation:double>>>)"
    )
    return files.select(
        "*",
        F.lit(True).alias("imported"),
        F.lit(0).alias("rating"),
        *[F.lit(v).alias(k) for k, v in S.ADJUSTMENT_DEFAULTS.items()],
        default_curve().alias("curve"),
        default_mask().alias("mask"),
        stack.alias("history"),
        stack.alias("future"),
    )
