"""Raw mosaics, profiles, render staleness and model licences as table operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Order in which a camera profile is trusted.
PROFILE_PRIORITY = ("embedded", "camera_db", "decoder")
RENDERED_PRIORITY = ("icc", "srgb_tag", "metadata_rule")
# What a rendered file (JPEG, PNG, ...) without any profile is taken for, with a warning.
RENDERED_FALLBACK = "srgb"

# Render stages in order with the parameters they depend on.
STAGES = {
    "geometry": ["rotation", "flipHorizontal", "flipVertical"],
    "mask_raster": ["maskFeather"],
    "tone": [
        "exposure", "temperature", "tint", "maskExposure", "vignette", "lensBrightness",
        "shadows", "highlights", "whites", "blacks", "contrast", "clarity",
    ],
    "color": ["vibrance", "saturation"],
    "detail": ["noiseReduction", "sharpness"],
}


def normalize_mosaic(raw: DataFrame, levels: DataFrame) -> DataFrame:
    """(raw - black) / (white - black) with levels per camera and channel; not clamped.

    ``raw``: image_id, camera, channel, x, y, v; ``levels``: camera, channel, black, white, and
    optionally row_from / row_to for row-dependent black (an inclusive band), or tile_size, tile_x,
    tile_y for black per sensor tile. A photosite without a level keeps its row, with a null value and
    ``level_status`` ``no-level``; where white equals black it is ``flat-level``.
    """
    keys = ["camera", "channel"]
    if "row_from" in levels.columns:
        # bands become one row per sensor row, so the join stays an equality join
        levels = levels.select(
            *keys, "black", "white", F.explode(F.sequence("row_from", "row_to")).alias("y")
        )
        keys = [*keys, "y"]
    if "tile_size" in levels.columns:
        # a camera has one tile size, which turns a position into the tile's key
        sizes = levels.groupBy("camera").agg(F.max("tile_size").alias("_size"))
        raw = raw.join(sizes, "camera", "left").withColumns(
            {f"tile_{a}": F.floor(F.col(a) / F.col("_size")).cast("int") for a in ("x", "y")}
        ).drop("_size")
        levels = levels.select(*keys, "black", "white", F.col("tile_x").cast("int"), F.col("tile_y").cast("int"))
        keys = [*keys, "tile_x", "tile_y"]
    j = raw.join(levels.withColumn("_level", F.lit(True)), keys, "left")
    status = (
        F.when(F.col("_level").isNull(), "no-level").when(F.col("white") == F.col("black"), "flat-level").otherwise("ok")
    )
    return j.withColumns(
        {
            "value": F.try_divide(F.col("v") - F.col("black"), F.col("white") - F.col("black")),
            "level_status": status,
        }
    ).drop("black", "white", "_level", "tile_x", "tile_y")


def cfa_label(raw: DataFrame, patterns: DataFrame) -> DataFrame:
    """Colour of each photosite from the periodic pattern of its camera.

    ``patterns``: camera, period_x, period_y, cells (row by row). Periods differ per camera, so
    the pattern row is joined by camera and the cell is looked up in its array. Photosites of an
    unknown camera keep their row, with a null channel and ``cfa_status`` ``unknown-camera``.
    """
    j = raw.join(patterns, "camera", "left")
    at = (F.col("y") % F.col("period_y")) * F.col("period_x") + F.col("x") % F.col("period_x")
    status = F.when(F.col("cells").isNull(), "unknown-camera").otherwise("ok")
    return j.withColumns({"channel": F.get("cells", at.cast("int")), "cfa_status": status}).drop(
        "period_x", "period_y", "cells"
    )


def resolve_profile(photos: DataFrame, candidates: DataFrame, priority=PROFILE_PRIORITY) -> DataFrame:
    """Best valid profile per photo, or an explicit status where there is none.

    ``candidates``: image_id, source, profile_id, valid. The choice is an aggregate, so it needs
    no ordering window. Photos with a true ``rendered`` column (JPEG, PNG, ...) follow
    ``RENDERED_PRIORITY`` and fall back to ``RENDERED_FALLBACK`` with the status ``assumed`` and a
    warning; raw photos without a profile are ``profile-required``.
    """
    order = {s: i for i, s in enumerate([*priority, *RENDERED_PRIORITY])}
    rank = F.when(F.lit(False), 0)
    for source, i in order.items():
        rank = rank.when(F.col("source") == source, i)
    rendered = F.coalesce("rendered", F.lit(False)) if "rendered" in photos.columns else F.lit(False)
    asked = photos.select("image_id", rendered.alias("_rendered"))
    fits = F.when(F.col("_rendered"), F.col("source").isin(*RENDERED_PRIORITY)).otherwise(F.col("source").isin(*priority))
    usable = candidates.filter("valid").join(asked, "image_id").filter(fits).withColumn("_rank", rank)
    best = usable.groupBy("image_id").agg(
        F.min_by(F.struct("source", "profile_id"), F.struct("_rank", "profile_id")).alias("p")
    )
    assumed = F.col("p").isNull() & F.col("_rendered")
    return asked.join(best, "image_id", "left").select(
        "image_id",
        F.when(assumed, "fallback").otherwise(F.col("p.source")).alias("source"),
        F.when(assumed, RENDERED_FALLBACK).otherwise(F.col("p.profile_id")).alias("profile_id"),
        F.when(assumed, "assumed").when(F.col("p").isNull(), "profile-required").otherwise("resolved").alias("status"),
        F.when(assumed, f"no embedded profile, taken for {RENDERED_FALLBACK}").alias("warning"),
    )


def stage_hashes(recipes: DataFrame) -> DataFrame:
    """One hash per render stage; the mask geometry belongs to the mask raster."""
    cols = []
    for stage, keys in STAGES.items():
        present = [F.col(k) for k in keys if k in recipes.columns]
        if stage == "mask_raster" and "mask" in recipes.columns:
            present.append(F.col("mask"))
        if stage == "tone" and "curve" in recipes.columns:
            present.append(F.col("curve"))
        cols.append(F.xxhash64(*present).alias(stage) if present else F.lit(0).cast("long").alias(stage))
    return recipes.select("image_id", *cols)


def changed_since_render(recipes: DataFrame, rendered: DataFrame) -> DataFrame:
    """Photos whose stages changed since the last render, with the first stale stage.

    ``rendered`` is a stored ``stage_hashes`` table. Local exposure is a tone parameter, so
    changing it leaves the mask raster fresh.
    """
    now = stage_hashes(recipes)
    old = rendered.select("image_id", *[F.col(s).alias(f"_{s}") for s in STAGES])
    first = F.coalesce(*[F.when(~F.col(s).eqNullSafe(F.col(f"_{s}")), F.lit(s)) for s in STAGES])
    mask_stale = ~F.col("mask_raster").eqNullSafe(F.col("_mask_raster"))
    return (
        now.join(old, "image_id", "left")
        .select("image_id", first.alias("first_stale"), mask_stale.alias("mask_stale"))
        .filter(F.col("first_stale").isNotNull())
    )


def license_audit(models: DataFrame, clearances: DataFrame) -> DataFrame:
    """Models that may not be bundled, with the reason.

    ``models``: model_id, sha256, license_id; ``clearances``: license_id, scope (code, weights).
    A complete manifest and both clearances are needed.
    """
    cleared = lambda scope: clearances.filter(F.col("scope") == scope).select("license_id").distinct()
    complete = F.col("sha256").rlike("^[0-9a-f]{64}$") & F.col("license_id").isNotNull()
    good = models.filter(complete)
    part = lambda df, reason: df.select("model_id", F.lit(reason).alias("reason"))
    return (
        part(models.filter(~F.coalesce(complete, F.lit(False))), "incomplete manifest")
        .unionByName(part(good.join(cleared("code"), "license_id", "left_anti"), "code licence not cleared"))
        .unionByName(part(good.join(cleared("weights"), "license_id", "left_anti"), "weight licence not cleared"))
    )
