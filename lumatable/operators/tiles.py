"""Tiles with a halo: bounded units of work for neighbourhood stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.joins import has_few_rows, join_per_image

TILE = 1024


def tile_with_halo(
    pixels: DataFrame, size: int = TILE, halo: int = 1, images: DataFrame | None = None
) -> DataFrame:
    """Copy each pixel into every tile whose interior or halo covers it.

    Needs ``width`` and ``height`` columns, or an ``images`` table that has them. Adds
    ``tile_x``, ``tile_y`` and ``is_interior``; keeping interior rows only gives back every
    pixel exactly once. A (image, tile) group never exceeds ``(size + 2 * halo) ** 2`` rows,
    whatever the size of the frame.
    """
    if images is not None:
        dims = images.select("image_id", "width", "height")
        pixels = join_per_image(pixels, dims, has_few_rows(dims))

    def span(pos, extent):
        first = F.floor(F.greatest(F.col(pos) - halo, F.lit(0)) / size)
        last = F.floor(F.least(F.col(pos) + halo, F.col(extent) - 1) / size)
        return F.sequence(first.cast("int"), last.cast("int"))

    return (
        pixels.withColumn("tile_x", F.explode(span("x", "width")))
        .withColumn("tile_y", F.explode(span("y", "height")))
        .withColumn(
            "is_interior",
            (F.floor(F.col("x") / size) == F.col("tile_x"))
            & (F.floor(F.col("y") / size) == F.col("tile_y")),
        )
    )


def blend_tiles(tiles: DataFrame, tile_size: int, value: str = "v") -> DataFrame:
    """Weighted mean of overlapping tile results.

    Rows carry ``image_id, x, y, tile_x0, tile_y0`` (origin of the tile) and a value; the
    weight is a tent that falls towards the tile edges. A missing value takes no weight; where all
    are missing the result is null.
    """
    def tent(pos, origin):
        d = F.col(pos) - F.col(origin)
        return F.least(d + 1, F.lit(tile_size) - d).cast("double")

    w = tent("x", "tile_x0") * tent("y", "tile_y0")
    return (
        tiles.withColumn("_w", w)
        .groupBy("image_id", "x", "y")
        .agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), F.col("_w")))).alias(value))
    )


def apply_per_tile(pixels: DataFrame, fn, schema, size: int = TILE, halo: int = 1, images=None):
    """Hook for user filters: ``fn`` gets one tile with halo as a pandas frame.

    The output schema must keep ``image_id, x, y``; only interior pixels are returned.
    """
    tiled = tile_with_halo(pixels, size, halo, images)
    return tiled.groupBy("image_id", "tile_x", "tile_y").applyInPandas(
        lambda pdf: (lambda out: out[out["is_interior"]])(fn(pdf)), schema
    )
