"""Comparing renders and masks with a reference."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import any_of
from ..plans.joins import join_large

KEY = ["image_id", "x", "y"]
# The usual SSIM constants for 8-bit values.
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def image_quality(a: DataFrame, b: DataFrame, value: str = "v", tolerance: int = 2) -> DataFrame:
    """PSNR, mean SSIM over 8x8 blocks and the share of pixels within tolerance, per image.

    One full join on (image, x, y); block sums are aggregated first, so the per-image step sees one
    row per block. The figures are taken over pixels that both sides have; ``unmatched`` counts the
    others, and an image with none in common has null figures.
    """
    j = join_large(a.select(*KEY, F.col(value).alias("u")), b.select(*KEY, F.col(value).alias("t")), KEY, "full")
    both = F.col("u").isNotNull() & F.col("t").isNotNull()
    j = j.withColumns({"u": F.when(both, F.col("u")), "t": F.when(both, F.col("t"))})
    u, t = F.col("u").cast("double"), F.col("t").cast("double")
    blocks = j.groupBy("image_id", F.floor(F.col("x") / 8).alias("bx"), F.floor(F.col("y") / 8).alias("by")).agg(
        F.count("u").alias("n"),
        F.count_if(F.col("u").isNull()).alias("lost"),
        F.sum(u).alias("su"), F.sum(t).alias("st"),
        F.sum(u * u).alias("suu"), F.sum(t * t).alias("stt"), F.sum(u * t).alias("sut"),
        F.sum((u - t) * (u - t)).alias("se"),
        F.count_if(F.abs(u - t) <= tolerance).alias("within"),
    )
    n = F.nullif(F.col("n"), F.lit(0))
    mu, mt = F.col("su") / n, F.col("st") / n
    vu, vt = F.col("suu") / n - mu * mu, F.col("stt") / n - mt * mt
    cov = F.col("sut") / n - mu * mt
    ssim = ((mu * mt * 2.0 + C1) * (cov * 2.0 + C2)) / ((mu * mu + mt * mt + C1) * (vu + vt + C2))
    out = blocks.withColumn("ssim", ssim).groupBy("image_id").agg(
        F.try_divide(F.sum("se"), F.sum("n")).alias("mse"),
        F.avg("ssim").alias("ssim"),
        F.try_divide(F.sum("within"), F.sum("n")).alias("within_tolerance"),
        F.sum("lost").alias("unmatched"),
    )
    psnr = F.when(F.col("mse") > 0, F.log10(F.lit(255.0 * 255.0) / F.col("mse")) * 10.0)
    return out.select("image_id", "mse", psnr.alias("psnr"), "ssim", "within_tolerance", "unmatched")


def _boundary(mask: DataFrame, frames: DataFrame, threshold: float) -> DataFrame:
    """Set pixels with an unset 4-neighbour inside the frame.

    Only set pixels are ordered, so an absent pixel and one below the threshold are the same. Windows
    run inside one row or one column of a frame, which bounds them by its width or height.
    """
    m = mask.filter(F.col("w") >= threshold).select(*KEY)
    row = Window.partitionBy("image_id", "y").orderBy("x")
    col = Window.partitionBy("image_id", "x").orderBy("y")
    near = {"l": F.lag("x").over(row) == F.col("x") - 1, "r": F.lead("x").over(row) == F.col("x") + 1}
    m = m.withColumns(near)
    m = m.withColumns({"t": F.lag("y").over(col) == F.col("y") - 1, "d": F.lead("y").over(col) == F.col("y") + 1})
    m = join_large(m, frames, "image_id")
    inside = {"l": F.col("x") > F.col("x0"), "r": F.col("x") < F.col("x1"), "t": F.col("y") > F.col("y0"), "d": F.col("y") < F.col("y1")}
    edge = any_of(ok & ~F.coalesce(F.col(c), F.lit(False)) for c, ok in inside.items())
    return m.filter(edge).select(*KEY)


def _frames(pred: DataFrame, truth: DataFrame, images: DataFrame | None) -> DataFrame:
    if images is not None:
        zero = F.lit(0)
        return images.select(
            "image_id", zero.alias("x0"), (F.col("width") - 1).alias("x1"), zero.alias("y0"), (F.col("height") - 1).alias("y1")
        )
    return pred.select(*KEY).unionByName(truth.select(*KEY)).groupBy("image_id").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


def mask_quality(pred: DataFrame, truth: DataFrame, threshold: float = 0.5, images: DataFrame | None = None) -> DataFrame:
    """Soft IoU and the F-score of the mask boundaries, per image.

    Masks may leave out unset pixels. ``images`` (image_id, width, height) gives the frames; without
    it a frame is the smallest rectangle that holds both masks.
    """
    frames = _frames(pred, truth, images)
    p, t = pred.select(*KEY, F.col("w").alias("p")), truth.select(*KEY, F.col("w").alias("t"))
    both = join_large(p, t, KEY, "full").select(
        "image_id", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("t", F.lit(0.0)).alias("t")
    )
    iou = both.groupBy("image_id").agg(
        F.try_divide(F.sum(F.least("p", "t")), F.sum(F.greatest("p", "t"))).alias("iou")
    )
    bp = _boundary(pred, frames, threshold).withColumn("p", F.lit(1))
    bt = _boundary(truth, frames, threshold).withColumn("t", F.lit(1))
    b = join_large(bp, bt, KEY, "full").groupBy("image_id").agg(
        F.sum(F.coalesce("p", F.lit(0)) * F.coalesce("t", F.lit(0))).alias("hit"),
        F.sum(F.coalesce("p", F.lit(0)) + F.coalesce("t", F.lit(0))).alias("both"),
    )
    score = b.select("image_id", (F.col("hit") * 2.0 / F.col("both")).alias("boundary_f"))
    return join_large(iou, score, "image_id", "left")


def _reached(points: DataFrame, marks: DataFrame, tolerance: float) -> DataFrame:
    """``points`` (image_id, x, y) with ``hit``: some mark lies at most ``tolerance`` away.

    A mark covers one run of pixels in each row of its disc. Points and run starts of a row are put in
    order; a point is hit if the furthest end so far reaches it. A row of a frame bounds each window, and
    no point is paired with a mark.
    """
    most = math.floor(tolerance)
    halves = [(d, math.isqrt(math.floor(tolerance * tolerance - d * d))) for d in range(-most, most + 1)]
    disc = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(h).alias("h")) for d, h in halves])
    runs = marks.select("image_id", "x", "y", F.explode(disc).alias("s")).select(
        "image_id", (F.col("x") - F.col("s.h")).alias("x"), (F.col("y") + F.col("s.d")).alias("y"),
        (F.col("x") + F.col("s.h")).alias("stop"), F.lit(0).alias("kind"),
    )
    rows = runs.unionByName(points.select(*KEY, F.lit(None).cast(runs.schema["stop"].dataType).alias("stop"), F.lit(1).alias("kind")))
    so_far = Window.partitionBy("image_id", "y").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(F.max("stop").over(so_far) >= F.col("x"), F.lit(False))
    return rows.withColumn("hit", hit).filter("kind = 1").select(*KEY, "hit")


def boundary_score(
    pred: DataFrame, truth: DataFrame, tolerance: float = 2.0, threshold: float = 0.5, images: DataFrame | None = None
) -> DataFrame:
    """Precision, recall and F-score of mask boundaries that may be ``tolerance`` pixels apart, per image.

    A boundary pixel is right if the other mask has a boundary pixel within the Euclidean distance
    ``tolerance``; at 0 the F-score is that of :func:`mask_quality`. Frames are as there. A side without
    a boundary has a null share and the F-score is 0; without any boundary it is null.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    frames = _frames(pred, truth, images)
    bp, bt = _boundary(pred, frames, threshold), _boundary(truth, frames, threshold)
    sides = _reached(bp, bt, tolerance).withColumn("side", F.lit("p")).unionByName(
        _reached(bt, bp, tolerance).withColumn("side", F.lit("t"))
    )
    share = lambda side: F.try_divide(
        F.count_if((F.col("side") == side) & F.col("hit")), F.count_if(F.col("side") == side)
    )
    shares = sides.groupBy("image_id").agg(share("p").alias("precision"), share("t").alias("recall"))
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    score = F.when(p + r > 0, p * r * 2.0 / (p + r)).otherwise(0.0)
    return join_large(frames.select("image_id"), shares.withColumn("boundary_f", score), "image_id", "left")
