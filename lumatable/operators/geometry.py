"""Rotation and flips, previews and pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import half_up
from ..plans.joins import BROADCAST_ROWS, has_few_rows, join_per_image
from ..plans.session import spread
from .. import schema as S


def _with(df: DataFrame, **exprs: str) -> DataFrame:
    return df.withColumns({name: F.expr(e) for name, e in exprs.items()})


def frame_geometry(dims: DataFrame) -> DataFrame:
    """Add the struct ``geo`` (turn, flips, output frame) to a table with one row per image.

    Reads ``width``, ``height`` and the rotation fields of ``k``. Quarter turns swap integer
    sizes; other angles use the bounding box of the turned frame.
    """
    dims = _with(dims, turn="pmod(k.rotation, 360D)")
    dims = _with(
        dims,
        # -1 marks an angle that is not a quarter turn
        quarter="CASE WHEN pmod(turn, 90D) = 0D THEN cast(turn / 90D as int) ELSE -1 END",
        co="cos(turn * pi() / 180D)",
        si="sin(turn * pi() / 180D)",
    )
    box = "greatest(1, cast(ceil(abs(width * {0}) + abs(height * {1})) as int))"
    dims = _with(
        dims,
        ow=f"CASE WHEN quarter IN (0, 2) THEN width WHEN quarter IN (1, 3) THEN height "
        f"ELSE {box.format('co', 'si')} END",
        oh=f"CASE WHEN quarter IN (0, 2) THEN height WHEN quarter IN (1, 3) THEN width "
        f"ELSE {box.format('si', 'co')} END",
    )
    return _with(
        dims,
        geo="named_struct('quarter', quarter, 'co', co, 'si', si, 'w', width, 'h', height, "
        "'ow', ow, 'oh', oh, 'sx', CASE WHEN k.flip_h THEN -1D ELSE 1D END, "
        "'sy', CASE WHEN k.flip_v THEN -1D ELSE 1D END)",
    ).drop("turn", "quarter", "co", "si", "ow", "oh")


# exact permutation of a quarter turn, then the flips inside the turned frame
_TURN_X = "CASE geo.quarter WHEN 0 THEN x WHEN 1 THEN geo.h - 1 - y WHEN 2 THEN geo.w - 1 - x ELSE y END"
_TURN_Y = "CASE geo.quarter WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN geo.h - 1 - y ELSE geo.w - 1 - x END"
_PLACE_X = "CASE WHEN geo.sx < 0D THEN geo.ow - 1 - qx ELSE qx END"
_PLACE_Y = "CASE WHEN geo.sy < 0D THEN geo.oh - 1 - qy ELSE qy END"
# continuous source position of the centre of output pixel (x, y)
_BACK_X = (
    "geo.w / 2D + ((x + 0.5D - geo.ow / 2D) * geo.sx * geo.co + (y + 0.5D - geo.oh / 2D) * geo.sy * geo.si)"
)
_BACK_Y = (
    "geo.h / 2D + ((y + 0.5D - geo.oh / 2D) * geo.sy * geo.co - (x + 0.5D - geo.ow / 2D) * geo.sx * geo.si)"
)
# first output column / row whose centre can lie in the turned cell of source pixel (x, y)
_REACH = "((abs(geo.co) + abs(geo.si)) / 2D + 0.5D + 1e-9D)"
_FIRST_X = (
    "cast(ceil(geo.ow / 2D + geo.sx * ((x + 0.5D - geo.w / 2D) * geo.co - (y + 0.5D - geo.h / 2D) * geo.si) "
    f"- {_REACH}) as int)"
)
_FIRST_Y = (
    "cast(ceil(geo.oh / 2D + geo.sy * ((x + 0.5D - geo.w / 2D) * geo.si + (y + 0.5D - geo.h / 2D) * geo.co) "
    f"- {_REACH}) as int)"
)


def turn_quarters(pixels: DataFrame) -> DataFrame:
    """Quarter turns and flips: a projection of the coordinates."""
    pixels = _with(pixels, qx=_TURN_X, qy=_TURN_Y)
    return _with(pixels, x=_PLACE_X, y=_PLACE_Y, width="geo.ow", height="geo.oh").drop("qx", "qy", "geo")


def turn_any(pixels: DataFrame, free: DataFrame) -> DataFrame:
    """Quarter turns and other angles in one pass over the pixels, without a join.

    A quarter turn moves a pixel to one place. For other angles (nearest source pixel) a source can
    be the nearest of at most four output pixels, so it proposes those four and keeps the ones whose
    own inverse position falls inside it. Output pixels with no source are generated from ``free``
    (``frame_geometry`` of the photos with such angles) as transparent black.
    """
    keep = [c for c in pixels.columns if c not in ("x", "y")]
    whole = "geo.quarter >= 0"
    moved = _with(
        pixels, sx="x", sy="y",
        qx=f"CASE WHEN {whole} THEN {_TURN_X} ELSE {_FIRST_X} END",
        qy=f"CASE WHEN {whole} THEN {_TURN_Y} ELSE {_FIRST_Y} END",
    ).select(
        *keep, "sx", "sy", "qx", "qy",
        F.expr(f"explode(CASE WHEN {whole} THEN array(0) ELSE array(0, 1, 2, 3) END) AS n"),
    )
    covered = _with(
        moved,
        x=f"CASE WHEN {whole} THEN {_PLACE_X} ELSE qx + n % 2 END",
        y=f"CASE WHEN {whole} THEN {_PLACE_Y} ELSE qy + shiftright(n, 1) END",
    ).filter(
        f"{whole} OR (x BETWEEN 0 AND geo.ow - 1 AND y BETWEEN 0 AND geo.oh - 1 "
        f"AND floor({_BACK_X}) = sx AND floor({_BACK_Y}) = sy)"
    )
    out = ["x", "y", *keep]
    turned = covered.select(*out).unionByName(_uncovered(free).select(*out))
    return _with(turned, width="geo.ow", height="geo.oh").drop("geo")


_COVERED = f"floor({_BACK_X}) BETWEEN 0 AND geo.w - 1 AND floor({_BACK_Y}) BETWEEN 0 AND geo.h - 1"


def _uncovered(free: DataFrame) -> DataFrame:
    """Pixels of turned frames whose centre lies on no source pixel, as transparent black."""
    blank = full_grid(_with(free, ow="geo.ow", oh="geo.oh"), "ow", "oh").filter(f"NOT ({_COVERED})")
    return blank.withColumns({c: F.lit(0) for c in ("r", "g", "b", "a")})


# place of a source pixel in the turned frame, and how far from it in x or y it still has weight
_CENTRE_X = (
    "(geo.ow / 2D + geo.sx * ((sx + 0.5D - geo.w / 2D) * geo.co - (sy + 0.5D - geo.h / 2D) * geo.si) - 0.5D)"
)
_CENTRE_Y = (
    "(geo.oh / 2D + geo.sy * ((sx + 0.5D - geo.w / 2D) * geo.si + (sy + 0.5D - geo.h / 2D) * geo.co) - 0.5D)"
)
_SPAN = "(abs(geo.co) + abs(geo.si))"


def scatter_weights(pixels: DataFrame) -> DataFrame:
    """The output pixels that each source pixel has a bilinear weight in, with the weight ``w``.

    ``pixels`` carries ``geo``. A source pixel is a tent of one pixel's width to each side; turned, it
    reaches less than 1.42 output pixels in x and y, so it proposes nine and keeps those inside its tent
    (four, on average). The weights in an output pixel away from the border add up to 1.
    """
    keep = [c for c in pixels.columns if c not in ("x", "y")]
    sent = _with(pixels, sx="x", sy="y").drop("x", "y")
    sent = _with(
        sent, qx=f"cast(ceil({_CENTRE_X} - {_SPAN}) as int)", qy=f"cast(ceil({_CENTRE_Y} - {_SPAN}) as int)",
        n="explode(sequence(0, 8))",
    )
    sent = _with(sent, x="qx + n % 3", y="qy + n div 3").withColumn("y", F.col("y").cast("int"))
    tent = lambda back, at: f"greatest(0D, 1D - abs({back} - 0.5D - {at}))"
    sent = _with(sent, w=f"{tent(_BACK_X, 'sx')} * {tent(_BACK_Y, 'sy')}")
    inside = f"w > 0D AND x BETWEEN 0 AND geo.ow - 1 AND y BETWEEN 0 AND geo.oh - 1 AND {_COVERED}"
    return sent.filter(inside).select(*keep, "x", "y", "w")


def rotate_smooth(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """Turn and flip every photo; angles that are no quarter turns are resampled bilinearly.

    Returns ``image_id, x, y, r, g, b, a, width, height``. Source pixels scatter their bytes with exact
    weights and each output pixel sums them up, map-side first: no pixel is joined with another one. An
    output pixel is covered if its centre lies on a source pixel, as in ``rotate_flip``; there the sum is divided
    by the weight of the bytes that are there, so the border keeps its brightness and a missing byte takes
    no part. Others are transparent black. Quarter turns move bytes without a sum.
    """
    small, out = has_few_rows(dims), ["image_id", "x", "y", "r", "g", "b", "a", "width", "height"]
    source = pixels.select("image_id", "x", "y", "r", "g", "b", "a")
    frames = dims.select("image_id", "geo")
    free = frames.filter("geo.quarter < 0")
    whole = turn_quarters(join_per_image(source, frames.filter("geo.quarter >= 0"), small))
    spread_out = scatter_weights(join_per_image(source, free, small))
    byte = lambda c: F.expr(
        f"cast(floor(round(try_divide(sum(w * {c}), sum(CASE WHEN {c} IS NOT NULL THEN w END)), 6) + 0.5D) as int)"
    ).alias(c)
    summed = spread_out.groupBy("image_id", "x", "y").agg(
        *[byte(c) for c in "rgba"], F.max("geo.ow").alias("width"), F.max("geo.oh").alias("height")
    )
    blank = _with(_uncovered(free), width="geo.ow", height="geo.oh")
    return whole.select(*out).unionByName(summed.select(*out)).unionByName(blank.select(*out))


def rotate_flip(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """Turn and flip every photo by its recipe; ``dims`` holds ``frame_geometry`` per image."""
    return turn_any(join_per_image(pixels, dims, has_few_rows(dims)), dims.filter("geo.quarter < 0"))


def full_grid(dims: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """All (x, y) of each frame; rows are spread before columns so no frame sits in one task."""
    rows = dims.withColumn("y", F.explode(F.sequence(F.lit(0), F.col(height) - 1)))
    return spread(rows, "image_id", "y").withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.col(width) - 1))
    )


def preview_size(images: DataFrame, max_edge: int = S.PREVIEW_EDGE) -> DataFrame:
    """Add ``out_width`` / ``out_height`` of a preview whose longest edge is ``max_edge``."""
    w, h = F.col("width"), F.col("height")
    scale = F.least(F.lit(1.0), F.lit(float(max_edge)) / F.greatest(w, h))
    return images.withColumns(
        {
            "out_width": F.greatest(F.lit(1), half_up(w * scale)),
            "out_height": F.greatest(F.lit(1), half_up(h * scale)),
        }
    )


def preview(pixels: DataFrame, images: DataFrame, max_edge: int = S.PREVIEW_EDGE) -> DataFrame:
    """Box-filtered preview; averages are exact integer sums rounded half up.

    Photos that already fit pass through; only the others are summed, map-side first.
    """
    dims = preview_size(images, max_edge).select(
        "image_id", "width", "height", "out_width", "out_height"
    )
    shrink = "out_width <> width OR out_height <> height"
    need = dims.agg(
        F.count("*").alias("n"), F.max(F.expr(shrink)).alias("some"), F.max(F.expr(f"NOT ({shrink})")).alias("rest")
    ).first()
    small = need["n"] <= BROADCAST_ROWS
    cell = lambda pos, size, extent: F.expr(
        f"cast((cast({pos} as bigint) * {size}) div {extent} as int)"
    )
    out = []
    if need["rest"] or not need["some"]:
        fits = join_per_image(pixels, dims.filter(f"NOT ({shrink})").select("image_id"), small)
        out.append(fits.select("image_id", "x", "y", "r", "g", "b", "a"))
    if need["some"]:
        large = join_per_image(pixels, dims.filter(shrink), small)
        out.append(
            large.select(
                "image_id",
                cell("x", "out_width", "width").alias("x"),
                cell("y", "out_height", "height").alias("y"),
                "r", "g", "b", "a",
            )
            .groupBy("image_id", "x", "y")
            .agg(*[_mean_byte(c) for c in "rgba"])
        )
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _mean_byte(c):
    return F.expr(f"cast(floor(sum({c}) / count({c}) + 0.5D) as int)").alias(c)


def pyramid(pixels: DataFrame, levels: int = 3) -> DataFrame:
    """Full size, 1/2, 1/4, ...: exact means of the full-size pixels at every level.

    Level 0 passes through. Each further level adds up the sums and counts of the one below, a
    quarter of its rows, so the pixels themselves are shuffled once.
    """
    out = pixels.select("image_id", F.lit(0).alias("level"), "x", "y", *"rgba")
    sums = pixels.select(
        "image_id", "x", "y", *[F.col(c).cast("long").alias(c) for c in "rgba"],
        *[F.expr(f"cast({c} IS NOT NULL as long)").alias(f"n{c}") for c in "rgba"],
    )
    for level in range(1, levels + 1):
        sums = sums.groupBy("image_id", F.expr("shiftright(x, 1)").alias("x"), F.expr("shiftright(y, 1)").alias("y")).agg(
            *[F.sum(c).alias(c) for c in ("r", "g", "b", "a", "nr", "ng", "nb", "na")]
        )
        means = [F.expr(f"cast(floor({c} / nullif(n{c}, 0) + 0.5D) as int)").alias(c) for c in "rgba"]
        out = out.unionByName(sums.select("image_id", F.lit(level).alias("level"), "x", "y", *means))
    return out
