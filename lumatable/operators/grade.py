"""Bulk grading: pixels joined with recipes, rendered stage by stage.

The stages are DataFrame -> DataFrame functions over the joined table. Each adds or replaces
columns in one ``withColumns`` call, so shared values are computed once and the row stages run
without a shuffle; only the 3x3 stage exchanges data, by (image, tile).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import schema as S
from ..functions.color import byte_to_linear_sql, linear_to_srgb_sql
from ..functions.recipe import INLINE_KNOTS, default_curve, default_mask, render_constants
from .geometry import frame_geometry, preview, preview_size, turn_any, turn_quarters
from ..plans.joins import has_few_rows, join_large, join_per_image
from .tiles import TILE, tile_with_halo

CHANNELS = ("r", "g", "b")
LINEAR = ("lr", "lg", "lb")


def repeated_recipes(recipes: DataFrame) -> DataFrame:
    """``image_id, n`` of photos with more than one recipe; rendering takes one of them."""
    return recipes.groupBy("image_id").agg(F.count("*").alias("n")).filter("n > 1")


def one_recipe_each(recipes: DataFrame) -> DataFrame:
    """One row per photo: the greatest ``version`` where there is such a column, then the greatest values.

    A photo with two recipe rows would otherwise be rendered twice over.
    """
    order = [c for c in ("version", *[k for k in S.KEYS], "mask") if c in recipes.columns]
    row = F.struct(*recipes.columns)
    if not order:
        return recipes.dropDuplicates(["image_id"])
    return recipes.groupBy("image_id").agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def complete_recipes(images: DataFrame, recipes: DataFrame) -> DataFrame:
    """One full recipe per image: missing recipes and missing columns get neutral values.

    Of several recipes of a photo ``one_recipe_each`` picks one, ``repeated_recipes`` reports them.
    """
    recipes = one_recipe_each(recipes)
    present = set(recipes.columns)
    wanted = recipes.select(
        "image_id",
        *[
            (F.col(k).cast("double") if k in present else F.lit(v)).alias(k)
            for k, v in S.ADJUSTMENT_DEFAULTS.items()
        ],
        (F.col("curve") if "curve" in present else default_curve()).alias("curve"),
        (F.col("mask") if "mask" in present else default_mask()).alias("mask"),
        F.lit(True).alias("_has"),
    )
    joined = join_large(images.select("image_id", "width", "height"), wanted, "image_id", "left")
    return joined.select(
        "image_id",
        "width",
        "height",
        *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in S.ADJUSTMENT_DEFAULTS.items()],
        F.when(F.col("_has"), F.col("curve")).otherwise(default_curve()).alias("curve"),
        F.when(F.col("_has"), F.col("mask")).otherwise(default_mask()).alias("mask"),
    )


def render_table(images: DataFrame, recipes: DataFrame) -> DataFrame:
    """Frame size, constants ``k`` and geometry ``geo``: one row per image."""
    dims = frame_geometry(render_constants(complete_recipes(images, recipes)))
    return settled(dims, ["image_id"], ["width", "height", "kg", "kt", "kc", "k", "geo"])


def settled(df: DataFrame, keys, values) -> DataFrame:
    """``df`` with ``values`` whose expressions the optimizer no longer sees.

    The one-element explode hides how they were computed. Without it the optimizer rewrites every
    filter on them (on ``k`` or ``geo``, on the bytes of a graded pixel) into the full expressions
    of all stages, and planning takes minutes.
    """
    return df.selectExpr(*keys, f"inline(array(struct({', '.join(values)})))")


def attach_recipe(pixels: DataFrame, images: DataFrame, recipes: DataFrame) -> DataFrame:
    """Join each pixel to the constants of its photo (neutral ones where there is no recipe)."""
    return join_per_image(pixels, render_table(images, recipes), has_few_rows(images))


# --- row stages -------------------------------------------------------------


def _with(px: DataFrame, **exprs: str) -> DataFrame:
    return px.withColumns({name: F.expr(e) for name, e in exprs.items()})


def _each(px: DataFrame, template: str, **values) -> DataFrame:
    """Apply one expression template to the three linear channels."""
    return _with(px, **{l: template.format(v=l, c=c) for l, c in zip(LINEAR, CHANNELS)})


def _clamp01(v: str) -> str:
    return f"least(1D, greatest(0D, {v}))"


def _smooth(t: str) -> str:
    return f"{t} * {t} * (3D - 2D * {t})"


def normalized_coordinates(px: DataFrame) -> DataFrame:
    return _with(px, nx="x / greatest(1, width - 1)", ny="y / greatest(1, height - 1)")


def mask_and_edge_distance(px: DataFrame) -> DataFrame:
    """Position across the feather of the elliptic mask (0..1) and distance to the centre."""
    u = "((nx - kg.mask_x) * kg.mask_cos - (ny - kg.mask_y) * kg.mask_sin) / kg.mask_rx"
    v = "((nx - kg.mask_x) * kg.mask_sin + (ny - kg.mask_y) * kg.mask_cos) / kg.mask_ry"
    return _with(
        px,
        feather=f"CASE WHEN kg.mask_gain = 0D THEN 0D ELSE {_clamp01(f'(hypot({u}, {v}) - 1D) / kg.mask_span')} END",
        edge="least(1D, sqrt((nx - 0.5D) * (nx - 0.5D) + (ny - 0.5D) * (ny - 0.5D)) / 0.707D)",
    ).drop("nx", "ny")


def local_gain(px: DataFrame) -> DataFrame:
    """Exposure, exposure inside the mask, edge brightness and vignette as one factor."""
    return _with(
        px,
        gain=f"kg.gain * (1D + kg.mask_gain * (1D - {_smooth('feather')})) "
        "* (1D + kg.lens * edge * edge * 0.65D - kg.vignette * edge * edge * 0.78D)",
    ).drop("feather", "edge")


def linear_light(px: DataFrame) -> DataFrame:
    """Linear RGB times gain and white balance."""
    return _with(
        px,
        **{l: f"{byte_to_linear_sql(c)} * (gain * kg.wb_{c})" for l, c in zip(LINEAR, CHANNELS)},
    ).drop("gain", "kg")


def tone_regions(px: DataFrame) -> DataFrame:
    """Shadows, highlights, whites, blacks, weighted by the luminance before all four."""
    px = _with(px, lum="0.2627D * lr + 0.678D * lg + 0.0593D * lb")
    px = _with(
        px,
        lum1=_clamp01("lum"),
        t_white=_clamp01("(lum - 0.55D) / (1D - 0.55D)"),
        t_black=_clamp01("lum / 0.42D"),
    )
    px = _with(
        px,
        w_shadows="(1D - lum1) * (1D - lum1)",
        w_highlights="lum1 * lum1",
        w_whites=_smooth("t_white"),
        w_blacks=f"1D - {_smooth('t_black')}",
    )
    for region, strength in (
        ("shadows", "0.72D"), ("highlights", "0.72D"), ("whites", "0.62D"), ("blacks", "0.62D"),
    ):
        px = _each(
            px,
            f"CASE WHEN kt.{region} >= 0D THEN {{v}} + (1D - {{v}}) * kt.{region} * w_{region} * {strength} "
            f"ELSE {{v}} * (1D + kt.{region} * w_{region} * {strength}) END",
        )
    return px.drop(
        "lum", "t_white", "t_black", "w_shadows", "w_highlights", "w_whites", "w_blacks"
    )


def contrast_clarity(px: DataFrame) -> DataFrame:
    """Contrast about middle grey, more of it in the midtones for clarity; clamped to 0..1."""
    slope = "(kt.contrast * (1D + kt.clarity * greatest(0D, 1D - abs(lum1 - 0.5D) * 2D) * 0.65D))"
    return _each(px, _clamp01(f"0.18D + ({{v}} - 0.18D) * {slope}")).drop("lum1", "kt")


def encode(px: DataFrame) -> DataFrame:
    return _each(px, linear_to_srgb_sql("{v}", "{c}"))


def tone_curve(px: DataFrame) -> DataFrame:
    """Piecewise-linear curve on encoded values, the same for all channels.

    The segment is the number of right ends below the value: counted inline for short curves,
    by position in the sorted list of ends for long ones. Both stay in generated code.
    """
    count = " + ".join(
        f"CASE WHEN {{v}} > kc.knot{i} THEN 1 ELSE 0 END" for i in range(1, INLINE_KNOTS)
    )
    search = "cast(array_position(sort_array(array_append(kc.knots, {v})), {v}) as int) - 1"
    px = _with(
        px,
        **{
            f"seg_{c}": (
                f"CASE WHEN kc.curve = 0 THEN 0 WHEN kc.curve = 1 THEN {count} ELSE {search} END"
            ).format(v=l)
            for l, c in zip(LINEAR, CHANNELS)
        },
    )
    return _each(
        px,
        "CASE WHEN kc.curve = 0 THEN {v} WHEN {v} <= kc.curve_x THEN kc.curve_y "
        "WHEN {v} > kc.curve_end_x THEN kc.curve_end_y "
        "ELSE kc.seg_y0[seg_{c}] + kc.seg_dy[seg_{c}] * (({v} - kc.seg_x0[seg_{c}]) / kc.seg_dx[seg_{c}]) END",
    ).drop("seg_r", "seg_g", "seg_b", "kc")


def vibrance_saturation(px: DataFrame) -> DataFrame:
    px = _with(
        px,
        luma="0.2126D * lr + 0.7152D * lg + 0.0722D * lb",
        sat="greatest(0D, k.saturation * (1D + k.vibrance * "
        "(1D - (greatest(lr, lg, lb) - least(lr, lg, lb))) * 0.8D))",
    )
    return _each(px, "luma + ({v} - luma) * sat").drop("luma", "sat")


def quantize(px: DataFrame) -> DataFrame:
    """Back to bytes; photos with a neutral recipe keep their input bytes untouched.

    A pixel with a missing byte has no colour: all three of its channels come out null.
    """
    return _with(
        px,
        **{
            c: f"CASE WHEN hole THEN NULL WHEN k.neutral THEN {c} ELSE cast({_clamp01(l)} * 255D + 0.5D as int) END"
            for c, l in zip(CHANNELS, LINEAR)
        },
    ).drop(*LINEAR, "hole")


ROW_STAGES = (
    normalized_coordinates,
    mask_and_edge_distance,
    local_gain,
    linear_light,
    tone_regions,
    contrast_clarity,
    encode,
    tone_curve,
    vibrance_saturation,
    quantize,
)


# what is left of a stage when recipes lack its keys; neutral values give the same numbers to the last bit


def plain_gain(px: DataFrame) -> DataFrame:
    return _with(px, gain="kg.gain")


def plain_contrast(px: DataFrame) -> DataFrame:
    return _each(px, _clamp01("0.18D + ({v} - 0.18D) * kt.contrast")).drop("kt")


def plain_saturation(px: DataFrame) -> DataFrame:
    return _each(_with(px, luma="0.2126D * lr + 0.7152D * lg + 0.0722D * lb"), "luma + ({v} - luma)").drop("luma")


def stages_needed(keys) -> tuple:
    """The row stages for recipes with the columns ``keys``; other keys are neutral for every photo."""
    has = lambda *names: not {*names}.isdisjoint(keys)
    local = (normalized_coordinates, mask_and_edge_distance, local_gain)
    regions, clarity = has("shadows", "highlights", "whites", "blacks"), has("clarity")
    return (
        *(local if has("maskExposure", "vignette", "lensBrightness") else (plain_gain,)),
        linear_light,
        *((tone_regions,) if regions or clarity else ()),
        contrast_clarity if regions or clarity else plain_contrast,
        encode,
        *((tone_curve,) if has("curve") else ()),
        vibrance_saturation if has("vibrance", "saturation") else plain_saturation,
        quantize,
    )


def narrow(dims: DataFrame, stages) -> DataFrame:
    """``render_table`` without the constants that none of ``stages`` reads: they are copied with every pixel."""
    if plain_gain in stages:
        dims = _with(dims, kg="named_struct('gain', kg.gain, 'wb_r', kg.wb_r, 'wb_g', kg.wb_g, 'wb_b', kg.wb_b)")
    if plain_contrast in stages:
        dims = _with(dims, kt="named_struct('contrast', kt.contrast)")
    return dims if tone_curve in stages else dims.drop("kc")


def tone(px: DataFrame, stages=ROW_STAGES) -> DataFrame:
    """Run the row stages on pixels joined with ``width``, ``height`` and the struct ``k``."""
    # non-null inputs keep null checks out of the pixel loop
    px = _with(px, hole="r IS NULL OR g IS NULL OR b IS NULL")
    px = _with(px, **{c: f"coalesce({c}, 0)" for c in ("x", "y", *CHANNELS)})
    for stage in stages:
        px = stage(px)
    return px


# --- neighbourhood stage ----------------------------------------------------


def detail(px: DataFrame, tile_size: int = TILE) -> DataFrame:
    """Noise reduction and sharpening against the 3x3 box mean; the outermost ring stays.

    Reads ``width``, ``height``, ``denoise`` and ``sharpen`` (fractions) next to the bytes. One
    exchange by (image, tile); the horizontal and the vertical pass only re-sort inside it.
    Range frames keep the sums right even where a pixel is missing. A pixel whose neighbourhood
    is not complete keeps its value, and ``grid_gaps`` names its photo.
    """
    tile = ["image_id", "tile_x", "tile_y"]
    tiled = tile_with_halo(px, tile_size, 1).repartition(*tile)
    across = Window.partitionBy(*tile, "y").orderBy("x").rangeBetween(-1, 1)
    down = Window.partitionBy(*tile, "x").orderBy("y").rangeBetween(-1, 1)
    tiled = tiled.withColumns(
        {f"h{c}": F.sum(c).over(across) for c in CHANNELS} | {"hn": F.count("r").over(across)}
    )
    tiled = tiled.withColumns(
        {f"s{c}": F.sum(f"h{c}").over(down) for c in CHANNELS} | {"sn": F.sum("hn").over(down)}
    ).filter("is_interior")
    tiled = _with(
        tiled,
        inner="x BETWEEN 1 AND width - 2 AND y BETWEEN 1 AND height - 2",
        **{f"m{c}": f"s{c} / 9D" for c in CHANNELS},
    )
    tiled = _with(
        tiled,
        **{
            f"d{c}": f"CASE WHEN denoise >= 0D THEN {c} * (1D - denoise * 0.9D) + m{c} * denoise * 0.9D "
            f"ELSE {c} + ({c} - m{c}) * -denoise * 0.9D END"
            for c in CHANNELS
        },
    )
    def sharpened(c):
        e = (
            f"CASE WHEN sharpen >= 0D THEN d{c} + (d{c} - m{c}) * sharpen * 3.2D "
            f"ELSE d{c} * (1D + sharpen) + m{c} * -sharpen END"
        )
        return (
            f"CASE WHEN NOT inner OR sn < 9 THEN {c} "
            f"ELSE cast(floor(least(255D, greatest(0D, {e})) + 0.5D) as int) END"
        )

    return _with(tiled, **{c: sharpened(c) for c in CHANNELS}).select(*px.columns)


def grid_gaps(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Photos whose pixels and image row do not agree, with the reason.

    ``status``: ``no-image-row`` (grading leaves these pixels out), ``no-pixels``, ``incomplete``
    (missing pixels or bytes), ``surplus``. A pixel counts if it has all of its bytes.
    """
    whole = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    counts = pixels.groupBy("image_id").agg(F.count_if(whole).alias("n_pixels"))
    expected = (F.col("width").cast("long") * F.col("height")).alias("n_expected")
    rows = images.select("image_id", expected, F.lit(True).alias("_row"))
    joined = join_large(rows, counts, "image_id", "full")
    status = F.expr(
        "CASE WHEN _row IS NULL THEN 'no-image-row' WHEN n_pixels IS NULL AND coalesce(n_expected, 1) > 0 THEN 'no-pixels' "
        "WHEN coalesce(n_pixels, 0) < n_expected THEN 'incomplete' WHEN n_pixels > n_expected THEN 'surplus' END"
    )
    return joined.select(
        "image_id", "n_expected", F.coalesce("n_pixels", F.lit(0)).alias("n_pixels"), status.alias("status")
    ).filter("status IS NOT NULL")


def steps_needed(recipes: DataFrame) -> dict[str, bool]:
    """Which optional steps any recipe asks for; keys that recipes lack are neutral."""
    asks = {
        "fine": ("noiseReduction", "noiseReduction <> 0D"), "sharp": ("sharpness", "sharpness <> 0D"),
        "free": ("rotation", "pmod(rotation, 90D) <> 0D"), "quarter": ("rotation", "pmod(rotation, 360D) <> 0D"),
        "flip_h": ("flipHorizontal", "flipHorizontal <> 0D"), "flip_v": ("flipVertical", "flipVertical <> 0D"),
    }
    here = {n: e for n, (key, e) in asks.items() if key in recipes.columns}
    found = dict.fromkeys(asks, False)
    if here:
        row = recipes.agg(*[F.max(F.expr(e)).alias(n) for n, e in here.items()]).first()
        found |= {n: bool(row[n]) for n in here}
    return {
        "fine": found["fine"] or found["sharp"], "free": found["free"],
        "turned": found["quarter"] or found["flip_h"] or found["flip_v"],
    }


def grade(
    pixels: DataFrame,
    images: DataFrame,
    recipes: DataFrame,
    max_edge: int | None = None,
    tile_size: int = TILE,
    extra_stages=(),
) -> DataFrame:
    """Render every photo with its recipe.

    Order: optional preview size, rotation and flips, tone stages, detail. One look at the recipes
    tells which steps any photo needs; the others are not planned, nor are stages whose keys recipes lack. Pixels are read once, and a
    second time only if some photos need the 3x3 stage, so that all others pass without a shuffle.
    ``extra_stages`` are DataFrame -> DataFrame functions run on the graded bytes.
    """
    if max_edge is not None:
        pixels = preview(pixels, images, max_edge)
        images = preview_size(images, max_edge).select(
            "image_id", F.col("out_width").alias("width"), F.col("out_height").alias("height")
        )
    stages = stages_needed(recipes.columns)
    dims = narrow(render_table(images, recipes), stages)
    fine = "k.denoise <> 0D OR k.sharpen <> 0D"
    need, small, bytes_ = steps_needed(recipes), has_few_rows(images), S.PIXELS.fieldNames()

    def rendered(some):
        px = join_per_image(pixels, some, small)
        if need["free"]:
            px = turn_any(px, some.filter("geo.quarter < 0"))
        elif need["turned"]:
            px = turn_quarters(px)
        return tone(px, stages)

    if need["fine"]:
        out = rendered(dims.filter(f"NOT ({fine})")).select(*bytes_)
        touched = rendered(dims.filter(fine)).selectExpr(*bytes_, "width", "height", "k.denoise", "k.sharpen")
        out = out.unionByName(detail(touched, tile_size).select(*bytes_))
    else:
        out = rendered(dims).select(*bytes_)
    for stage in extra_stages:
        out = stage(out)
    return out


def compare_renditions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per-image difference of two renditions; frames may differ in size.

    ``mean_abs_diff`` is taken over the three channels of the pixels that both sides have.
    """
    side = lambda df, p: df.select(
        "image_id", "x", "y", *[F.col(c).alias(f"{p}{c}") for c in CHANNELS]
    )
    j = join_large(side(before, "b_"), side(after, "a_"), ["image_id", "x", "y"], "full")
    both = F.col("b_r").isNotNull() & F.col("a_r").isNotNull()
    diffs = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in CHANNELS]
    diff = diffs[0] + diffs[1] + diffs[2]
    return j.groupBy("image_id").agg(
        F.count_if(both).alias("compared"),
        F.count_if(both & (diff > 0)).alias("changed"),
        F.coalesce(F.sum(F.when(both, diff)), F.lit(0)).alias("sum_abs_diff"),
        (F.sum(F.when(both, diff)) / (F.count_if(both) * 3)).alias("mean_abs_diff"),
        F.max(F.when(both, F.greatest(*diffs))).alias("max_abs_diff"),
        F.count_if(~both).alias("unmatched"),
    )


def default_recipes(images: DataFrame) -> DataFrame:
    """The neutral recipe for every image (the "before" side of a comparison)."""
    return images.select(
        "image_id",
        *[F.lit(v).alias(k) for k, v in S.ADJUSTMENT_DEFAULTS.items()],
        default_curve().alias("curve"),
        default_mask().alias("mask"),
    )
