"""Predicates and constants derived from a recipe row (one row per photo)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schema as S
from .numeric import any_of, total


def default_curve() -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("id"), F.lit(x).alias("x"), F.lit(y).alias("y"))
            for i, x, y in S.CURVE_DEFAULT
        ]
    )


def default_mask() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in S.MASK_DEFAULTS.items()])


def has_adjustments() -> Column:
    return any_of(F.col(k) != v for k, v in S.ADJUSTMENT_DEFAULTS.items())


def has_curve_edits(curve: Column) -> Column:
    """Curve differs from the five default points, position by position."""
    off = lambda p, axis, v: F.abs(p[axis] - v) > S.EDIT_TOLERANCE
    moved = any_of(
        off(F.get(curve, i), axis, v)
        for i, (_, x, y) in enumerate(S.CURVE_DEFAULT)
        for axis, v in (("x", x), ("y", y))
    )
    return F.when(F.size(curve) != len(S.CURVE_DEFAULT), True).otherwise(moved)


def curve_moves_pixels(curve: Column) -> Column:
    """Weaker test used by the pixel stages: any point off the diagonal."""
    return F.coalesce(
        F.exists(curve, lambda p: F.abs(p["y"] - p["x"]) > S.EDIT_TOLERANCE), F.lit(False)
    )


def has_mask_edits(mask: Column) -> Column:
    return any_of(F.abs(mask[k] - v) > S.EDIT_TOLERANCE for k, v in S.MASK_DEFAULTS.items())


def is_edited() -> Column:
    return has_adjustments() | has_curve_edits(F.col("curve")) | has_mask_edits(F.col("mask"))


def count_edits() -> Column:
    changed = [(F.col(k) != v).cast("int") for k, v in S.ADJUSTMENT_DEFAULTS.items()]
    return (
        total(changed)
        + has_curve_edits(F.col("curve")).cast("int")
        + has_mask_edits(F.col("mask")).cast("int")
    )


def sort_curve(curve: Column) -> Column:
    """Points by ascending x; equal x keep their given order."""
    tagged = F.transform(
        curve, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p.alias("p"))
    )
    return F.transform(F.array_sort(tagged), lambda t: t["p"])


def curve_is_identity(curve: Column) -> Column:
    """True when looking up any value in [0, 1] gives that value back."""
    on_diagonal = F.forall(curve, lambda p: p["x"] == p["y"])
    spans = F.exists(curve, lambda p: p["x"] <= 0.0) & F.exists(curve, lambda p: p["x"] >= 1.0)
    return curve.isNull() | (F.size(curve) == 0) | (on_diagonal & spans)


# right ends of the first curve segments, compared one by one; longer curves use a sorted search
INLINE_KNOTS = 6

_SEGMENT_ARRAYS = {
    "x0": "transform(slice(pts, 1, size(pts) - 1), p -> p.x)",
    "y0": "transform(slice(pts, 1, size(pts) - 1), p -> p.y)",
    "dy": "zip_with(slice(pts, 1, size(pts) - 1), slice(pts, 2, size(pts) - 1), (p, q) -> q.y - p.y)",
    "dx": "zip_with(slice(pts, 1, size(pts) - 1), slice(pts, 2, size(pts) - 1), "
    "(p, q) -> greatest(1e-4D, q.x - p.x))",
}


# fields read by the first stages, then by the tone stages; the curve fields follow, ``k`` is last
_GAIN_FIELDS = [
    "gain", "wb_r", "wb_g", "wb_b", "vignette", "lens", "mask_gain", "mask_span", "mask_x",
    "mask_y", "mask_cos", "mask_sin", "mask_rx", "mask_ry",
]
_TONE_FIELDS = ["shadows", "highlights", "whites", "blacks", "contrast", "clarity"]
CONSTANTS = ("kg", "kt", "kc", "k")


def render_constants(recipes):
    """Everything that is constant per photo, computed once per recipe row.

    Four structs in order of use, so that each can be dropped from the rows early: ``kg`` gains
    and mask, ``kt`` tone, ``kc`` curve, ``k`` the rest. The per-pixel stages only read these, so trigonometry, powers and curve sorting
    cost one evaluation per photo instead of one per pixel. All fields used in arithmetic are
    non-null, which keeps the generated code of the pixel loop small enough to be compiled.
    """
    mask = {k: f"coalesce(mask.{k}, {v}D)" for k, v in S.MASK_FALLBACK.items()}
    warm = "least(1D, greatest(-1D, (temperature - 6500D) / 4500D))"
    angle = f"(-{mask['rotation']} * pi() / 180D)"
    recipes = recipes.withColumns(
        {
            "pts": F.when(~curve_is_identity(F.col("curve")), sort_curve(F.col("curve"))),
            "neutral": F.coalesce(
                ~has_adjustments() & ~curve_moves_pixels(F.col("curve")), F.lit(False)
            ),
        }
    )
    # sentinel arrays keep the fields non-null where no curve is active
    arrays = {
        name: f"coalesce(CASE WHEN size(pts) > 1 THEN {body} END, array(0D))"
        for name, body in _SEGMENT_ARRAYS.items()
    }
    inf = "double('Infinity')"
    fields = {
        "neutral": "neutral",
        "gain": "pow(2D, exposure)",
        "wb_r": f"1D + {warm} * 0.22D + tint / 100D * 0.08D",
        "wb_g": "1D - tint / 100D * 0.1D",
        "wb_b": f"1D - {warm} * 0.22D + tint / 100D * 0.08D",
        "contrast": "pow(2D, contrast / 55D)",
        "clarity": "clarity / 100D",
        "saturation": "1D + saturation / 100D",
        "vibrance": "vibrance / 100D",
        "shadows": "shadows / 100D",
        "highlights": "highlights / 100D",
        "whites": "whites / 100D",
        "blacks": "blacks / 100D",
        "vignette": "vignette / 100D",
        "lens": "lensBrightness / 100D",
        "mask_gain": "pow(2D, maskExposure) - 1D",
        "mask_span": "1D + greatest(0.02D, maskFeather / 100D * 0.7D) * 2.2D - 1D",
        "mask_x": mask["x"],
        "mask_y": mask["y"],
        "mask_cos": f"cos{angle}",
        "mask_sin": f"sin{angle}",
        "mask_rx": f"greatest(0.02D, {mask['width']} / 2D)",
        "mask_ry": f"greatest(0.02D, {mask['height']} / 2D)",
        # 0: no curve, 1: few points, 2: many points
        "curve": f"CASE WHEN pts IS NULL THEN 0 WHEN size(pts) <= {INLINE_KNOTS + 1} THEN 1 ELSE 2 END",
        "curve_x": f"coalesce(get(pts, 0).x, {inf})",
        "curve_y": "coalesce(get(pts, 0).y, 0D)",
        "curve_end_x": f"coalesce(get(pts, size(pts) - 1).x, {inf})",
        "curve_end_y": "coalesce(get(pts, size(pts) - 1).y, 0D)",
        **{f"knot{i}": f"coalesce(get(pts, {i}).x, {inf})" for i in range(1, INLINE_KNOTS)},
        "knots": "coalesce(transform(slice(pts, 2, greatest(size(pts) - 1, 0)), p -> p.x), array(0D))",
        **{f"seg_{n}": body for n, body in arrays.items()},
        "denoise": "noiseReduction / 100D",
        "sharpen": "sharpness / 100D",
        "rotation": "rotation",
        "flip_h": "flipHorizontal <> 0D",
        "flip_v": "flipVertical <> 0D",
    }
    def packed(name, wanted):
        body = ", ".join(f"'{n}', {fields[n]}" for n in wanted)
        return f"named_struct({body}) AS {name}"

    groups = {"kg": _GAIN_FIELDS, "kt": _TONE_FIELDS}
    groups["kc"] = [n for n in fields if n.startswith(("curve", "knot", "seg_"))]
    groups["k"] = [n for n in fields if not any(n in g for g in groups.values())]
    return recipes.selectExpr(
        "image_id", "width", "height", *[packed(n, wanted) for n, wanted in groups.items()]
    )
