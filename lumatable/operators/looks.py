"""Looks, style mixing and reference matching on parameter tables.

Recipes are handled in long form (photo, param, value); each rule is an aggregate or an
equi-join over small rows, never over pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions.numeric import total
from ..functions.recipe import sort_curve
from ..plans.joins import join_large
from ..plans.session import cut_lineage
from .stats import HUE_BANDS

# How a parameter is interpolated; everything not listed is additive.
PARAM_KINDS = {
    "temperature": "gain",
    "rotation": "hue",
    "flipHorizontal": "category",
    "flipVertical": "category",
}
# Left alone by mixing and matching unless asked for: exposure and white balance, geometry,
# mask and lens parameters.
PROTECTED = [
    "exposure", "temperature", "tint", "rotation", "flipHorizontal", "flipVertical",
    "maskExposure", "maskFeather", "vignette", "lensBrightness",
]


def long_recipes(recipes: DataFrame, keys=None) -> DataFrame:
    """(image_id, param, value) rows of the scalar keys."""
    keys = keys or [k for k in S.KEYS if k in recipes.columns]
    return recipes.unpivot(["image_id"], keys, "param", "value")



def apply_look(axes: DataFrame, basis: DataFrame, base: DataFrame, protected=PROTECTED) -> DataFrame:
    """Parameters of a look: base + sum over terms of basis weight x axis value.

    ``axes``: image_id, term, phi (single axes and chosen cross terms); ``basis``: term, param,
    weight; ``base``: image_id, param, value. Protected parameters keep their base value.
    """
    open_basis = basis.filter(~F.col("param").isin(list(protected)))
    shift = (
        axes.join(open_basis, "term")
        .groupBy("image_id", "param")
        .agg(F.sum(F.col("phi") * F.col("weight")).alias("_d"))
    )
    return base.join(shift, ["image_id", "param"], "left").select(
        "image_id", "param", (F.col("value") + F.coalesce("_d", F.lit(0.0))).alias("value")
    )


def cross_terms(axes: DataFrame, pairs) -> DataFrame:
    """Add products of two axes as further terms; ``axes`` has one column per axis."""
    names = [c for c in axes.columns if c != "image_id"]
    terms = [(n, F.col(n)) for n in names] + [(f"{a}*{b}", F.col(a) * F.col(b)) for a, b in pairs]
    rows = F.array(*[F.struct(F.lit(n).alias("term"), v.cast("double").alias("phi")) for n, v in terms])
    return axes.select("image_id", F.explode(rows).alias("t")).select("image_id", "t.term", "t.phi")


def _kind() -> Column:
    pairs = [F.lit(v) for item in PARAM_KINDS.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("param")), F.lit("additive"))


def mix_styles(styles: DataFrame, protected=PROTECTED) -> DataFrame:
    """Weighted mix of recipes per photo, each parameter by its kind.

    ``styles``: image_id, style, weight, param, value. Additive values mix linearly, gains in the
    log domain, hues (degrees) on the circle, and categories follow the heaviest style. Styles
    without a value (for gains, a positive one) or without a weight don't weigh in; where no weight is
    left the value is null. Curves are mixed by ``mix_curves``.
    """
    w, v = F.col("weight"), F.col("value")
    rad = v * (math.pi / 180.0)
    rows = styles.filter(~F.col("param").isin(list(protected))).withColumn("kind", _kind())
    over = lambda e, ok: F.try_divide(F.sum(F.when(ok, e)), F.sum(F.when(ok, w)))
    log = F.when(v > 0, F.ln(v))
    counts = v.isNotNull() & w.isNotNull()
    return rows.groupBy("image_id", "param").agg(
        F.when(F.first("kind") == "gain", F.exp(over(w * log, v > 0)))
        .when(
            F.first("kind") == "hue",
            F.when(F.max(counts & (w != 0)), F.atan2(F.sum(w * F.sin(rad)), F.sum(w * F.cos(rad))) * (180.0 / math.pi)),
        )
        # on equal weight the first style by name wins
        .when(F.first("kind") == "category", F.min_by(v, F.when(counts & (w != 0), F.struct(-w, F.col("style")))))
        .otherwise(over(w * v, v.isNotNull()))
        .alias("value")
    )


# --- curves -----------------------------------------------------------------

CURVE_SAMPLES = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not once per mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sample_curve(curve: Column, n: int = CURVE_SAMPLES) -> Column:
    """Values of a piecewise-linear curve at ``n`` even places; an empty or null one is the diagonal."""

    def between(lo, hi, x):
        run = F.greatest(F.lit(1e-4), hi["x"] - lo["x"])
        inside = lo["y"] + (hi["y"] - lo["y"]) * ((x - lo["x"]) / run)
        return F.coalesce(inside, hi["y"], lo["y"], x)

    def at(points, x):
        first_right = lambda left: between(F.get(points, left - 1), F.get(points, left), x)
        return _let(F.size(F.filter(points, lambda p: p["x"] < x)), first_right)

    places = F.array(*[F.lit(i / (n - 1)) for i in range(n)])
    return _let(F.coalesce(sort_curve(curve), F.array()), lambda points: F.transform(places, lambda x: at(points, x)))


def monotone(values: Column) -> Column:
    """Running maximum of a short array."""
    rise = lambda acc, v: F.concat(acc, F.array(F.greatest(v, F.try_element_at(acc, F.lit(-1)))))
    return F.aggregate(values, F.array().cast("array<double>"), rise)


def curve_of_samples(values: Column) -> Column:
    """Curve points from values at even places; the ends keep their names."""

    def point(v, i, last):
        name = F.when(i == 0, "black").when(i == last, "white").otherwise(F.concat(F.lit("s"), i.cast("string")))
        return F.struct(name.alias("id"), (i.cast("double") / last).alias("x"), v.alias("y"))

    return _let(values, lambda ys: F.transform(ys, lambda v, i: point(v, i, F.size(ys) - 1)))


def mix_curves(styles: DataFrame, n: int = CURVE_SAMPLES) -> DataFrame:
    """Weighted mix of curves per photo, sampled and made monotone.

    ``styles``: image_id, weight, curve. Gives image_id, curve; photos whose weights add up to 0 get
    the diagonal.
    """
    rows = styles.select("image_id", "weight", F.posexplode(sample_curve(F.col("curve"), n)).alias("pos", "y"))
    mixed = monotone_curve(rows).withColumn("y", F.coalesce("y", F.col("pos") / float(n - 1)))
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda p: p["y"])
    return mixed.groupBy("image_id").agg(curve_of_samples(values).alias("curve"))


def monotone_curve(samples: DataFrame) -> DataFrame:
    """Blend sampled curves and make the result monotone.

    ``samples``: image_id, pos (0..127), weight, y. A curve has 64 or 128 samples, which bounds
    the running maximum.
    """
    blended = samples.groupBy("image_id", "pos").agg(
        F.try_divide(F.sum(F.col("weight") * F.col("y")), F.sum("weight")).alias("y")
    )
    up = Window.partitionBy("image_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return blended.select("image_id", "pos", F.max("y").over(up).alias("y"))


def sync_recipes(recipes: DataFrame, targets: DataFrame) -> DataFrame:
    """Copy chosen keys from a source photo to the other photos of its group.

    ``targets``: image_id, source_id, keys ARRAY<STRING>. Photos without a row stay as they are.
    """
    src = recipes.select(
        F.col("image_id").alias("source_id"), *[F.col(k).alias(f"_src_{k}") for k in S.KEYS]
    )
    # only sources that are used travel; a popular source repeats on the target side, where AQE splits it
    picked = targets.join(src, "source_id")
    j = recipes.join(picked, "image_id", "left")
    take = lambda k: F.when(F.array_contains("keys", k), F.col(f"_src_{k}")).otherwise(F.col(k))
    return j.select(
        "image_id",
        *[F.coalesce(take(k), F.col(k)).alias(k) for k in S.KEYS],
        *[c for c in ("curve", "mask") if c in recipes.columns],
    )


# The part of the renderer that a parameter belongs to, for reports.
SUBSYSTEMS = {
    "white_balance": ["temperature", "tint"],
    "color": ["vibrance", "saturation"],
    "detail": ["sharpness", "noiseReduction"],
    "geometry": ["rotation", "flipHorizontal", "flipVertical"],
    "local": ["maskExposure", "maskFeather", "vignette", "lensBrightness"],
}


def subsystem(param: Column) -> Column:
    pairs = [F.lit(v) for name, keys in SUBSYSTEMS.items() for k in keys for v in (k, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), param), F.lit("tone"))


def explain_changes(before: DataFrame, after: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """Changed parameters with their difference, its share of the range and their subsystem.

    ``confidence`` (image_id, subsystem, confidence), where given, says how sure the step was that
    proposed the change; parameters of other subsystems have none.
    """
    b = long_recipes(before).withColumnRenamed("value", "old_value")
    a = long_recipes(after).withColumnRenamed("value", "new_value")
    j = b.join(a, ["image_id", "param"]).withColumn("delta", F.col("new_value") - F.col("old_value"))
    ranges = F.create_map(
        *[F.lit(v) for k, (lo, hi) in S.ADJUSTMENT_RANGES.items() for v in (k, hi - lo)]
    )
    share = F.abs(F.col("delta")) / F.element_at(ranges, F.col("param"))
    out = j.filter(F.col("delta") != 0).withColumns({"share": share, "subsystem": subsystem(F.col("param"))})
    if confidence is None:
        return out.withColumn("confidence", F.lit(None).cast("double"))
    return out.join(confidence.select("image_id", "subsystem", "confidence"), ["image_id", "subsystem"], "left")


# --- reference match --------------------------------------------------------

FEATURE_EDGE = 1024
MATCH_MODES = ("tone", "color", "full")
CURVE_KNOTS = (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))
SLOPE_LIMITS = (0.25, 4.0)
MIN_CONFIDENCE = 0.05
# Share of all band mass that both photos need in a hue band before it is matched, and the limits
# of what a band may change.
BAND_SUPPORT, BAND_TURN, BAND_GAIN = 0.04, 30.0, 0.5
ZONES = ("shadow", "mid", "high")
GRADE_LIMIT = 0.08


def match_reference(pairs: DataFrame, features: DataFrame, mode: str = "full") -> DataFrame:
    """Closed-form look transfer from image features; no pixel of the pair is compared.

    ``pairs``: target_id, ref_id. Steps: exposure from the middle quantiles, white balance from
    the neutral centres (only if both are confident), a monotone curve through sparse quantiles
    with slope limits, hue bands (``bands``: turn in degrees and chroma gain, only where both photos
    have enough mass), grading (``grading``: a/b offset of shadows, midtones and highlights) and
    chroma from the density slopes. Geometry, lens and masks are never touched. Bands and grading
    are null where the features lack those columns.
    """
    if mode not in MATCH_MODES:
        raise ValueError(f"unknown mode {mode!r}; choose one of {', '.join(MATCH_MODES)}")
    cols = [c for c in features.columns if c != "image_id"]
    side = lambda p: features.select(
        F.col("image_id").alias("target_id" if p == "t" else "ref_id"),
        *[F.col(c).alias(f"{p}_{c}") for c in cols],
    )
    j = join_large(join_large(pairs, side("t"), "target_id"), side("r"), "ref_id")
    linear = lambda c: F.pow(F.greatest(F.col(c), F.lit(1.0)) / 255.0, F.lit(2.2))
    mid = lambda p: (linear(f"{p}_p25") + linear(f"{p}_p50") + linear(f"{p}_p75")) / 3.0
    exposure = F.least(F.lit(5.0), F.greatest(F.lit(-5.0), F.log2(mid("r") / mid("t"))))
    out = {"exposure": exposure if mode != "color" else F.lit(0.0)}

    sure = (F.col("t_neutral_confidence") >= MIN_CONFIDENCE) & (
        F.col("r_neutral_confidence") >= MIN_CONFIDENCE
    )
    move = lambda axis, gain: F.when(
        sure, F.coalesce((F.col(f"r_neutral_{axis}") - F.col(f"t_neutral_{axis}")) * gain, F.lit(0.0))
    ).otherwise(0.0)
    color = mode != "tone"
    bounded = lambda v, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), v))
    out["temperature"] = bounded(move("b", 30000.0) + 6500.0, 2000.0, 12000.0) if color else F.lit(6500.0)
    out["tint"] = bounded(move("a", 1000.0), -100.0, 100.0) if color else F.lit(0.0)
    j = j.withColumns(out)

    # target quantile -> reference quantile, with each slope kept inside its limits
    if mode != "color":
        gain = F.pow(F.lit(2.0), F.col("exposure") / 2.2)
        x = lambda n: F.least(F.lit(1.0), F.col(f"t_{n}") / 255.0 * gain)
        px, py = F.lit(0.0), F.lit(0.0)
        for i, (n, _) in enumerate(CURVE_KNOTS):
            j = j.withColumn(f"_x{i}", x(n))
            dx = F.col(f"_x{i}") - px
            dy = F.col(f"r_{n}") / 255.0 - py
            lo, hi = SLOPE_LIMITS
            j = j.withColumn(
                f"_y{i}", F.least(F.lit(1.0), py + F.least(dx * hi, F.greatest(dx * lo, dy)))
            )
            px, py = F.col(f"_x{i}"), F.col(f"_y{i}")
        points = [(F.lit(f"q{i}"), F.col(f"_x{i}"), F.col(f"_y{i}")) for i in range(len(CURVE_KNOTS))]
        points = [(F.lit("black"), F.lit(0.0), F.lit(0.0)), *points, (F.lit("white"), F.lit(1.0), F.lit(1.0))]
        curve = F.array(*[F.struct(i.alias("id"), a.alias("x"), b.alias("y")) for i, a, b in points])
    else:
        from ..functions.recipe import default_curve

        curve = default_curve()
    sat = F.try_divide(F.col("r_density_slope"), F.col("t_density_slope")) - 1.0
    saturation = (
        bounded(F.coalesce(sat, F.lit(0.0)) * 25.0, -50.0, 50.0) if mode == "full" else F.lit(0.0)
    )
    bands, grading = F.lit(None), F.lit(None)
    if color and f"{next(iter(HUE_BANDS))}_mass" in features.columns:
        whole = {p: total([F.coalesce(f"{p}_{n}_mass", F.lit(0.0)) for n in HUE_BANDS]) for p in "tr"}
        share = lambda p, n: F.coalesce(F.try_divide(F.col(f"{p}_{n}_mass"), whole[p]), F.lit(0.0))
        rows = []
        for n in HUE_BANDS:
            held = F.least(share("t", n), share("r", n))
            turn = F.pmod(F.col(f"r_{n}_hue") - F.col(f"t_{n}_hue") + 180.0, F.lit(360.0)) - 180.0
            gain = F.try_divide(F.col(f"r_{n}_chroma"), F.col(f"t_{n}_chroma")) - 1.0
            rows.append(F.when(held >= BAND_SUPPORT, F.struct(
                F.lit(n).alias("band"), bounded(turn, -BAND_TURN, BAND_TURN).alias("turn"),
                bounded(gain, -BAND_GAIN, BAND_GAIN).alias("gain"), held.alias("support"),
            )))
        bands = F.array_compact(F.array(*rows))
    if mode == "full" and "shadow_a" in features.columns:
        offset = lambda z, axis: bounded(
            F.coalesce(F.col(f"r_{z}_{axis}") - F.col(f"t_{z}_{axis}"), F.lit(0.0)), -GRADE_LIMIT, GRADE_LIMIT
        )
        grading = F.array(*[
            F.struct(F.lit(z).alias("zone"), offset(z, "a").alias("a"), offset(z, "b").alias("b")) for z in ZONES
        ])
    confidence = F.least(F.col("t_neutral_confidence"), F.col("r_neutral_confidence"))
    return j.select(
        "target_id", "ref_id", "exposure", "temperature", "tint",
        saturation.alias("saturation"), curve.alias("curve"), confidence.alias("wb_confidence"),
        bands.cast("array<struct<band:string,turn:double,gain:double,support:double>>").alias("bands"),
        grading.cast("array<struct<zone:string,a:double,b:double>>").alias("grading"),
    )


def refine_exposure(matches: DataFrame, features: DataFrame, steps: int = 5, width: float = 0.5) -> DataFrame:
    """Bounded search around the closed-form exposure.

    Candidates are exploded from a fixed grid inside each row and the smallest loss is kept, so a
    pair contributes ``2 * steps + 1`` rows.
    """
    q = features.select("image_id", "p25", "p50", "p75")
    side = lambda p, key: q.select(
        F.col("image_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("p25", "p50", "p75")]
    )
    grid = F.array(*[F.lit(i * width / steps) for i in range(-steps, steps + 1)])
    j = join_large(join_large(matches, side("t", "target_id"), "target_id"), side("r", "ref_id"), "ref_id")
    j = j.withColumn("_c", F.explode(grid)).withColumn(
        "_e", F.least(F.lit(5.0), F.greatest(F.lit(-5.0), F.col("exposure") + F.col("_c")))
    )
    loss = F.lit(0.0)
    for c in ("p25", "p50", "p75"):
        moved = F.least(F.lit(255.0), F.col(f"t_{c}") * F.pow(F.lit(2.0), F.col("_e") / 2.2))
        loss = loss + F.abs(moved - F.col(f"r_{c}"))
    loss = loss + F.abs(F.col("_c")) * 0.01
    best = (
        j.groupBy("target_id", "ref_id")
        .agg(F.min_by("_e", F.struct(loss, "_e")).alias("refined_exposure"), F.min(loss).alias("loss"))
    )
    return join_large(matches, best, ["target_id", "ref_id"])


def match_strength(original: DataFrame, matched: DataFrame, strength: float) -> DataFrame:
    """Move from the original to the matched recipe by 0..100 %, each parameter by its kind.

    The columns are the photo's id and the original's keys, curve and mask, at any strength. Curves
    are sampled, mixed and made monotone; the mask stays. Strength 0 and photos without a match
    return the original values exactly.
    """
    t = strength / 100.0
    named = [k for k in S.KEYS if k in original.columns]
    extra = [c for c in ("curve", "mask") if c in original.columns]
    if t == 0:
        return original.select("image_id", *named, *extra)
    keys = [k for k in named if k in matched.columns]
    curved = "curve" in extra and "curve" in matched.columns
    m = matched.select(
        "image_id", *[F.col(k).alias(f"_m_{k}") for k in keys], *([F.col("curve").alias("_m_curve")] if curved else [])
    )
    j = join_large(original, m, "image_id", "left")

    def moved(k):
        a, b = F.col(k), F.col(f"_m_{k}")
        kind = PARAM_KINDS.get(k, "additive")
        if kind == "gain":
            v = F.when((a > 0) & (b > 0), F.exp(F.ln(a) * (1 - t) + F.ln(b) * t))
        elif kind == "hue":
            v = a + (F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0) * t
        elif kind == "category":
            v = b if t > 0.5 else a
        else:
            v = a * (1 - t) + b * t
        return F.coalesce(v, a).alias(k)

    out = {c: F.col(c) for c in extra}
    if curved:
        mixed = F.zip_with(
            sample_curve(F.col("curve")), sample_curve(F.col("_m_curve")), lambda a, b: a * (1 - t) + b * t
        )
        out["curve"] = F.when(F.col("_m_curve").isNull(), F.col("curve")).otherwise(curve_of_samples(monotone(mixed)))
    return j.select(
        "image_id", *[moved(k) if k in keys else F.col(k) for k in named], *[v.alias(c) for c, v in out.items()]
    )


# features that a matched key is formed from
KEY_FEATURES = {
    "exposure": ("p25", "p50", "p75"), "temperature": ("neutral_b", "neutral_confidence"),
    "tint": ("neutral_a", "neutral_confidence"), "saturation": ("density_slope",),
}


def closed_loop_report(
    pixels: DataFrame, images: DataFrame, recipes: DataFrame, keys=("exposure", "temperature", "tint", "saturation")
) -> DataFrame:
    """Grade photos with known edits, match them back and report the recovery error per key.

    Both sides are brought to the size of the analysis preview first. Only features that the known keys are
    matched by are taken of the pixels.
    """
    from .geometry import preview, preview_size
    from .grade import grade, settled
    from .stats import look_features

    small = preview(pixels, images, FEATURE_EDGE)
    sizes = preview_size(images, FEATURE_EDGE).select(
        "image_id", F.col("out_width").alias("width"), F.col("out_height").alias("height")
    )
    graded = settled(grade(small, sizes, recipes), ["image_id", "x", "y"], list("rgba"))
    known = [k for k in keys if k in recipes.columns]
    wanted = {n for k in known for n in KEY_FEATURES.get(k, ())}
    ref = look_features(graded, wanted).withColumn("image_id", -F.col("image_id") - 1)
    pairs = images.select(F.col("image_id").alias("target_id"), (-F.col("image_id") - 1).alias("ref_id"))
    features = cut_lineage(look_features(small, wanted).unionByName(ref))  # both sides of a pair read it
    others = [n for n, _ in CURVE_KNOTS] + [n for columns in KEY_FEATURES.values() for n in columns]
    features = features.withColumns({n: F.lit(None).cast("double") for n in others if n not in wanted})
    matched = match_reference(pairs, features, "full")
    truth = recipes.select(F.col("image_id").alias("target_id"), *[F.col(k).alias(f"_true_{k}") for k in known])
    errors = F.array(*[
        F.struct(F.lit(k).alias("param"), F.abs(F.col(k) - F.col(f"_true_{k}")).alias("error")) for k in known
    ])
    rows = join_large(matched, truth, "target_id").select(F.explode(errors).alias("e")).select("e.param", "e.error")
    return rows.groupBy("param").agg(
        F.count("*").alias("pairs"),
        F.avg("error").alias("mean_error"),
        F.percentile_approx("error", F.lit(0.5), F.lit(10_000)).alias("median_error"),
        F.percentile_approx("error", F.lit(0.95), F.lit(10_000)).alias("p95_error"),
    )
