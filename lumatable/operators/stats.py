"""Photo statistics as aggregates of the pixel table.

Every aggregate has a bounded number of groups per photo (bins, bands, zones, exact luma
levels), so partial aggregation absorbs a photo that holds a large share of all pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions.color import luma_709, luma_level, with_linear, with_oklab, with_oklch
from ..functions.numeric import clamp01, smoothstep, total
from ..plans.joins import BROADCAST_ROWS, has_few_rows, join_large, join_per_image
from ..plans.session import spread

QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)

# Eight hue bands with their centres in degrees.
HUE_BANDS = {
    "red": 0.0,
    "orange": 45.0,
    "yellow": 90.0,
    "green": 135.0,
    "aqua": 180.0,
    "blue": 225.0,
    "purple": 270.0,
    "magenta": 315.0,
}
BAND_REACH = 45.0


def whole_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels with all three colour bytes: what every statistic here is taken of.

    ``gap_counts`` counts the others; a statistic never makes up a value for them.
    """
    return pixels.filter("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")


def gap_counts(pixels: DataFrame) -> DataFrame:
    """Pixels per photo that statistics leave out since a colour byte is missing."""
    return pixels.groupBy("image_id").agg(
        F.count("*").alias("n_pixels"), F.count_if(F.expr("r IS NULL OR g IS NULL OR b IS NULL")).alias("n_left_out")
    )


def luma_histogram(
    pixels: DataFrame, images: DataFrame, bins: int = S.HISTOGRAM_BINS, sample_target: int | None = None
) -> DataFrame:
    """Histogram of BT.709 luma with heights scaled to the fullest bin.

    Every pixel counts. ``sample_target`` asks for a live view's shortcut instead: every k-th pixel in
    row order, k from the frame size. Empty bins come from zero rows in the same aggregation, not
    from a join.
    """
    luma = luma_709(F.col("r"), F.col("g"), F.col("b"))
    sampled = whole_pixels(pixels)
    if sample_target is not None:
        dims = images.select("image_id", "width", "height")
        area = F.col("width").cast("long") * F.col("height")
        step = F.greatest(F.lit(1), F.floor(area / sample_target))
        sampled = join_per_image(sampled, dims, has_few_rows(dims)).filter(
            (F.col("y").cast("long") * F.col("width") + F.col("x")) % step == 0
        )
    hits = sampled.select(
        "image_id",
        F.least(F.lit(bins - 1), F.floor(luma / 256.0 * bins)).cast("int").alias("bin"),
        F.lit(1).alias("one"),
    )
    ids = images.select("image_id")
    empty = spread(ids, "image_id", rows=ids.count()).select(
        "image_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).alias("one")
    )
    counts = hits.unionByName(empty).groupBy("image_id", "bin").agg(F.sum("one").alias("n"))
    top = F.max("n").over(Window.partitionBy("image_id"))
    return counts.withColumn("height", F.col("n") / F.greatest(top, F.lit(1)))


def rgb_histogram(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """Counts per channel (R, G, B, luma) and bin of whole pixels; empty bins are absent."""
    luma = F.floor(luma_level(F.col("r"), F.col("g"), F.col("b")) / 10000).cast("int").alias("luma")
    return (
        whole_pixels(pixels).select("image_id", "r", "g", "b", luma)
        .selectExpr("image_id", "stack(4, 'r', r, 'g', g, 'b', b, 'luma', luma) AS (channel, v)")
        .groupBy("image_id", "channel", F.expr(f"cast(floor(v * {bins} / 256) as int)").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def weighted_quantiles(counts: DataFrame, keys, value: str, n: str, probs, names) -> DataFrame:
    """Exact interpolated quantiles from (value, count) pairs.

    Works on pre-aggregated distinct values, so the ordered pass sees at most one row per
    distinct value of a key, never one per pixel. Null values count nowhere.
    """
    counts = counts.filter(F.col(value).isNotNull())
    up_to = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    c = counts.withColumns({"_cum": F.sum(n).over(up_to), "_all": F.sum(n).over(whole)})

    def at(position):
        return F.min(F.when(F.col("_cum") > position, F.col(value)))

    aggs = []
    for p, name in zip(probs, names):
        pos = (F.col("_all") - 1) * F.lit(float(p))
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return c.groupBy(*keys).agg(*aggs)


def luma_quantiles(pixels: DataFrame) -> DataFrame:
    """Luma percentiles (0..255), robust contrast, toe and shoulder per photo."""
    level = luma_level(F.col("r"), F.col("g"), F.col("b")).alias("level")
    counts = whole_pixels(pixels).select("image_id", level).groupBy("image_id", "level").agg(F.count("*").alias("n"))
    names = [f"p{round(p * 100):02d}" for p in QUANTILES]
    q = weighted_quantiles(counts, ["image_id"], "level", "n", QUANTILES, names)
    q = q.select("image_id", *[(F.col(n) / 10000.0).alias(n) for n in names])
    return q.withColumns(
        {
            "robust_contrast": F.col("p90") - F.col("p10"),
            "toe": F.col("p05") - F.col("p01"),
            "shoulder": F.col("p99") - F.col("p95"),
        }
    )


def perceptual(pixels: DataFrame) -> DataFrame:
    """Pixels with OKLab and OKLCh columns."""
    return with_oklch(with_oklab(with_linear(pixels)))


def band_weight(hue: Column, centre) -> Column:
    """Tent weight of a hue for a band: 1 at its centre, 0 from 45 degrees on."""
    d = F.abs(F.pmod(hue - centre + 180.0, F.lit(360.0)) - 180.0)
    return F.greatest(F.lit(0.0), 1.0 - d / BAND_REACH)


def _band_rows(pixels: DataFrame) -> DataFrame:
    """A row per whole pixel and hue band that it has a weight ``w`` in.

    The tents overlap with their neighbours only, so a pixel becomes two rows, not eight.
    """
    bands = F.array(
        *[F.struct(F.lit(i).alias("k"), F.lit(n).alias("band"), F.lit(c).alias("centre")) for i, (n, c) in enumerate(HUE_BANDS.items())]
    )
    k = F.floor(F.col("hue") / BAND_REACH).cast("int") % len(HUE_BANDS)
    near = F.array(F.get(bands, k), F.get(bands, (k + 1) % len(HUE_BANDS)))
    px = perceptual(whole_pixels(pixels)).select("image_id", "lab_l", "chroma", "hue", F.explode(near).alias("b"))
    px = px.withColumn("w", band_weight(F.col("hue"), F.col("b.centre")) * F.col("chroma"))
    return px.filter("w > 0")


def hue_band_stats(pixels: DataFrame) -> DataFrame:
    """Mass, circular mean hue, mean chroma and lightness in eight overlapping hue bands."""
    px = _band_rows(pixels)
    rad = F.col("hue") * (math.pi / 180.0)
    w = F.col("w")
    return px.groupBy("image_id", F.col("b.band").alias("band")).agg(
        F.sum(w).alias("mass"),
        F.pmod(
            F.atan2(F.sum(w * F.sin(rad)), F.sum(w * F.cos(rad))) * (180.0 / math.pi), F.lit(360.0)
        ).alias("mean_hue"),
        (F.sum(w * F.col("chroma")) / F.sum(w)).alias("mean_chroma"),
        (F.sum(w * F.col("lab_l")) / F.sum(w)).alias("mean_lightness"),
    )


def hue_band_medians(pixels: DataFrame) -> DataFrame:
    """Weighted median hue of each hue band, in steps of a tenth of a degree, and its mass.

    A band reaches less than 90 degrees, so the circle is cut opposite its centre, where it has no
    mass; hues become offsets from the centre, and the bands across 0 degrees need no case of their
    own. The median is the least step with half the mass at or below it. Weights are counted in
    millionths, which keeps the sums exact in any order, and a photo has at most 900 steps a band, so
    the ordered pass never sees a pixel. Bands without mass have no row.
    """
    offset = F.pmod(F.col("hue") - F.col("b.centre") + 180.0, F.lit(360.0)) - 180.0
    steps = _band_rows(pixels).groupBy(
        "image_id", "b.k", F.floor(offset * 10.0 + 0.5).alias("step")
    ).agg(F.sum(F.floor(F.col("w") * 1e6 + 0.5)).alias("n"))
    whole = Window.partitionBy("image_id", "k")
    c = steps.withColumns({"_cum": F.sum("n").over(whole.orderBy("step")), "_all": F.sum("n").over(whole)}).filter("_all > 0")
    median = F.min(F.when(F.col("_cum") * 2 >= F.col("_all"), F.col("step"))) / 10.0
    # groups and windows go by the band's number; its name and centre are looked up once a row
    name, centre = (F.get(F.array(*map(F.lit, values)), F.col("k")) for values in (HUE_BANDS.keys(), HUE_BANDS.values()))
    return c.groupBy("image_id", "k").agg(median.alias("_m"), F.max("_all").alias("_n")).select(
        "image_id", name.alias("band"), F.pmod(F.col("_m") + centre, F.lit(360.0)).alias("median_hue"), (F.col("_n") / 1e6).alias("mass")
    )


def zone_centroids(pixels: DataFrame) -> DataFrame:
    """Weighted OKLab centroids of shadows, midtones and highlights."""
    px = perceptual(whole_pixels(pixels))
    l = clamp01(F.col("lab_l"))
    weights = F.array(
        *[
            F.struct(F.lit(n).alias("zone"), w.alias("w"))
            for n, w in (
                ("shadow", (1.0 - l) * (1.0 - l)),
                ("mid", F.greatest(F.lit(0.0), 1.0 - F.abs(l - 0.5) * 2.0)),
                ("high", l * l),
            )
        ]
    )
    px = px.select("image_id", "lab_a", "lab_b", F.explode(weights).alias("z"))
    w = F.col("z.w")
    return px.groupBy("image_id", F.col("z.zone").alias("zone")).agg(
        F.sum(w).alias("mass"),
        F.try_divide(F.sum(w * F.col("lab_a")), F.sum(w)).alias("a"),
        F.try_divide(F.sum(w * F.col("lab_b")), F.sum(w)).alias("b"),
    )


def neutral_center(pixels: DataFrame, max_chroma=0.04, lightness=(0.2, 0.9)) -> DataFrame:
    """Median a/b of near-neutral pixels and their share of the photo as confidence.

    a and b are taken in steps of 1/10000, which bounds the distinct values per photo.
    """
    px = perceptual(whole_pixels(pixels))
    near = (F.col("chroma") < max_chroma) & F.col("lab_l").between(*lightness)
    step = lambda c: F.floor(F.col(c) * 10000.0 + 0.5).cast("long")
    values = px.select(
        "image_id", near.alias("near"),
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("axis"), step("lab_a").alias("v")),
                F.struct(F.lit("b").alias("axis"), step("lab_b").alias("v")),
            )
        ).alias("e"),
    )
    counts = (
        values.filter("near").groupBy("image_id", F.col("e.axis").alias("axis"), F.col("e.v").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    medians = weighted_quantiles(counts, ["image_id", "axis"], "v", "n", [0.5], ["median"])
    pick = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("median") / 10000.0))
    centers = medians.groupBy("image_id").agg(pick("a").alias("a"), pick("b").alias("b"))
    share = px.groupBy("image_id").agg((F.count_if(near) / F.count("*")).alias("confidence"))
    return join_large(share, centers, "image_id", "left").select("image_id", "a", "b", "confidence")


def density_relation(pixels: DataFrame, steps: int = 8) -> DataFrame:
    """Mean chroma per lightness step."""
    step = F.least(F.lit(steps - 1), F.floor(clamp01(F.col("lab_l")) * steps)).cast("int")
    return (
        perceptual(whole_pixels(pixels))
        .groupBy("image_id", step.alias("step"))
        .agg(F.count("*").alias("n"), F.avg("chroma").alias("mean_chroma"))
    )


def density_slope(pixels: DataFrame) -> DataFrame:
    """Slope of chroma against lightness."""
    return perceptual(whole_pixels(pixels)).groupBy("image_id").agg(
        F.regr_slope("chroma", "lab_l").alias("density_slope")
    )


def class_stats(pixels: DataFrame, masks: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Mean OKLab per photo and mask class, for confident masks only.

    ``masks``: image_id, class, x, y, w, confidence. A class counts if its least confidence in the photo
    reaches ``min_confidence``; a missing one does not. Which classes do is decided by a small table
    before the join with the pixels.
    """
    least = masks.groupBy("image_id", "class").agg(
        F.min(F.coalesce("confidence", F.lit(float("-inf")))).alias("_least")
    )
    sure = join_large(masks, least.filter(F.col("_least") >= min_confidence), ["image_id", "class"], "left_semi")
    j = join_large(perceptual(whole_pixels(pixels)), sure, ["image_id", "x", "y"])
    w = F.col("w")
    mean = lambda c: F.try_divide(F.sum(w * F.col(c)), F.sum(w))
    return j.groupBy("image_id", "class").agg(
        F.sum(w).alias("mass"), mean("lab_l").alias("l"), mean("lab_a").alias("a"), mean("lab_b").alias("b")
    )


def paired_class_stats(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Class statistics side by side, only where both photos of a pair have the class."""
    side = lambda df, p: df.select(
        F.col("image_id").alias(f"{p}_id"), "class", *[F.col(c).alias(f"{p}_{c}") for c in "lab"]
    )
    targets = join_large(pairs, side(left, "target"), "target_id")
    return join_large(targets, side(right, "ref"), ["ref_id", "class"])


def wb_eyedropper(pixels: DataFrame, samples: DataFrame, reach: int = 4) -> DataFrame:
    """Median colour of the square around each picked point (9x9 for reach 4).

    Points are spread to the rows they touch and joined on (image, row): no cross pairs. A point
    collects at most 81 pixels.
    """
    rows = samples.select(
        "sample_id", "image_id", F.col("x").alias("sx"),
        F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)).alias("y"),
    )
    cells = rows.select(
        "sample_id", "image_id", "y", F.explode(F.sequence(F.col("sx") - reach, F.col("sx") + reach)).alias("x")
    )
    few = has_few_rows(samples, BROADCAST_ROWS // (2 * reach + 1) ** 2)
    hit = pixels.join(cells.hint("broadcast" if few else "merge"), ["image_id", "x", "y"])
    return hit.groupBy("sample_id", "image_id").agg(
        F.count("*").alias("n"), *[F.median(c).alias(c) for c in "rgb"]
    )


# what look_features forms from counts alone
COUNTED = {"p01", "p05", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "robust_contrast", "toe", "shoulder"}
COUNTED |= {"neutral_a", "neutral_b", "neutral_confidence"}


def look_features(pixels: DataFrame, wanted=None) -> DataFrame:
    """One wide row per photo: quantiles, bands, zones, neutral centre and density slope.

    ``wanted`` names the columns to form (all of them if not given). If counts are enough for them, the pixels
    are read once and nothing is summed.

    Give it previews (``geometry.preview``) of a library. One aggregate has the sums, a row a photo. The
    other counts by (photo, kind, value): a pixel is at most three rows there (luma level, two steps of
    near-neutral colour) that carry a count and no sums, so its groups are narrow. Medians and quantiles are
    formed from those. Where pixels are dealt out by photo, neither exchanges them.
    """
    px = perceptual(whole_pixels(pixels)).withColumn("level", luma_level(F.col("r"), F.col("g"), F.col("b")))
    l, chroma, rad = clamp01(F.col("lab_l")), F.col("chroma"), F.col("hue") * (math.pi / 180.0)
    near = (chroma < 0.04) & F.col("lab_l").between(0.2, 0.9)
    sums = {"n": F.lit(1.0), "c": chroma, "l": F.col("lab_l")}
    sums |= {"cl": chroma * F.col("lab_l"), "ll": F.col("lab_l") * F.col("lab_l")}
    zones = {
        "shadow": (1.0 - l) * (1.0 - l), "mid": F.greatest(F.lit(0.0), 1.0 - F.abs(l - 0.5) * 2.0), "high": l * l,
    }
    for z, w in zones.items():
        sums |= {f"{z}_w": w, f"{z}_wa": w * F.col("lab_a"), f"{z}_wb": w * F.col("lab_b")}
    for n, centre in HUE_BANDS.items():
        w = band_weight(F.col("hue"), F.lit(centre)) * chroma
        sums |= {f"{n}_w": w, f"{n}_ws": w * F.col("sin_h"), f"{n}_wc": w * F.col("cos_h"), f"{n}_wch": w * chroma, f"{n}_wl": w * F.col("lab_l")}
    step = lambda c: F.floor(F.col(c) * 10000.0 + 0.5).cast("long")
    px = px.select(
        "image_id", "level", near.alias("near"), step("lab_a").alias("sa"), step("lab_b").alias("sb"),
        "lab_l", "lab_a", "lab_b", "chroma", "hue", F.sin(rad).alias("sin_h"), F.cos(rad).alias("cos_h"),
    )
    asked = lambda *columns: wanted is None or not {*columns}.isdisjoint(wanted)
    luma, some = "named_struct('kind', 1, 'v', cast(level as bigint))", ""
    some += ", named_struct('kind', 2, 'v', sa)" if asked("neutral_a", "neutral_confidence") else ""
    some += ", named_struct('kind', 3, 'v', sb)" if asked("neutral_b") else ""
    kinds = F.expr(f"explode(CASE WHEN near THEN array({luma}{some}) ELSE array({luma}) END) AS e")
    summed = px.groupBy("image_id").agg(*[F.sum(v).alias(f"s_{k}") for k, v in sums.items()])
    rows = px.select("image_id", kinds)
    merged = rows.groupBy("image_id", F.col("e.kind").alias("kind"), F.col("e.v").alias("v")).agg(F.count("*").alias("m"))
    up_to, whole = Window.partitionBy("image_id", "kind").orderBy("v"), Window.partitionBy("image_id", "kind")
    c = merged.withColumns({"_cum": F.sum("m").over(up_to), "_all": F.sum("m").over(whole)})

    def quantile(kind, p):
        pos = (F.col("_all") - 1) * F.lit(float(p))
        here = F.col("kind") == kind
        at = lambda position: F.min(F.when(here & (F.col("_cum") > position), F.col("v")))
        lo, hi, part = at(F.floor(pos)), at(F.ceil(pos)), F.max(F.when(here, pos - F.floor(pos)))
        return (lo + (hi - lo) * part) / 10000.0

    names = {p: f"p{round(p * 100):02d}" for p in QUANTILES}
    out = c.groupBy("image_id").agg(
        *[quantile(1, p).alias(n) for p, n in names.items()],
        quantile(2, 0.5).alias("neutral_a"), quantile(3, 0.5).alias("neutral_b"),
        (F.coalesce(F.max(F.when(F.col("kind") == 2, F.col("_all"))), F.lit(0)) / F.max(F.when(F.col("kind") == 1, F.col("_all")))).alias("neutral_confidence"),
    )
    if wanted is None or not COUNTED.issuperset(wanted):
        out = join_large(out, summed, "image_id")
    s = {k: F.col(f"s_{k}") for k in sums}
    over = lambda a, b: F.try_divide(a, F.when(b > 0, b))
    columns = {n: F.col(n) for n in names.values()}
    columns |= {
        "robust_contrast": F.col("p90") - F.col("p10"), "toe": F.col("p05") - F.col("p01"), "shoulder": F.col("p99") - F.col("p95"),
    }
    for n in HUE_BANDS:
        w = s[f"{n}_w"]
        angle = F.pmod(F.atan2(s[f"{n}_ws"], s[f"{n}_wc"]) * (180.0 / math.pi), F.lit(360.0))
        columns |= {
            f"{n}_mass": F.when(w > 0, w), f"{n}_hue": F.when(w > 0, angle),
            f"{n}_chroma": over(s[f"{n}_wch"], w), f"{n}_lightness": over(s[f"{n}_wl"], w),
        }
    for z in zones:
        columns |= {f"{z}_a": over(s[f"{z}_wa"], s[f"{z}_w"]), f"{z}_b": over(s[f"{z}_wb"], s[f"{z}_w"])}
    spread_l = s["ll"] * s["n"] - s["l"] * s["l"]
    columns |= {n: F.col(n) for n in ("neutral_a", "neutral_b", "neutral_confidence")}
    columns["density_slope"] = over(s["cl"] * s["n"] - s["c"] * s["l"], spread_l)
    return out.select("image_id", *[v.alias(n) for n, v in columns.items() if asked(n)])


# --- colour stages built on the same space ----------------------------------


def color_mixer(pixels: DataFrame, shifts: dict[str, tuple[float, float, float]] | DataFrame) -> DataFrame:
    """Shift hue (degrees), chroma and lightness (factors) in eight smooth hue bands.

    Adjacent tents sum to one, so the bands blend without seams. ``shifts`` is one setting for all
    photos, or a table image_id, band, hue, chroma, lightness; photos and bands without a row there
    have no shift. A pixel with a missing byte has no colour to shift: all three come out missing.
    """
    from ..functions.color import linear_to_srgb, with_rgb_from_oklab
    from ..functions.numeric import half_up

    px = perceptual(pixels)
    if isinstance(shifts, DataFrame):
        pick = lambda n, c: F.max(F.when(F.col("band") == n, F.col(c).cast("double")))
        names = [(n, i, c) for n in HUE_BANDS for i, c in enumerate(("hue", "chroma", "lightness"))]
        wide = shifts.groupBy("image_id").agg(*[pick(n, c).alias(f"_{n}{i}") for n, i, c in names])
        px = join_per_image(px, wide, has_few_rows(wide), how="left")
        amount = {n: [F.coalesce(f"_{n}{i}", F.lit(0.0)) for i in range(3)] for n in HUE_BANDS}
    else:
        amount = {n: [F.lit(float(v)) for v in three] for n, three in shifts.items()}
    weights = {n: band_weight(F.col("hue"), c) for n, c in HUE_BANDS.items() if n in amount}
    part = lambda i: total([F.lit(0.0)] + [w * amount[n][i] for n, w in weights.items()])
    px = px.withColumns({"_dh": part(0), "_dc": part(1), "_dl": part(2)})
    px = px.withColumns(
        {
            "_h": (F.col("hue") + F.col("_dh")) * (math.pi / 180.0),
            "_c": F.col("chroma") * F.greatest(F.lit(0.0), F.col("_dc") + 1.0),
            "lab_l": F.col("lab_l") * F.greatest(F.lit(0.0), F.col("_dl") + 1.0),
        }
    )
    px = px.withColumns({"lab_a": F.col("_c") * F.cos("_h"), "lab_b": F.col("_c") * F.sin("_h")})
    px = with_rgb_from_oklab(px)
    # clamping would make a value up where a byte is missing
    whole = F.expr("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
    return px.withColumns(
        {c: F.when(whole, half_up(linear_to_srgb(F.col(f"l{c}")) * 255.0)) for c in "rgb"}
    ).select(*pixels.columns)


# Skin hue, its width, and the chroma and lightness ranges in OKLCh.
SKIN_HUE, SKIN_WIDTH = 55.0, 35.0
SKIN_CHROMA, SKIN_LIGHTNESS = (0.02, 0.06, 0.14, 0.22), (0.25, 0.45, 0.85, 0.97)


def skin_likelihood(hue: Column, chroma: Column, lightness: Column) -> Column:
    """0..1 from hue, chroma and lightness together."""
    d = F.abs(F.pmod(hue - SKIN_HUE + 180.0, F.lit(360.0)) - 180.0)
    plateau = lambda v, e: smoothstep(F.lit(e[0]), F.lit(e[1]), v) * (
        1.0 - smoothstep(F.lit(e[2]), F.lit(e[3]), v)
    )
    return (
        (1.0 - smoothstep(F.lit(0.0), F.lit(SKIN_WIDTH), d))
        * plateau(chroma, SKIN_CHROMA)
        * plateau(lightness, SKIN_LIGHTNESS)
    )


def skin_vibrance_weight(pixels: DataFrame, protect: float = 1.0) -> DataFrame:
    """Vibrance weight per pixel: low chroma counts more, skin is protected."""
    px = perceptual(pixels)
    px = px.withColumn("skin", skin_likelihood(F.col("hue"), F.col("chroma"), F.col("lab_l")))
    low = 1.0 - clamp01(F.col("chroma") / 0.3)
    return px.withColumn("vibrance_weight", low * (1.0 - F.col("skin") * protect))


def compress_gamut(px: DataFrame, knee: float = 0.9, cols=("lr", "lg", "lb")) -> DataFrame:
    """Bring unbounded linear RGB into 0..1 by shrinking chroma about luma.

    Colours below the knee stay; above it the largest channel approaches 1 smoothly.
    """
    r, g, b = (F.col(c) for c in cols)
    px = px.withColumn("_y", clamp01(luma_709(r, g, b)))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    room = F.greatest(F.lit(1e-9), 1.0 - F.col("_y"))
    over = (top - F.col("_y")) / room
    under = (F.col("_y") - low) / F.greatest(F.lit(1e-9), F.col("_y"))
    px = px.withColumn("_x", F.greatest(over, under))
    x = F.col("_x")
    soft = knee + (1.0 - knee) * (1.0 - F.exp((knee - x) / (1.0 - knee)))
    px = px.withColumn("_s", F.when(x <= knee, 1.0).otherwise(soft / x))
    return px.withColumns(
        {c: clamp01(F.col("_y") + (F.col(c) - F.col("_y")) * F.col("_s")) for c in cols}
    ).drop("_y", "_x", "_s")
