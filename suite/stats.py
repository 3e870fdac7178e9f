"""Statistics and colour queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable.functions.color import LMS_TO_LAB, RGB_TO_LMS, with_linear
from lumatable.operators import stats as T

from . import inputs as I

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


_dec = lambda c: (
    f"CASE WHEN {c}/255e0 <= 0.04045e0 THEN {c}/255e0/12.92e0 ELSE pow(({c}/255e0+0.055e0)/1.055e0, 2.4e0) END"
)
_row = lambda m, n: " + ".join(f"({w!r}::DOUBLE)*{c}" for w, c in zip(m, n))
LAB = (
    f", lin AS (SELECT *, {_dec('r')} AS lr, {_dec('g')} AS lg, {_dec('b')} AS lb FROM pixels)"
    ", lms AS (SELECT *, " + ", ".join(f"cbrt({_row(m, ['lr', 'lg', 'lb'])}) AS q{i}" for i, m in enumerate(RGB_TO_LMS)) + " FROM lin)"
    ", lab AS (SELECT image_id, x, y, r, g, b, lr, lg, lb, "
    + ", ".join(f"{_row(m, ['q0', 'q1', 'q2'])} AS {n}" for n, m in zip(("ll", "la", "lb_"), LMS_TO_LAB)) + " FROM lms)"
    ", lch AS (SELECT *, sqrt(la*la+lb_*lb_) AS ch, fmod(degrees(atan2(lb_, la)) + 360e0, 360e0) AS hue FROM lab)"
)


def r6(**cols):
    return [F.round(F.col(c) if isinstance(c, str) else c, 6).alias(n) for n, c in cols.items()]


@register("luma_histogram", I.with_ctes(
    ["photos", "pixels"],
    """, n AS (SELECT image_id, least(47, CAST(floor((0.2126e0*r+0.7152e0*g+0.0722e0*b)/256e0*48) AS INT)) AS bin, count(*) AS n FROM pixels GROUP BY ALL)
    , s AS (SELECT image_id, CAST(b AS INT) AS bin FROM photos, range(0,48) t(b))
    , j AS (SELECT s.image_id, s.bin, coalesce(n.n, 0) AS n FROM s LEFT JOIN n ON s.image_id = n.image_id AND s.bin = n.bin)
    SELECT image_id, bin, n, round(n/greatest(max(n) OVER (PARTITION BY image_id), 1), 9) AS height FROM j""",
))
def luma_histogram(spark, sf):
    h = T.luma_histogram(I.pixels(spark, sf), I.photos(spark, sf))
    return h.select("image_id", "bin", "n", F.round("height", 9).alias("height"))


@register("rgb_histogram", I.with_ctes(
    ["pixels"],
    """, u AS (SELECT image_id, unnest(['r','g','b','luma']) AS channel, unnest([r, g, b, CAST((2126*r+7152*g+722*b)//10000 AS INT)]) AS bin FROM pixels)
    SELECT image_id, channel, bin, count(*) AS n FROM u GROUP BY ALL""",
))
def rgb_histogram(spark, sf):
    return T.rgb_histogram(I.pixels(spark, sf))


_GAP = "(image_id*7 + x*5 + y*3 + {0}) % 13 = 0"


@register("statistics_with_gaps", I.with_ctes(
    ["pixels"],
    ", gaps AS (SELECT image_id, x, y, " + ", ".join(f"CASE WHEN {_GAP.format(k)} THEN NULL ELSE {c} END AS {c}" for k, c in enumerate("rgb")) + """ FROM pixels)
    , counts AS (SELECT image_id, count(*) AS n_pixels, count(*) FILTER (WHERE r IS NULL OR g IS NULL OR b IS NULL) AS n_left_out FROM gaps GROUP BY image_id)
    , whole AS (SELECT * FROM gaps WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL)""" + LAB.replace("FROM pixels", "FROM whole") + """
    , zones AS (SELECT image_id, sum((1e0-l)*(1e0-l)) AS shadow, sum(l*l) AS high, avg(ch) AS chroma, regr_slope(ch, ll) AS slope
      FROM (SELECT *, least(1e0, greatest(0e0, ll)) AS l FROM lch) GROUP BY image_id)
    , luma AS (SELECT image_id, quantile_cont(CAST(2126*r+7152*g+722*b AS DOUBLE), 0.5)/10000e0 AS p50,
        count(*) FILTER (WHERE 0.2126e0*r+0.7152e0*g+0.0722e0*b >= 224e0) AS top_bin FROM whole GROUP BY image_id)
    SELECT image_id, n_pixels, n_left_out, round(p50, 6) AS p50, top_bin, round(shadow, 6) AS shadow_mass, round(high, 6) AS high_mass,
      round(chroma, 6) AS mean_chroma, round(slope, 6) AS density_slope
    FROM counts JOIN zones USING (image_id) JOIN luma USING (image_id)""",
))
def statistics_with_gaps(spark, sf):
    """Statistics of photos in which every 13th byte is missing: those of their whole pixels."""
    px = I.pixels(spark, sf)
    px = px.withColumns({c: F.expr(f"CASE WHEN {_GAP.format(k)} THEN NULL ELSE {c} END") for k, c in enumerate("rgb")})
    zones = T.zone_centroids(px).groupBy("image_id").agg(
        *[F.max(F.when(F.col("zone") == z, F.col("mass"))).alias(f"{z}_mass") for z in ("shadow", "high")]
    )
    bins = T.luma_histogram(px, I.photos(spark, sf), 8).filter("bin = 7").select("image_id", F.col("n").cast("long").alias("top_bin"))
    chroma = T.density_relation(px).groupBy("image_id").agg((F.sum(F.col("n") * F.col("mean_chroma")) / F.sum("n")).alias("mean_chroma"))
    out = T.gap_counts(px)
    for part in (T.luma_quantiles(px).select("image_id", "p50"), bins, zones, chroma, T.density_slope(px)):
        out = out.join(part, "image_id")
    return out.select(
        "image_id", "n_pixels", "n_left_out", "top_bin",
        *r6(**{c: c for c in ("p50", "shadow_mass", "high_mass", "mean_chroma", "density_slope")}),
    )


_Q = ", ".join(f"quantile_cont(v, {p}) AS p{round(p * 100):02d}" for p in T.QUANTILES)
_QN = ", ".join(f"round(p{round(p * 100):02d}/10000e0, 6) AS p{round(p * 100):02d}" for p in T.QUANTILES)


@register("luma_quantiles", I.with_ctes(
    ["pixels"],
    f""", q AS (SELECT image_id, {_Q} FROM (SELECT image_id, CAST(2126*r+7152*g+722*b AS DOUBLE) AS v FROM pixels) GROUP BY image_id)
    SELECT image_id, {_QN}, round((p90-p10)/10000e0, 6) AS robust_contrast, round((p05-p01)/10000e0, 6) AS toe,
      round((p99-p95)/10000e0, 6) AS shoulder FROM q""",
))
def luma_quantiles(spark, sf):
    q = T.luma_quantiles(I.pixels(spark, sf))
    return q.select("image_id", *r6(**{c: c for c in q.columns if c != "image_id"}))


@register("frame_quantiles", I.with_ctes(
    ["frames"],
    " SELECT image_id, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS p50, "
    "round(quantile_cont(v, 0.95), 6) AS p95 FROM frames GROUP BY image_id",
))
def frame_quantiles(spark, sf):
    counts = I.frames(spark, sf).groupBy("image_id", "v").agg(F.count("*").alias("n"))
    q = T.weighted_quantiles(counts, ["image_id"], "v", "n", [0.05, 0.5, 0.95], ["p05", "p50", "p95"])
    return q.select("image_id", *r6(p05="p05", p50="p50", p95="p95"))


@register("oklab", I.with_ctes(
    ["pixels"], LAB + " SELECT image_id, x, y, round(ll, 6) AS l, round(la, 6) AS a, round(lb_, 6) AS b, round(ch, 6) AS chroma FROM lch"
))
def oklab(spark, sf):
    return T.perceptual(I.pixels(spark, sf)).select(
        "image_id", "x", "y", *r6(l="lab_l", a="lab_a", b="lab_b", chroma="chroma")
    )


_BANDS = ", ".join(f"('{n}', {c}e0)" for n, c in T.HUE_BANDS.items())


@register("hue_band_stats", I.with_ctes(
    ["pixels"],
    LAB + f""", w AS (SELECT image_id, ll, ch, hue, b.band, ch*greatest(0e0, 1e0-least(abs(hue-b.c), 360e0-abs(hue-b.c))/45e0) AS w
      FROM lch, (VALUES {_BANDS}) b(band, c))
    SELECT image_id, band, round(sum(w), 6) AS mass, round(fmod(degrees(atan2(sum(w*sin(radians(hue))), sum(w*cos(radians(hue)))))+360e0, 360e0), 4) AS mean_hue,
      round(sum(w*ch)/sum(w), 6) AS mean_chroma, round(sum(w*ll)/sum(w), 6) AS mean_lightness FROM w WHERE w > 0 GROUP BY ALL""",
))
def hue_band_stats(spark, sf):
    return T.hue_band_stats(I.pixels(spark, sf)).select(
        "image_id", "band", *r6(mass="mass"), F.round("mean_hue", 4).alias("mean_hue"),
        *r6(mean_chroma="mean_chroma", mean_lightness="mean_lightness"),
    )


@register("hue_band_medians", I.with_ctes(
    ["pixels"],
    LAB + f""", o AS (SELECT image_id, ch, b.band, b.c, fmod(hue-b.c+540e0, 360e0)-180e0 AS d
      FROM lch, (VALUES {_BANDS}) b(band, c))
    , w AS (SELECT image_id, band, c, CAST(floor(d*10e0+0.5e0) AS BIGINT) AS step, ch*greatest(0e0, 1e0-abs(d)/45e0) AS w FROM o)
    , n AS (SELECT image_id, band, c, step, sum(CAST(floor(w*1e6+0.5e0) AS BIGINT)) AS n FROM w WHERE w > 0 GROUP BY ALL)
    , q AS (SELECT *, sum(n) OVER (PARTITION BY image_id, band ORDER BY step) AS cum, sum(n) OVER (PARTITION BY image_id, band) AS al FROM n)
    SELECT image_id, band, round(fmod(min(step) FILTER (WHERE 2*cum >= al)/10e0+c+360e0, 360e0), 4) AS median_hue,
      round(CAST(max(al) AS DOUBLE)/1e6, 4) AS mass FROM q WHERE al > 0 GROUP BY image_id, band, c""",
))
def hue_band_medians(spark, sf):
    # masses are whole millionths, so many end in 5 after the fourth digit: SQL rounds the product, not the decimals
    mass = F.floor(F.col("mass") * 1e4 + 0.5) / 1e4
    return T.hue_band_medians(I.pixels(spark, sf)).select(
        "image_id", "band", F.round("median_hue", 4).alias("median_hue"), mass.alias("mass")
    )


@register("zone_centroids", I.with_ctes(
    ["pixels"],
    LAB + """, c AS (SELECT *, least(1e0, greatest(0e0, ll)) AS l1 FROM lch)
    , z AS (SELECT image_id, la, lb_, unnest(['shadow','mid','high']) AS zone, unnest([(1e0-l1)*(1e0-l1), greatest(0e0, 1e0-abs(l1-0.5e0)*2e0), l1*l1]) AS w FROM c)
    SELECT image_id, zone, round(sum(w), 6) AS mass, round(sum(w*la)/sum(w), 6) AS a, round(sum(w*lb_)/sum(w), 6) AS b FROM z GROUP BY ALL""",
))
def zone_centroids(spark, sf):
    return T.zone_centroids(I.pixels(spark, sf)).select("image_id", "zone", *r6(mass="mass", a="a", b="b"))


@register("neutral_center", I.with_ctes(
    ["pixels"],
    LAB + """ SELECT image_id, round(median(CASE WHEN ch < 0.04 AND ll BETWEEN 0.2 AND 0.9 THEN floor(la*10000e0+0.5e0) END)/10000e0, 6) AS a,
      round(median(CASE WHEN ch < 0.04 AND ll BETWEEN 0.2 AND 0.9 THEN floor(lb_*10000e0+0.5e0) END)/10000e0, 6) AS b,
      round(count(*) FILTER (WHERE ch < 0.04 AND ll BETWEEN 0.2 AND 0.9)/count(*), 6) AS confidence FROM lch GROUP BY image_id""",
))
def neutral_center(spark, sf):
    return T.neutral_center(I.pixels(spark, sf)).select("image_id", *r6(a="a", b="b", confidence="confidence"))


@register("density_relation", I.with_ctes(
    ["pixels"],
    LAB + " SELECT image_id, least(7, CAST(floor(least(1e0, greatest(0e0, ll))*8) AS INT)) AS step, count(*) AS n, "
    "round(avg(ch), 6) AS mean_chroma FROM lch GROUP BY ALL",
))
def density_relation(spark, sf):
    return T.density_relation(I.pixels(spark, sf)).select("image_id", "step", "n", *r6(mean_chroma="mean_chroma"))


@register("density_slope", I.with_ctes(
    ["pixels"], LAB + " SELECT image_id, round(regr_slope(ch, ll), 5) AS density_slope FROM lch GROUP BY image_id"
))
def density_slope(spark, sf):
    return T.density_slope(I.pixels(spark, sf)).select("image_id", F.round("density_slope", 5).alias("density_slope"))


@register("class_stats", I.with_ctes(
    ["pixels"],
    LAB + """, m AS (SELECT *, CASE WHEN y < 5 THEN 'sky' ELSE 'ground' END AS class, (x % 4)/4e0 AS w, (image_id % 10)/10e0 AS conf FROM lab)
    SELECT image_id, class, round(sum(w), 6) AS mass, round(sum(w*ll)/sum(w), 6) AS l, round(sum(w*la)/sum(w), 6) AS a,
      round(sum(w*lb_)/sum(w), 6) AS b FROM m WHERE conf >= 0.5 GROUP BY ALL""",
))
def class_stats(spark, sf):
    px = I.pixels(spark, sf)
    masks = px.selectExpr(
        "image_id", "x", "y", "CASE WHEN y < 5 THEN 'sky' ELSE 'ground' END AS class",
        "(x % 4) / 4D AS w", "(image_id % 10) / 10D AS confidence",
    )
    return T.class_stats(px, masks).select("image_id", "class", *r6(mass="mass", l="l", a="a", b="b"))


@register("paired_class_stats", I.with_ctes(
    ["pixels"],
    LAB + """, m AS (SELECT *, CASE WHEN y < 5 THEN 'sky' ELSE 'ground' END AS class FROM lab WHERE NOT (y < 5 AND image_id % 3 = 0))
    , c AS (SELECT image_id, class, avg(ll) AS l, avg(la) AS a, avg(lb_) AS b FROM m GROUP BY ALL)
    SELECT t.image_id AS target_id, r.image_id AS ref_id, t.class, round(t.l, 6) AS target_l, round(t.a, 6) AS target_a, round(t.b, 6) AS target_b,
      round(r.l, 6) AS ref_l, round(r.a, 6) AS ref_a, round(r.b, 6) AS ref_b
    FROM c t JOIN c r ON r.image_id = t.image_id + 1 AND t.class = r.class""",
))
def paired_class_stats(spark, sf):
    """Neighbouring photos, by class; every third photo has no sky."""
    px = I.pixels(spark, sf)
    masks = px.selectExpr("image_id", "x", "y", "CASE WHEN y < 5 THEN 'sky' ELSE 'ground' END AS class", "1D AS w", "1D AS confidence")
    stats = T.class_stats(px, masks.filter("NOT (class = 'sky' AND image_id % 3 = 0)"))
    pairs = I.photos(spark, sf).select(F.col("image_id").alias("target_id"), (F.col("image_id") + 1).alias("ref_id"))
    out = T.paired_class_stats(stats, stats, pairs)
    return out.select("target_id", "ref_id", "class", *r6(**{f"{p}_{c}": f"{p}_{c}" for p in ("target", "ref") for c in "lab"}))


@register("wb_eyedropper", I.with_ctes(
    ["photos", "pixels"],
    """, s AS (SELECT image_id AS sample_id, image_id, 2 + image_id % 9 AS x, 3 + image_id % 5 AS y FROM photos)
    SELECT sample_id, s.image_id, count(*) AS n, round(median(r), 6) AS r, round(median(g), 6) AS g, round(median(b), 6) AS b
    FROM s JOIN pixels p ON s.image_id = p.image_id AND abs(p.x-s.x) <= 4 AND abs(p.y-s.y) <= 4 GROUP BY ALL""",
))
def wb_eyedropper(spark, sf):
    samples = I.photos(spark, sf).selectExpr(
        "image_id AS sample_id", "image_id", "cast(2 + image_id % 9 as int) AS x", "cast(3 + image_id % 5 as int) AS y"
    )
    return T.wb_eyedropper(I.pixels(spark, sf), samples).select("sample_id", "image_id", "n", *r6(r="r", g="g", b="b"))


def _features():
    """All features as one SQL table ``ft`` (in WITH clauses)."""
    near = "ch < 0.04 AND ll BETWEEN 0.2 AND 0.9"
    med = lambda c: f"median(CASE WHEN {near} THEN floor({c}*10000e0+0.5e0) END)/10000e0"
    cols = [f"quantile_cont(v, {p})/10000e0 AS p{round(p * 100):02d}" for p in T.QUANTILES]
    for n, c in T.HUE_BANDS.items():
        w = f"(ch*greatest(0e0, 1e0-least(abs(hue-{c}e0), 360e0-abs(hue-{c}e0))/45e0))"
        cols += [
            f"nullif(sum({w}), 0e0) AS {n}_mass",
            f"CASE WHEN sum({w}) > 0 THEN fmod(degrees(atan2(sum({w}*sin(radians(hue))), sum({w}*cos(radians(hue)))))+360e0, 360e0) END AS {n}_hue",
            f"sum({w}*ch)/nullif(sum({w}), 0e0) AS {n}_chroma", f"sum({w}*ll)/nullif(sum({w}), 0e0) AS {n}_lightness",
        ]
    l1 = "least(1e0, greatest(0e0, ll))"
    zones = {"shadow": f"((1e0-{l1})*(1e0-{l1}))", "mid": f"greatest(0e0, 1e0-abs({l1}-0.5e0)*2e0)", "high": f"({l1}*{l1})"}
    for z, w in zones.items():
        cols += [f"sum({w}*la)/nullif(sum({w}), 0e0) AS {z}_a", f"sum({w}*lb_)/nullif(sum({w}), 0e0) AS {z}_b"]
    cols += [f"{med('la')} AS neutral_a", f"{med('lb_')} AS neutral_b", f"count(*) FILTER (WHERE {near})/count(*) AS neutral_confidence",
             "regr_slope(ch, ll) AS density_slope"]
    return I.with_ctes(
        ["pixels"],
        LAB + f", lv AS (SELECT *, CAST(2126*r+7152*g+722*b AS DOUBLE) AS v FROM lch), f0 AS (SELECT image_id, {', '.join(cols)} FROM lv GROUP BY image_id)"
        ", ft AS (SELECT *, p90-p10 AS robust_contrast, p05-p01 AS toe, p99-p95 AS shoulder FROM f0)",
    )


_NAMES = [
    *[f"p{round(p * 100):02d}" for p in T.QUANTILES], "robust_contrast", "toe", "shoulder",
    *[f"{n}_{k}" for n in T.HUE_BANDS for k in ("mass", "hue", "chroma", "lightness")],
    *[f"{z}_{a}" for z in ("shadow", "mid", "high") for a in "ab"], "neutral_a", "neutral_b", "neutral_confidence", "density_slope",
]
FEATURES = _features()
_DIGITS = {n: 4 if n.endswith("_hue") else 5 if n == "density_slope" else 6 for n in _NAMES}
ROUNDED = f"SELECT image_id, {', '.join(f'round({n}, {d}) AS {n}' for n, d in _DIGITS.items())} FROM ft"


def rounded_features(spark, sf):
    return T.look_features(I.pixels(spark, sf)).select("image_id", *[F.round(n, d).alias(n) for n, d in _DIGITS.items()])


@register("look_features", FEATURES + " " + ROUNDED)
def look_features(spark, sf):
    return rounded_features(spark, sf)


_SHIFTS = {"red": (10.0, 0.2, 0.0), "blue": (-15.0, -0.5, 0.1), "green": (0.0, 0.3, -0.1)}
_W = lambda c: f"greatest(0e0, 1e0-least(abs(hue-{c}e0), 360e0-abs(hue-{c}e0))/45e0)"
_part = lambda i, by: " + ".join(f"{_W(T.HUE_BANDS[n])}*({v[i]}e0{by})" for n, v in _SHIFTS.items())
_enc = lambda c: (
    f"CAST(floor(255e0*(CASE WHEN least(1e0,greatest(0e0,{c})) <= 0.0031308e0 THEN least(1e0,greatest(0e0,{c}))*12.92e0 "
    f"ELSE 1.055e0*pow(least(1e0,greatest(0e0,{c})), {1/2.4!r}e0)-0.055e0 END)+0.5e0) AS INT)"
)


def _mixer_sql(by=""):
    from lumatable.functions.color import LAB_TO_LMS, LMS_TO_RGB

    return I.with_ctes(
        ["pixels"],
        LAB + f""", sh AS (SELECT image_id, x, y, radians(hue + {_part(0, by)}) AS h2, ch*greatest(0e0, 1e0+{_part(1, by)}) AS c2, ll*greatest(0e0, 1e0+{_part(2, by)}) AS l2 FROM lch)
        , ab AS (SELECT *, c2*cos(h2) AS a2, c2*sin(h2) AS b2 FROM sh)
        , q AS (SELECT *, {', '.join(f"pow({_row(m, ['l2', 'a2', 'b2'])}, 3) AS q{i}" for i, m in enumerate(LAB_TO_LMS))} FROM ab)
        , o AS (SELECT image_id, x, y, {', '.join(f"{_row(m, ['q0', 'q1', 'q2'])} AS out_{c}" for c, m in zip('rgb', LMS_TO_RGB))} FROM q)
        SELECT image_id, x, y, {', '.join(f"{_enc('out_' + c)} AS {c}" for c in 'rgb')} FROM o""",
    )


@register("color_mixer", _mixer_sql())
def color_mixer(spark, sf):
    return T.color_mixer(I.pixels(spark, sf).select("image_id", "x", "y", "r", "g", "b"), _SHIFTS)


@register("color_mixer_by_photo", _mixer_sql("*(image_id % 3)/2e0"))
def color_mixer_by_photo(spark, sf):
    """Photos differ in the strength of the setting; every third has none."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("band"), *[(F.lit(v) * (F.col("image_id") % 3) / 2.0).alias(c) for c, v in zip(("hue", "chroma", "lightness"), three)])
        for n, three in _SHIFTS.items()
    ])
    shifts = I.photos(spark, sf).filter("image_id % 3 <> 0").select("image_id", F.explode(rows).alias("s")).select("image_id", "s.*")
    return T.color_mixer(I.pixels(spark, sf).select("image_id", "x", "y", "r", "g", "b"), shifts)


_ss = lambda lo, hi, v: f"(least(1e0,greatest(0e0,({v}-{lo}e0)/({hi}e0-{lo}e0))))"
_sm = lambda lo, hi, v: f"({_ss(lo, hi, v)}*{_ss(lo, hi, v)}*(3e0-2e0*{_ss(lo, hi, v)}))"
_pl = lambda e, v: f"{_sm(e[0], e[1], v)}*(1e0-{_sm(e[2], e[3], v)})"


@register("skin_vibrance", I.with_ctes(
    ["pixels"],
    LAB + f""", s AS (SELECT *, (1e0-{_sm(0.0, T.SKIN_WIDTH, f"least(abs(hue-{T.SKIN_HUE}e0), 360e0-abs(hue-{T.SKIN_HUE}e0))")})
      * {_pl(T.SKIN_CHROMA, 'ch')} * {_pl(T.SKIN_LIGHTNESS, 'll')} AS skin FROM lch)
    SELECT image_id, x, y, round(skin, 6) AS skin, round((1e0-least(1e0, ch/0.3e0))*(1e0-skin), 6) AS vibrance_weight FROM s""",
))
def skin_vibrance(spark, sf):
    return T.skin_vibrance_weight(I.pixels(spark, sf)).select(
        "image_id", "x", "y", *r6(skin="skin", vibrance_weight="vibrance_weight")
    )


@register("gamut_compression", I.with_ctes(
    ["pixels"],
    f""", l AS (SELECT image_id, x, y, ({_dec('r')})*1.8e0 AS lr, ({_dec('g')})*1.2e0-0.05e0 AS lg, ({_dec('b')})*0.9e0 AS lb FROM pixels)
    , y AS (SELECT *, least(1e0, greatest(0e0, 0.2126e0*lr+0.7152e0*lg+0.0722e0*lb)) AS yy FROM l)
    , xx AS (SELECT *, greatest((greatest(lr,lg,lb)-yy)/greatest(1e-9,1e0-yy), (yy-least(lr,lg,lb))/greatest(1e-9,yy)) AS k FROM y)
    , s AS (SELECT *, CASE WHEN k <= 0.9e0 THEN 1e0 ELSE (0.9e0+(1e0-0.9e0)*(1e0-exp((0.9e0-k)/(1e0-0.9e0))))/k END AS s FROM xx)
    SELECT image_id, x, y, {', '.join(f"round(least(1e0, greatest(0e0, yy+({c}-yy)*s)), 6) AS {c}" for c in ('lr', 'lg', 'lb'))} FROM s""",
))
def gamut_compression(spark, sf):
    px = with_linear(I.pixels(spark, sf)).select(
        "image_id", "x", "y", (F.col("lr") * 1.8).alias("lr"),
        (F.col("lg") * 1.2 - 0.05).alias("lg"), (F.col("lb") * 0.9).alias("lb"),
    )
    return T.compress_gamut(px).select("image_id", "x", "y", *r6(lr="lr", lg="lg", lb="lb"))
