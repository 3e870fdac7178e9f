"""Look, matching and capture queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable import schema as S
from lumatable.operators import capture as P, looks as L, stats as T
from lumatable.plans.session import cut_lineage

from . import inputs as I
from .stats import FEATURES, ROUNDED, r6, rounded_features

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


_OPEN = [k for k in S.KEYS if k not in L.PROTECTED]
_AXES = {"warm": "(p_partkey % 9 - 4) / 4e0", "airy": "(p_size % 5 - 2) / 2e0", "crisp": "(p_partkey % 7 - 3) / 3e0"}
_BASIS = [("warm", "saturation", 12.0), ("warm", "temperature", 800.0), ("airy", "shadows", 20.0),
          ("airy", "contrast", -15.0), ("crisp", "clarity", 18.0), ("warm*airy", "highlights", -8.0)]
_basis_sql = ", ".join(f"('{t}', '{p}', {w}e0)" for t, p, w in _BASIS)
_long = lambda src, keys: (
    f"SELECT image_id, unnest([{', '.join(repr(k) for k in keys)}]) AS param, "
    f"unnest([{', '.join(keys)}]) AS value FROM {src}"
)


@register("apply_look", I.with_ctes(
    ["recipes"],
    f""", ax AS (SELECT p_partkey AS image_id, {', '.join(f'{v} AS {k}' for k, v in _AXES.items())} FROM part)
    , t AS (SELECT image_id, unnest(['warm','airy','crisp','warm*airy']) AS term, unnest([warm, airy, crisp, warm*airy]) AS phi FROM ax)
    , d AS (SELECT image_id, param, sum(phi*weight) AS d FROM t JOIN (VALUES {_basis_sql}) b(term, param, weight) ON t.term = b.term
        WHERE param NOT IN ({', '.join(repr(k) for k in L.PROTECTED)}) GROUP BY ALL)
    , base AS ({_long('recipes', S.KEYS)})
    SELECT base.image_id, base.param, round(value + coalesce(d, 0e0), 6) AS value FROM base LEFT JOIN d ON base.image_id = d.image_id AND base.param = d.param""",
))
def apply_look(spark, sf):
    axes = I.table(spark, sf, "part").selectExpr("p_partkey AS image_id", *[f"{v} AS {k}" for k, v in _AXES.items()])
    basis = spark.createDataFrame(_BASIS, "term string, param string, weight double")
    base = L.long_recipes(I.recipes(spark, sf))
    return L.apply_look(L.cross_terms(axes, [("warm", "airy")]), basis, base).select("image_id", "param", *r6(value="value"))


@register("mix_styles", I.with_ctes(
    ["recipes"],
    f""", styles AS (SELECT image_id, param, unnest(['own', 'next']) AS style, unnest([1e0 + image_id % 3, 2e0]) AS weight,
        unnest([value, value*0.5e0 + 10e0]) AS value FROM ({_long('recipes', S.KEYS)}))
    SELECT image_id, param, round(CASE WHEN param = 'temperature' THEN exp(sum(CASE WHEN value > 0 THEN weight*ln(value) END)/sum(weight))
      WHEN param = 'rotation' THEN degrees(atan2(sum(weight*sin(radians(value))), sum(weight*cos(radians(value)))))
      WHEN param LIKE 'flip%' THEN first(value ORDER BY weight DESC, style) ELSE sum(weight*value)/sum(weight) END, 5) AS value
    FROM styles WHERE param NOT IN ('exposure', 'tint') GROUP BY image_id, param""",
))
def mix_styles(spark, sf):
    rows = L.long_recipes(I.recipes(spark, sf))
    styles = rows.selectExpr(
        "image_id", "param",
        "stack(2, 'own', 1D + image_id % 3, value, 'next', 2D, value * 0.5D + 10D) AS (style, weight, value2)",
    ).withColumnRenamed("value2", "value")
    mixed = L.mix_styles(styles, protected=["exposure", "tint"])
    return mixed.select("image_id", "param", F.round("value", 5).alias("value"))


@register("monotone_curve", I.with_ctes(
    ["frames"],
    """, s AS (SELECT image_id // 2 AS image_id, y*8+x AS pos, 1e0 + image_id % 2 AS weight, v AS yv FROM frames)
    , b AS (SELECT image_id, pos, sum(weight*yv)/sum(weight) AS yv FROM s GROUP BY ALL)
    SELECT image_id, pos, round(max(yv) OVER (PARTITION BY image_id ORDER BY pos), 6) AS y FROM b""",
))
def monotone_curve(spark, sf):
    samples = I.frames(spark, sf).selectExpr(
        "image_id div 2 AS image_id", "y * 8 + x AS pos", "1D + image_id % 2 AS weight", "v AS y"
    )
    return L.monotone_curve(samples).select("image_id", "pos", *r6(y="y"))


_COPY = ["exposure", "contrast", "saturation"]


@register("sync_recipes", I.with_ctes(
    ["recipes"],
    " SELECT d.image_id, "
    + ", ".join(f"CASE WHEN d.image_id % 4 <> 0 THEN s.{k} ELSE d.{k} END AS {k}" if k in _COPY else f"d.{k}" for k in S.KEYS)
    + " FROM recipes d JOIN recipes s ON s.image_id = d.image_id - d.image_id % 10",
))
def sync_recipes(spark, sf):
    targets = I.photos(spark, sf).filter("image_id % 4 <> 0").select(
        "image_id", (F.col("image_id") - F.col("image_id") % 10).alias("source_id"),
        F.array(*[F.lit(k) for k in _COPY]).alias("keys"),
    )
    return L.sync_recipes(I.recipes(spark, sf), targets).select("image_id", *S.KEYS)


_RANGES = " ".join(f"WHEN '{k}' THEN {hi - lo}e0" for k, (lo, hi) in S.ADJUSTMENT_RANGES.items())


@register("explain_changes", I.with_ctes(
    ["recipes"],
    f""", l AS ({_long('recipes', S.KEYS)})
    , d AS (SELECT image_id, param, CASE param {' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in S.ADJUSTMENT_DEFAULTS.items())} END AS old_value, value AS new_value FROM l)
    SELECT image_id, param, old_value, new_value, round(new_value-old_value, 6) AS delta,
      round(abs(new_value-old_value)/CASE param {_RANGES} END, 6) AS share FROM d WHERE new_value <> old_value""",
))
def explain_changes(spark, sf):
    from lumatable.operators.grade import default_recipes

    rec = I.recipes(spark, sf)
    out = L.explain_changes(default_recipes(rec.select("image_id")), rec)
    return out.select("image_id", "param", "old_value", "new_value", *r6(delta="delta", share="share"))


def _features_sql():
    lin = lambda c: f"pow(greatest({c}, 1e0)/255e0, 2.2e0)"
    mid = lambda p: f"({lin(p + '.p25')}+{lin(p + '.p50')}+{lin(p + '.p75')})/3e0"
    names = ", ".join(f"quantile_cont(v, {q})/10000e0 AS {n}" for n, q in (("p05", .05), ("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95)))
    knots = ["p05", "p25", "p50", "p75", "p95"]
    ctes, px, py = "", "0e0", "0e0"
    for i, n in enumerate(knots):
        x = f"least(1e0, t_{n}/255e0*pow(2e0, ex/2.2e0))"
        dx = f"({x}-{px})"
        y = f"least(1e0, {py}+least({dx}*4e0, greatest({dx}*0.25e0, r_{n}/255e0-{py})))"
        ctes += f", k{i} AS (SELECT *, {x} AS x{i}, {y} AS y{i} FROM {'m' if i == 0 else f'k{i - 1}'})"
        px, py = f"x{i}", f"y{i}"
    return I.with_ctes(
        ["pixels"],
        f""", q AS (SELECT image_id, {names} FROM (SELECT image_id, CAST(2126*r+7152*g+722*b AS DOUBLE) AS v FROM pixels) GROUP BY image_id)
        , m AS (SELECT t.image_id AS target_id, r.image_id AS ref_id, least(5e0, greatest(-5e0, log2({mid('r')}/({mid('t')})))) AS ex,
            {', '.join(f't.{n} AS t_{n}, r.{n} AS r_{n}' for n in knots)} FROM q t JOIN q r ON r.image_id = CASE WHEN t.image_id % 2 = 0 THEN t.image_id + 1 ELSE t.image_id - 1 END)
        {ctes} SELECT target_id, ref_id, round(ex, 6) AS exposure, {', '.join(f'round(y{i}, 6) AS y{i}' for i in range(5))} FROM k4""",
    )


def _pairs(spark, sf):
    return I.photos(spark, sf).selectExpr(
        "image_id AS target_id", "CASE WHEN image_id % 2 = 0 THEN image_id + 1 ELSE image_id - 1 END AS ref_id"
    )


@register("match_reference_tone", _features_sql())
def match_reference_tone(spark, sf):
    q = T.luma_quantiles(I.pixels(spark, sf)).select("image_id", "p05", "p25", "p50", "p75", "p95")
    features = q.withColumns(
        {"neutral_a": F.lit(0.0), "neutral_b": F.lit(0.0), "neutral_confidence": F.lit(0.0), "density_slope": F.lit(0.0)}
    )
    m = L.match_reference(_pairs(spark, sf), cut_lineage(features), "tone")
    return m.select(
        "target_id", "ref_id", *r6(exposure="exposure"),
        *[F.round(F.col("curve")[i + 1]["y"], 6).alias(f"y{i}") for i in range(5)],
    )


def _full_sql():
    """Steps on rounded features, so that both engines start from the same numbers.

    Differences are rounded to the digits of their features, which leaves no ties.
    """
    bounded = lambda v, lo, hi: f"least({hi}e0, greatest({lo}e0, {v}))"
    lin = lambda c: f"pow(greatest({c}, 1e0)/255e0, 2.2e0)"
    mid = lambda p: f"({lin(p + '.p25')}+{lin(p + '.p50')}+{lin(p + '.p75')})/3e0"
    sure = f"t.neutral_confidence >= {L.MIN_CONFIDENCE}e0 AND r.neutral_confidence >= {L.MIN_CONFIDENCE}e0"
    move = lambda a, g: f"CASE WHEN {sure} THEN coalesce((r.neutral_{a}-t.neutral_{a})*{g}, 0e0) ELSE 0e0 END"
    whole = {p: "(" + " + ".join(f"coalesce({p}.{n}_mass, 0e0)" for n in T.HUE_BANDS) + ")" for p in "tr"}
    held = lambda n: "least(" + ", ".join(f"coalesce({p}.{n}_mass/nullif({whole[p]}, 0e0), 0e0)" for p in "tr") + ")"
    cols = [
        f"round({bounded(f'log2({mid(chr(114))}/({mid(chr(116))}))', -5, 5)}, 4) AS exposure",
        f"round({bounded(move('b', '30000e0') + ' + 6500e0', 2000, 12000)}, 3) AS temperature",
        f"round({bounded(move('a', '1000e0'), -100, 100)}, 3) AS tint",
        f"round({bounded('coalesce(r.density_slope/nullif(t.density_slope, 0e0) - 1e0, 0e0)*25e0', -50, 50)}, 3) AS saturation",
    ]
    for n in T.HUE_BANDS:
        turn = f"fmod(fmod(r.{n}_hue-t.{n}_hue+180e0, 360e0)+360e0, 360e0)-180e0"
        ok = f"{held(n)} >= {L.BAND_SUPPORT}e0"
        cols.append(f"CASE WHEN {ok} THEN round({bounded(turn, -L.BAND_TURN, L.BAND_TURN)}, 4) END AS {n}_turn")
        gain = f"r.{n}_chroma/nullif(t.{n}_chroma, 0e0)-1e0"
        cols.append(f"CASE WHEN {ok} THEN round({bounded(gain, -L.BAND_GAIN, L.BAND_GAIN)}, 3) END AS {n}_gain")
    for z in L.ZONES:
        for a in "ab":
            cols.append(f"round({bounded(f'coalesce(r.{z}_{a}-t.{z}_{a}, 0e0)', -L.GRADE_LIMIT, L.GRADE_LIMIT)}, 6) AS {z}_{a}")
    return FEATURES + f""", f AS ({ROUNDED})
    SELECT t.image_id AS target_id, r.image_id AS ref_id, {', '.join(cols)}
    FROM f t JOIN f r ON r.image_id = CASE WHEN t.image_id % 2 = 0 THEN t.image_id + 1 ELSE t.image_id - 1 END"""


@register("match_reference_full", _full_sql())
def match_reference_full(spark, sf):
    features = cut_lineage(rounded_features(spark, sf))
    m = L.match_reference(_pairs(spark, sf), features, "full")
    band = lambda n, c: F.try_element_at(F.filter("bands", lambda b: b["band"] == n), F.lit(1))[c]
    zone = lambda i, a: F.col("grading")[i][a]
    return m.select(
        "target_id", "ref_id", F.round("exposure", 4).alias("exposure"),
        *[F.round(c, 3).alias(c) for c in ("temperature", "tint", "saturation")],
        *[F.round(band(n, c), d).alias(f"{n}_{c}") for n in T.HUE_BANDS for c, d in (("turn", 4), ("gain", 3))],
        *[F.round(zone(i, a), 6).alias(f"{z}_{a}") for i, z in enumerate(L.ZONES) for a in "ab"],
    )


@register("refine_exposure")
def refine_exposure(spark, sf):
    features = cut_lineage(rounded_features(spark, sf))
    return L.refine_exposure(L.match_reference(_pairs(spark, sf), features, "full"), features).select(
        "target_id", "ref_id", "exposure", "refined_exposure", "loss"
    )


@register("match_strength", I.with_ctes(
    ["recipes"],
    " SELECT image_id, round(exposure*0.6e0 + (exposure*0.5e0+1e0)*0.4e0, 6) AS exposure, "
    "round(exp(ln(temperature)*0.6e0 + ln(temperature*1.1e0)*0.4e0), 4) AS temperature, "
    "flipHorizontal, contrast, round(mask.x, 6) AS mask_x, "
    "CASE WHEN image_id % 3 = 0 THEN len(curve) ELSE 64 END::INTEGER AS n_points FROM recipes",
))
def match_strength(spark, sf):
    rec = I.recipes(spark, sf)
    matched = rec.select(
        "image_id", (F.col("exposure") * 0.5 + 1.0).alias("exposure"), (F.col("temperature") * 1.1).alias("temperature"),
        (1.0 - F.col("flipHorizontal")).alias("flipHorizontal"), F.expr("CASE WHEN image_id % 3 <> 0 THEN curve END").alias("curve"),
    )
    out = L.match_strength(rec, matched, 40)
    return out.select(
        "image_id", *r6(exposure="exposure"), F.round("temperature", 4).alias("temperature"), "flipHorizontal", "contrast",
        F.round("mask.x", 6).alias("mask_x"), F.size("curve").alias("n_points"),
    )


# a curve of the recipes at place x, by the definition of piecewise linear
_at = lambda c, x: (
    f"CASE WHEN {x} <= {c}[1].x THEN {c}[1].y WHEN {x} > {c}[len({c})].x THEN {c}[len({c})].y ELSE list_filter(list_transform(range(1, len({c})), "
    f"lambda i: CASE WHEN {x} > {c}[i].x AND {x} <= {c}[i+1].x THEN {c}[i].y + ({c}[i+1].y-{c}[i].y)*(({x}-{c}[i].x)/greatest(1e-4, {c}[i+1].x-{c}[i].x)) END), "
    "lambda y: y IS NOT NULL)[1] END"
)


@register("mix_curves", I.with_ctes(
    ["recipes"],
    f""", p AS (SELECT image_id, list_sort(list_transform(curve, lambda p: {{'x': p.x, 'y': p.y}})) AS c FROM recipes)
    , s AS (SELECT image_id, CAST(n AS INT) AS pos, {_at('c', '(n/63e0)')} AS y FROM p, range(0, 64) t(n))
    , m AS (SELECT image_id, pos, (3e0*y + (image_id % 4)*greatest(y, 0.5e0))/(3e0 + image_id % 4) AS y FROM s)
    SELECT image_id, pos, round(max(y) OVER (PARTITION BY image_id ORDER BY pos), 6) AS y FROM m""",
))
def mix_curves(spark, sf):
    """Each recipe's curve mixed with the upper half of it."""
    rec = I.recipes(spark, sf, ["curve"])
    lifted = L.curve_of_samples(F.transform(L.sample_curve(F.col("curve")), lambda y: F.greatest(y, F.lit(0.5))))
    styles = rec.select("image_id", F.lit(3.0).alias("weight"), "curve").unionByName(
        rec.select("image_id", (F.col("image_id") % 4).cast("double").alias("weight"), lifted.alias("curve"))
    )
    out = L.mix_curves(styles)
    return out.select("image_id", F.posexplode("curve").alias("pos", "p")).select("image_id", "pos", F.round("p.y", 6).alias("y"))


@register("closed_loop_report")
def closed_loop_report(spark, sf):
    return L.closed_loop_report(I.pixels(spark, sf), I.photos(spark, sf), I.recipes(spark, sf, ["exposure", "tint"]))


# --- capture ----------------------------------------------------------------


@register("resolve_profile", I.with_ctes(
    ["photos"],
    """, c AS (SELECT image_id, unnest(['decoder','camera_db','embedded']) AS source, unnest([3, 2, 1]) AS pr, unnest([image_id % 2 = 0, image_id % 3 = 0, image_id % 5 = 0]) AS valid FROM photos)
    , b AS (SELECT DISTINCT ON (image_id) image_id, source FROM c WHERE valid ORDER BY image_id, pr)
    , o AS (SELECT p.image_id, p.image_id % 7 = 0 AS rendered, CASE WHEN p.image_id % 7 <> 0 THEN b.source WHEN p.image_id % 2 = 0 THEN 'icc' END AS source
      FROM photos p LEFT JOIN b ON p.image_id = b.image_id)
    SELECT image_id, CASE WHEN source IS NULL AND rendered THEN 'fallback' ELSE source END AS source,
      CASE WHEN source IS NOT NULL THEN 'resolved' WHEN rendered THEN 'assumed' ELSE 'profile-required' END AS status,
      CASE WHEN source IS NULL AND rendered THEN 'no embedded profile, taken for srgb' END AS warning FROM o""",
))
def resolve_profile(spark, sf):
    # every seventh file is a rendered one, half of them with an ICC profile
    photos = I.photos(spark, sf).withColumn("rendered", F.col("image_id") % 7 == 0)
    cands = photos.selectExpr(
        "image_id",
        "stack(4, 'decoder', image_id % 2 = 0, 'camera_db', image_id % 3 = 0, 'embedded', image_id % 5 = 0, "
        "'icc', image_id % 2 = 0) AS (source, valid)",
    ).withColumn("profile_id", F.concat_ws("/", "source", "image_id"))
    return P.resolve_profile(photos, cands).select("image_id", "source", "status", "warning")


@register("changed_since_render", I.with_ctes(
    ["recipes"],
    """ SELECT image_id, CASE WHEN image_id % 4 = 0 THEN 'geometry' WHEN image_id % 4 = 1 THEN 'mask_raster' WHEN image_id % 4 = 2 THEN 'tone'
      END AS first_stale, image_id % 4 = 1 AS mask_stale FROM recipes WHERE image_id % 4 <> 3""",
))
def changed_since_render(spark, sf):
    # the last render saw other values for one key, depending on the photo
    rec = I.recipes(spark, sf)
    bump = lambda k, n: (F.col(k) + F.when(F.col("image_id") % 4 == n, 1.0).otherwise(0.0)).alias(k)
    changed = {"rotation": 0, "maskFeather": 1, "maskExposure": 2}
    before = rec.select(*[bump(c, changed[c]) if c in changed else F.col(c) for c in rec.columns])
    return P.changed_since_render(rec, P.stage_hashes(before))


_CELLS = {0: (2, 2, "RGGB"), 1: (2, 2, "GBRG"), 2: (6, 6, "GBGGRGRGRBGBGBGGRGGRGGBGBGBRGRGRGGBG"[:36])}


@register("cfa_label", I.with_ctes(
    ["pixels"],
    """, k AS (SELECT image_id, x, y, r, image_id % 4 AS cam FROM pixels)
    SELECT image_id, x, y, CASE cam """
    + " ".join(f"WHEN {c} THEN substr('{s}', CAST((y % {py})*{px} + x % {px} + 1 AS INT), 1)" for c, (px, py, s) in _CELLS.items())
    + " END AS channel, CASE WHEN cam = 3 THEN 'unknown-camera' ELSE 'ok' END AS cfa_status FROM k",
))
def cfa_label(spark, sf):
    patterns = spark.createDataFrame(
        [(c, px, py, list(s)) for c, (px, py, s) in _CELLS.items()],
        "camera long, period_x int, period_y int, cells array<string>",
    )
    # no pattern is known for camera 3
    raw = I.pixels(spark, sf).select("image_id", "x", "y", (F.col("image_id") % 4).alias("camera"))
    return P.cfa_label(raw, patterns).select("image_id", "x", "y", "channel", "cfa_status")


@register("normalize_mosaic", I.with_ctes(
    ["pixels"],
    """ SELECT image_id, x, y, CASE WHEN image_id % 4 < 3 THEN round((r - (10e0 + 2e0*(image_id % 4) + CASE WHEN y < 8 THEN 0e0 ELSE 1e0 END))
        / (250e0 - (10e0 + 2e0*(image_id % 4) + CASE WHEN y < 8 THEN 0e0 ELSE 1e0 END)), 6) END AS value,
        CASE WHEN image_id % 4 = 3 THEN 'no-level' ELSE 'ok' END AS level_status FROM pixels""",
))
def normalize_mosaic(spark, sf):
    levels = spark.createDataFrame(
        [(c, "R", 10.0 + 2.0 * c + b, 250.0, lo, hi) for c in range(3) for b, lo, hi in ((0.0, 0, 7), (1.0, 8, 31))],
        "camera long, channel string, black double, white double, row_from int, row_to int",
    )
    # there are no levels for camera 3
    raw = I.pixels(spark, sf).select(
        "image_id", "x", "y", (F.col("image_id") % 4).alias("camera"), F.lit("R").alias("channel"), F.col("r").alias("v")
    )
    return P.normalize_mosaic(raw, levels).select("image_id", "x", "y", *r6(value="value"), "level_status")


@register("normalize_mosaic_tiles", I.with_ctes(
    ["pixels"],
    """, t AS (SELECT *, x // (4 + image_id % 2) AS tx, y // (4 + image_id % 2) AS ty FROM pixels)
    , b AS (SELECT *, 8e0 + tx + 2e0*ty AS black, CASE WHEN tx = 2 AND ty = 0 THEN 10e0 ELSE 250e0 END AS white FROM t)
    SELECT image_id, x, y, CASE WHEN ty < 3 AND white <> black THEN round((r - black)/(white - black), 6) END AS value,
      CASE WHEN ty >= 3 THEN 'no-level' WHEN white = black THEN 'flat-level' ELSE 'ok' END AS level_status FROM b""",
))
def normalize_mosaic_tiles(spark, sf):
    """Black per sensor tile; cameras differ in tile size, one tile is flat, some have no level."""
    levels = spark.createDataFrame(
        [(c, "R", 8.0 + tx + 2 * ty, 10.0 if (tx, ty) == (2, 0) else 250.0, 4 + c, tx, ty) for c in (0, 1) for tx in range(5) for ty in range(3)],
        "camera long, channel string, black double, white double, tile_size int, tile_x int, tile_y int",
    )
    raw = I.pixels(spark, sf).select(
        "image_id", "x", "y", (F.col("image_id") % 2).alias("camera"), F.lit("R").alias("channel"), F.col("r").alias("v")
    )
    return P.normalize_mosaic(raw, levels).select("image_id", "x", "y", *r6(value="value"), "level_status")


_MODELS = [
    "doc_id AS model_id", "CASE WHEN doc_id % 6 = 0 THEN 'unknown' ELSE {sha} END AS sha256",
    "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat(source, '/', lang) END AS license_id",
]


@register("license_audit", (
    f"WITH m AS (SELECT {', '.join(_MODELS).format(sha='sha256(text)')} FROM documents) "
    ", c AS (SELECT concat(source, '/', lang) AS license_id, max(n_chars) > 4000 AS code, max(n_chars) > 6000 AS weights FROM documents GROUP BY 1) "
    ", g AS (SELECT * FROM m WHERE sha256 <> 'unknown' AND license_id IS NOT NULL) "
    "SELECT model_id, 'incomplete manifest' AS reason FROM m WHERE sha256 = 'unknown' OR license_id IS NULL "
    "UNION ALL SELECT model_id, 'code licence not cleared' FROM g WHERE license_id NOT IN (SELECT license_id FROM c WHERE code) "
    "UNION ALL SELECT model_id, 'weight licence not cleared' FROM g WHERE license_id NOT IN (SELECT license_id FROM c WHERE weights)"
))
def license_audit(spark, sf):
    docs = I.table(spark, sf, "documents")
    models = docs.selectExpr(*[m.format(sha="sha2(text, 256)") for m in _MODELS])
    longest = docs.groupBy(F.concat("source", F.lit("/"), "lang").alias("license_id")).agg(F.max("n_chars").alias("n"))
    clear = longest.selectExpr("license_id", "stack(2, 'code', n > 4000, 'weights', n > 6000) AS (scope, cleared)")
    return P.license_audit(models, clear.filter("cleared"))
