"""Grading queries and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumatable import schema as S
from lumatable.functions.color import byte_to_linear, linear_to_srgb
from lumatable.functions.numeric import half_up, smoothstep
from lumatable.functions.recipe import sort_curve
from lumatable.operators import geometry, grade as G
from lumatable.plans.joins import join_large
from lumatable.plans.session import checkpoint_dir
from lumatable.sources import renditions as R

from . import inputs as I

BYTES = ["image_id", "x", "y", "r", "g", "b", "a"]


def _graded(keys):
    def run(spark, sf):
        return G.grade(I.pixels(spark, sf), I.photos(spark, sf), I.recipes(spark, sf, keys))

    return run


def tone_ctes(keys, source="framed"):
    """CTEs from ``source`` (image_id,x,y,r,g,b,a,w,h) to ``toned``; absent keys are neutral."""
    val = lambda k: f"q.{k}" if k in keys else f"{S.ADJUSTMENT_DEFAULTS[k]}e0"
    mask = {
        k: (f"q.mask.{k}" if "mask" in keys else f"{S.MASK_DEFAULTS[k]}e0")
        for k in S.MASK_DEFAULTS
    }
    neutral = " AND ".join(
        [f"q.{k} = {S.ADJUSTMENT_DEFAULTS[k]}e0" for k in S.KEYS if k in keys]
        + (["len(list_filter(q.curve, lambda p: abs(p.y - p.x) > 1e-4)) = 0"] if "curve" in keys else [])
    ) or "TRUE"
    decode = lambda c: (
        f"CASE WHEN {c}/255e0 <= 0.04045e0 THEN {c}/255e0/12.92e0 "
        f"ELSE pow(({c}/255e0 + 0.055e0)/1.055e0, 2.4e0) END"
    )
    clamp = lambda e: f"least(1e0, greatest(0e0, {e}))"
    encode = lambda e: (
        f"CASE WHEN {clamp(e)} <= 0.0031308e0 THEN {clamp(e)}*12.92e0 "
        f"ELSE 1.055e0*pow({clamp(e)}, {1/2.4!r}e0) - 0.055e0 END"
    )

    def region(amount, weight, strength):
        return ", ".join(
            f"CASE WHEN {amount} >= 0 THEN {c} + (1e0-{c})*{amount}*{weight}*{strength} "
            f"ELSE {c}*(1e0+{amount}*{weight}*{strength}) END AS {c}"
            for c in ("lr", "lg", "lb")
        )

    rest = lambda *names: "* EXCLUDE (" + ", ".join(names) + ")"
    lin = ("lr", "lg", "lb")

    if "curve" in keys:
        # first point with v <= x decides; its left neighbour starts the segment
        def curve(v):
            hi = f"list_filter(pts, lambda p: {v} <= p.x)[1]"
            lo = f"pts[len(pts) - len(list_filter(pts, lambda p: {v} <= p.x))]"
            return (
                f"CASE WHEN len(pts) = 0 THEN {v} WHEN {v} <= pts[1].x THEN pts[1].y "
                f"WHEN {v} > pts[len(pts)].x THEN pts[len(pts)].y "
                f"ELSE {lo}.y + ({hi}.y - {lo}.y)*(({v} - {lo}.x)/greatest(1e-4, {hi}.x - {lo}.x)) END"
            )

        curved = ", ".join(f"{curve(c)} AS {c}" for c in lin)
    else:
        curved = ", ".join(f"{c} AS {c}" for c in lin)

    return f"""
, tone0 AS (
  SELECT s.image_id, s.x, s.y, s.r, s.g, s.b, s.a, s.w, s.h,
    ({neutral}) AS neutral,
    {'list_sort(list_transform(q.curve, lambda p: {"x": p.x, "y": p.y}))' if 'curve' in keys else 'NULL'} AS pts,
    pow(2e0, {val('exposure')}) AS gain, pow(2e0, {val('contrast')}/55e0) AS con,
    least(1e0, greatest(-1e0, ({val('temperature')}-6500e0)/4500e0)) AS warm, {val('tint')}/100e0 AS tint,
    1e0+{val('saturation')}/100e0 AS sat, {val('vibrance')}/100e0 AS vib, {val('clarity')}/100e0 AS cla,
    pow(2e0, {val('maskExposure')}) AS mgain,
    greatest(0.02e0, {val('maskFeather')}/100e0*0.7e0) AS feather,
    {val('vignette')}/100e0 AS vig, {val('lensBrightness')}/100e0 AS lens,
    {val('shadows')}/100e0 AS sh, {val('highlights')}/100e0 AS hi, {val('whites')}/100e0 AS wh, {val('blacks')}/100e0 AS bl,
    {val('noiseReduction')}/100e0 AS nr, {val('sharpness')}/100e0 AS sharp,
    s.x/greatest(1, s.w-1) AS nx, s.y/greatest(1, s.h-1) AS ny,
    {mask['x']} AS mx, {mask['y']} AS my, {mask['width']} AS mw, {mask['height']} AS mh,
    -({mask['rotation']})*pi()/180e0 AS ang
  FROM {source} s JOIN recipes q ON s.image_id = q.image_id)
, tone1 AS (SELECT *,
    ((nx-mx)*cos(ang) - (ny-my)*sin(ang))/greatest(0.02e0, mw/2e0) AS u,
    ((nx-mx)*sin(ang) + (ny-my)*cos(ang))/greatest(0.02e0, mh/2e0) AS v,
    least(1e0, sqrt((nx-0.5e0)*(nx-0.5e0)+(ny-0.5e0)*(ny-0.5e0))/0.707e0) AS d FROM tone0)
, tone2 AS (SELECT *, {clamp('(sqrt(u*u+v*v) - 1e0)/((1e0+feather*2.2e0) - 1e0)')} AS t FROM tone1)
, tone3 AS MATERIALIZED (SELECT *, gain*(1e0+(mgain-1e0)*(1e0 - t*t*(3e0-2e0*t)))*(1e0+lens*d*d*0.65e0-vig*d*d*0.78e0) AS k FROM tone2)
, tone4 AS (SELECT *, ({decode('r')})*(k*(1e0+warm*0.22e0+tint*0.08e0)) AS lr,
    ({decode('g')})*(k*(1e0-tint*0.1e0)) AS lg, ({decode('b')})*(k*(1e0-warm*0.22e0+tint*0.08e0)) AS lb FROM tone3)
, tone5 AS (SELECT *, 0.2627e0*lr+0.678e0*lg+0.0593e0*lb AS lum FROM tone4)
, tone6 AS MATERIALIZED (SELECT *, {clamp('lum')} AS c1, {clamp('(lum-0.55e0)/(1e0-0.55e0)')} AS tw, {clamp('(lum-0e0)/(0.42e0-0e0)')} AS tb FROM tone5)
, tone7 AS (SELECT {rest(*lin)}, {region('sh', '((1e0-c1)*(1e0-c1))', '0.72e0')} FROM tone6)
, tone8 AS (SELECT {rest(*lin)}, {region('hi', '(c1*c1)', '0.72e0')} FROM tone7)
, tone9 AS (SELECT {rest(*lin)}, {region('wh', '(tw*tw*(3e0-2e0*tw))', '0.62e0')} FROM tone8)
, tone10 AS (SELECT {rest(*lin)}, {region('bl', '(1e0-tb*tb*(3e0-2e0*tb))', '0.62e0')} FROM tone9)
, tone11 AS MATERIALIZED (SELECT {rest(*lin)}, {', '.join(f"0.18e0+({c}-0.18e0)*(con*(1e0+cla*greatest(0e0, 1e0-abs(c1-0.5e0)*2e0)*0.65e0)) AS {c}" for c in lin)} FROM tone10)
, tone12 AS (SELECT {rest(*lin)}, {', '.join(f"{encode(c)} AS {c}" for c in lin)} FROM tone11)
, tone13 AS (SELECT {rest(*lin)}, {curved} FROM tone12)
, tone14 AS MATERIALIZED (SELECT *, 0.2126e0*lr+0.7152e0*lg+0.0722e0*lb AS yy, greatest(lr,lg,lb)-least(lr,lg,lb) AS ch FROM tone13)
, toned AS MATERIALIZED (SELECT image_id, x, y, w, h, neutral, nr, sharp, a,
    {', '.join(f"CASE WHEN neutral THEN {b} ELSE CAST(floor({clamp(f'yy+({c}-yy)*greatest(0e0, sat*(1e0+vib*(1e0-ch)*0.8e0))')}*255e0+0.5e0) AS INT) END AS {b}" for b, c in zip('rgb', lin))}
  FROM tone14)"""


FRAMED = ", framed AS (SELECT p.*, f.width AS w, f.height AS h FROM pixels p JOIN photos f ON p.image_id = f.image_id)"

ROTATED = """
, geo AS (SELECT f.image_id, f.width AS w, f.height AS h, q.rotation AS rot,
    CAST(((CAST(q.rotation AS INT) % 360) + 360) % 360 AS INT) AS turn, q.flipHorizontal AS fh, q.flipVertical AS fv
  FROM photos f JOIN recipes q ON f.image_id = q.image_id)
, geo2 AS (SELECT *, cos(turn*pi()/180e0) AS co, sin(turn*pi()/180e0) AS si,
    CASE WHEN turn % 180 = 0 THEN w WHEN turn % 90 = 0 THEN h
         ELSE CAST(ceil(abs(w*cos(turn*pi()/180e0)) + abs(h*sin(turn*pi()/180e0))) AS INT) END AS ow,
    CASE WHEN turn % 180 = 0 THEN h WHEN turn % 90 = 0 THEN w
         ELSE CAST(ceil(abs(w*sin(turn*pi()/180e0)) + abs(h*cos(turn*pi()/180e0))) AS INT) END AS oh
  FROM geo)
, grid AS (SELECT g.*, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM geo2 g, range(0,26) tx(x), range(0,26) ty(y) WHERE x < ow AND y < oh)
, flipped AS (SELECT *, CASE WHEN fh = 1 THEN ow-1-x ELSE x END AS fx, CASE WHEN fv = 1 THEN oh-1-y ELSE y END AS fy FROM grid)
, src AS (SELECT *,
    CASE turn WHEN 0 THEN fx WHEN 90 THEN fy WHEN 180 THEN w-1-fx WHEN 270 THEN w-1-fy
      ELSE CAST(floor(w/2e0 + ((fx+0.5e0-ow/2e0)*co + (fy+0.5e0-oh/2e0)*si)) AS INT) END AS sx,
    CASE turn WHEN 0 THEN fy WHEN 90 THEN h-1-fx WHEN 180 THEN h-1-fy WHEN 270 THEN fx
      ELSE CAST(floor(h/2e0 + ((fy+0.5e0-oh/2e0)*co - (fx+0.5e0-ow/2e0)*si)) AS INT) END AS sy
  FROM flipped)
, framed AS (SELECT s.image_id, s.x, s.y, coalesce(p.r,0) AS r, coalesce(p.g,0) AS g, coalesce(p.b,0) AS b,
    coalesce(p.a,0) AS a, s.ow AS w, s.oh AS h
  FROM src s LEFT JOIN pixels p ON s.image_id = p.image_id AND s.sx = p.x AND s.sy = p.y)"""

# every touched pixel is added to its nine neighbours
DETAIL = """
, near AS (SELECT o.image_id, o.x + dx AS x, o.y + dy AS y, o.r, o.g, o.b
  FROM toned o, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE o.nr <> 0 OR o.sharp <> 0)
, sums AS (SELECT image_id, x, y, {sums}, count(*) AS n FROM near GROUP BY ALL)
, den AS (SELECT t.*, s.n, {means}, {den} FROM toned t LEFT JOIN sums s USING (image_id, x, y))
SELECT image_id, x, y, a, {out} FROM den"""


def detail_sql():
    sums = ", ".join(f"sum({c}) AS s{c}" for c in "rgb")
    means = ", ".join(f"s{c}/9e0 AS m{c}" for c in "rgb")
    den = ", ".join(
        f"CASE WHEN nr >= 0 THEN {c}*(1e0-nr*0.9e0)+s{c}/9e0*nr*0.9e0 "
        f"ELSE {c}+({c}-s{c}/9e0)*(-nr)*0.9e0 END AS d{c}"
        for c in "rgb"
    )
    sharp = lambda c: (
        f"CASE WHEN sharp >= 0 THEN d{c}+(d{c}-m{c})*sharp*3.2e0 ELSE d{c}*(1e0+sharp)+m{c}*(-sharp) END"
    )
    out = ", ".join(
        f"CASE WHEN neutral OR coalesce(n, 0) < 9 THEN {c} ELSE "
        f"CAST(floor(least(255e0, greatest(0e0, {sharp(c)}))+0.5e0) AS INT) END AS {c}"
        for c in "rgb"
    )
    return DETAIL.format(sums=sums, means=means, den=den, out=out)


def _tone_sql(keys):
    return I.with_ctes(
        ["photos", "recipes", "pixels"],
        FRAMED + tone_ctes(keys) + f" SELECT {', '.join(BYTES)} FROM toned",
    )


STAGES = {
    "grade_exposure": ["exposure"],
    "grade_white_balance": ["temperature", "tint"],
    "grade_radial_mask": ["maskExposure", "maskFeather", "mask"],
    "grade_vignette": ["vignette", "lensBrightness"],
    "grade_tone_regions": ["shadows", "highlights", "whites", "blacks"],
    "grade_contrast_clarity": ["contrast", "clarity"],
    "grade_tone_curve": ["curve"],
    "grade_vibrance_saturation": ["vibrance", "saturation"],
}
GEOMETRY_KEYS = ["rotation", "flipHorizontal", "flipVertical"]
DETAIL_KEYS = ["sharpness", "noiseReduction"]
ALL_KEYS = S.KEYS + ["curve", "mask"]
TONE_KEYS = [k for k in ALL_KEYS if k not in GEOMETRY_KEYS + DETAIL_KEYS]

QUERIES = {name: _graded(keys) for name, keys in STAGES.items()}
ORACLE = {name: _tone_sql(keys) for name, keys in STAGES.items()}

QUERIES["grade_tone_full"] = _graded(TONE_KEYS)
ORACLE["grade_tone_full"] = _tone_sql(TONE_KEYS)

QUERIES["detail_filter"] = _graded(DETAIL_KEYS)
ORACLE["detail_filter"] = I.with_ctes(
    ["photos", "recipes", "pixels"], FRAMED + tone_ctes(DETAIL_KEYS) + detail_sql()
)


def rotate_flip(spark, sf):
    dims = G.render_table(I.photos(spark, sf), I.recipes(spark, sf, GEOMETRY_KEYS))
    turned = geometry.rotate_flip(I.pixels(spark, sf), dims)
    return turned.select(*BYTES, F.col("width").alias("w"), F.col("height").alias("h"))


QUERIES["rotate_flip"] = rotate_flip
ORACLE["rotate_flip"] = I.with_ctes(
    ["photos", "recipes", "pixels"], ROTATED + f" SELECT {', '.join(BYTES)}, w, h FROM framed"
)

def rotate_bilinear(spark, sf):
    dims = G.render_table(I.photos(spark, sf), I.recipes(spark, sf, GEOMETRY_KEYS))
    turned = geometry.rotate_smooth(I.pixels(spark, sf), dims)
    return turned.select(*BYTES, F.col("width").alias("w"), F.col("height").alias("h"))


_SMOOTH = ", ".join(f"CAST(floor(round(sum(wt*p.{c})/sum(wt), 6) + 0.5e0) AS INT) AS {c}" for c in "rgba")
QUERIES["rotate_bilinear"] = rotate_bilinear
ORACLE["rotate_bilinear"] = I.with_ctes(
    ["photos", "recipes", "pixels"],
    ROTATED + f"""
, places AS (SELECT image_id, x, y, w/2e0 + ((fx+0.5e0-ow/2e0)*co + (fy+0.5e0-oh/2e0)*si) - 0.5e0 AS px,
    h/2e0 + ((fy+0.5e0-oh/2e0)*co - (fx+0.5e0-ow/2e0)*si) - 0.5e0 AS py
  FROM src WHERE turn % 90 <> 0 AND sx BETWEEN 0 AND w-1 AND sy BETWEEN 0 AND h-1)
, taps AS (SELECT image_id, x, y, CAST(floor(px) AS INT) + dx AS tx, CAST(floor(py) AS INT) + dy AS ty,
    (1e0-abs(px-(floor(px)+dx)))*(1e0-abs(py-(floor(py)+dy))) AS wt
  FROM places, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
, smooth AS (SELECT t.image_id, t.x, t.y, {_SMOOTH} FROM taps t JOIN pixels p ON p.image_id = t.image_id AND p.x = tx AND p.y = ty
  WHERE wt > 0 GROUP BY ALL)
SELECT image_id, x, y, {", ".join(f"coalesce(s.{c}, f.{c}) AS {c}" for c in "rgba")}, w, h
FROM framed f LEFT JOIN smooth s USING (image_id, x, y)""",
)

QUERIES["grade_full"] = _graded(ALL_KEYS)
ORACLE["grade_full"] = I.with_ctes(
    ["photos", "recipes", "pixels"], ROTATED + tone_ctes(ALL_KEYS) + detail_sql()
)


def incremental_render(spark, sf):
    """A stored table, rendered with other recipes for every fifth photo and without some, brought up to date."""
    path = f"{checkpoint_dir(spark)}/renditions-{uuid.uuid4().hex}"
    px, images, now = I.pixels(spark, sf), I.photos(spark, sf), I.recipes(spark, sf, ["exposure"])
    before = now.withColumn("exposure", F.expr("exposure + CASE WHEN image_id % 5 = 2 THEN 0.5D ELSE 0D END"))
    R.refresh_renditions(path, px, images.filter("image_id % 40 <> 7"), before)
    R.refresh_renditions(path, px, images, now)
    return R.read_renditions(spark, path)


QUERIES["incremental_render"] = incremental_render
ORACLE["incremental_render"] = ORACLE["grade_exposure"]


def attach_recipe(spark, sf):
    even = I.recipes(spark, sf).filter("image_id % 2 = 0")
    joined = G.attach_recipe(I.pixels(spark, sf), I.photos(spark, sf), even)
    return joined.select(
        "image_id", "x", "y", F.round("kg.gain", 9).alias("gain"), F.col("k.neutral").alias("k_neutral")
    )


QUERIES["attach_recipe"] = attach_recipe
ORACLE["attach_recipe"] = I.with_ctes(
    ["recipes", "pixels"],
    """ SELECT p.image_id, x, y, round(pow(2e0, coalesce(exposure, 0e0)), 9) AS gain,
      q.image_id IS NULL OR q.image_id % 5 = 0 AS k_neutral
    FROM pixels p LEFT JOIN (SELECT * FROM recipes WHERE image_id % 2 = 0) q ON p.image_id = q.image_id""",
)


def neutral_short_circuit(spark, sf):
    """Per photo: is the recipe neutral, and how many pixels did rendering change?"""
    px, images, rec = I.pixels(spark, sf), I.photos(spark, sf), I.recipes(spark, sf, ["exposure", "curve"])
    diff = G.compare_renditions(px, G.grade(px, images, rec))
    flags = G.render_table(images, rec).select("image_id", F.col("k.neutral").alias("k_neutral"))
    return join_large(diff, flags, "image_id").select("image_id", "k_neutral", "changed")


QUERIES["neutral_short_circuit"] = neutral_short_circuit
ORACLE["neutral_short_circuit"] = I.with_ctes(
    ["photos", "recipes", "pixels"],
    FRAMED + tone_ctes(["exposure", "curve"])
    + """ SELECT t.image_id, t.neutral AS k_neutral,
      count(*) FILTER (WHERE t.r <> p.r OR t.g <> p.g OR t.b <> p.b) AS changed
    FROM toned t JOIN pixels p USING (image_id, x, y) GROUP BY ALL""",
)


def transfer_curves(spark, sf):
    px = I.pixels(spark, sf)
    lin = byte_to_linear("r")
    return px.select(
        "image_id", "x", "y",
        F.round(lin, 9).alias("linear"),
        half_up(linear_to_srgb(lin) * 255.0).alias("byte"),
        F.round(smoothstep(F.lit(0.1), F.lit(0.8), lin), 9).alias("step"),
    )


QUERIES["transfer_curves"] = transfer_curves
ORACLE["transfer_curves"] = I.with_ctes(
    ["pixels"],
    """, l AS (SELECT *, CASE WHEN r/255e0 <= 0.04045e0 THEN r/255e0/12.92e0
        ELSE pow((r/255e0+0.055e0)/1.055e0, 2.4e0) END AS lin FROM pixels)
    , t AS (SELECT *, least(1e0, greatest(0e0, (lin-0.1e0)/(0.8e0-0.1e0))) AS t FROM l)
    SELECT image_id, x, y, round(lin, 9) AS linear, r AS byte, round(t*t*(3e0-2e0*t), 9) AS step FROM t""",
)


def normalized_coordinates(spark, sf):
    px = I.pixels(spark, sf).join(I.photos(spark, sf).select("image_id", "width", "height"), "image_id")
    return G.normalized_coordinates(px).select(
        "image_id", "x", "y", F.round("nx", 9).alias("nx"), F.round("ny", 9).alias("ny")
    )


QUERIES["normalized_coordinates"] = normalized_coordinates
ORACLE["normalized_coordinates"] = I.with_ctes(
    ["photos", "pixels"],
    FRAMED + " SELECT image_id, x, y, round(x/greatest(1,w-1), 9) AS nx, round(y/greatest(1,h-1), 9) AS ny FROM framed",
)


def preview_downscale(spark, sf):
    return geometry.preview(I.pixels(spark, sf), I.photos(spark, sf), max_edge=9)


_PREVIEW = """
, pv AS (SELECT image_id, width, height, greatest(1, CAST(floor(width*least(1e0, 9e0/greatest(width,height))+0.5e0) AS INT)) AS pw,
    greatest(1, CAST(floor(height*least(1e0, 9e0/greatest(width,height))+0.5e0) AS INT)) AS ph FROM photos)
, small AS (SELECT p.image_id, CAST((x*pw)//width AS INT) AS x, CAST((y*ph)//height AS INT) AS y,
    {means} FROM pixels p JOIN pv ON p.image_id = pv.image_id GROUP BY ALL)""".format(
    means=", ".join(f"CAST(floor(sum({c})/count({c}) + 0.5e0) AS INT) AS {c}" for c in "rgba")
)
QUERIES["preview_downscale"] = preview_downscale
ORACLE["preview_downscale"] = I.with_ctes(
    ["photos", "pixels"], _PREVIEW + f" SELECT {', '.join(BYTES)} FROM small"
)


def grade_preview(spark, sf):
    return G.grade(
        I.pixels(spark, sf), I.photos(spark, sf), I.recipes(spark, sf, TONE_KEYS + DETAIL_KEYS), max_edge=9
    )


QUERIES["grade_preview"] = grade_preview
ORACLE["grade_preview"] = I.with_ctes(
    ["photos", "recipes", "pixels"],
    _PREVIEW
    + ", framed AS (SELECT s.*, pv.pw AS w, pv.ph AS h FROM small s JOIN pv ON s.image_id = pv.image_id)"
    + tone_ctes(TONE_KEYS + DETAIL_KEYS)
    + detail_sql(),
)


def pyramid(spark, sf):
    return geometry.pyramid(I.pixels(spark, sf), levels=3)


QUERIES["pyramid"] = pyramid
ORACLE["pyramid"] = I.with_ctes(
    ["pixels"],
    " SELECT image_id, CAST(l AS INT) AS level, CAST(x >> l AS INT) AS x, CAST(y >> l AS INT) AS y, "
    + ", ".join(f"CAST(floor(sum({c})/count({c}) + 0.5e0) AS INT) AS {c}" for c in "rgba")
    + " FROM (SELECT p.*, CAST(l AS INT) AS l FROM pixels p, range(0,4) t(l)) GROUP BY ALL",
)


def compare_renditions(spark, sf):
    px, images = I.pixels(spark, sf), I.photos(spark, sf)
    before = G.grade(px, images, G.default_recipes(images))
    after = G.grade(px, images, I.recipes(spark, sf, ["exposure"] + GEOMETRY_KEYS))
    return G.compare_renditions(before, after)


QUERIES["compare_renditions"] = compare_renditions
ORACLE["compare_renditions"] = I.with_ctes(
    ["photos", "recipes", "pixels"],
    ROTATED + tone_ctes(["exposure"] + GEOMETRY_KEYS) + """
    , j AS (SELECT image_id, b.r IS NOT NULL AND t.r IS NOT NULL AS hit,
        abs(t.r-b.r) AS dr, abs(t.g-b.g) AS dg, abs(t.b-b.b) AS db
      FROM pixels b FULL JOIN toned t USING (image_id, x, y))
    SELECT image_id, count(*) FILTER (WHERE hit) AS compared, count(*) FILTER (WHERE hit AND dr+dg+db > 0) AS changed,
      CAST(coalesce(sum(dr+dg+db), 0) AS BIGINT) AS sum_abs_diff,
      sum(dr+dg+db)::DOUBLE / (3 * count(*) FILTER (WHERE hit)) AS mean_abs_diff, max(greatest(dr,dg,db)) AS max_abs_diff,
      count(*) FILTER (WHERE NOT hit) AS unmatched FROM j GROUP BY image_id""",
)


def sort_curve_points(spark, sf):
    return I.recipes(spark, sf, ["curve"]).select(
        "image_id", F.posexplode(sort_curve(F.col("curve"))).alias("pos", "p")
    ).select("image_id", "pos", "p.id", "p.x", "p.y")


QUERIES["sort_curve_points"] = sort_curve_points
ORACLE["sort_curve_points"] = I.with_ctes(
    ["recipes"],
    """, e AS (SELECT image_id, unnest(curve) AS p FROM recipes)
    SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY p.x) - 1 AS INT) AS pos,
      p.id AS id, p.x AS x, p.y AS y FROM e""",
)
