"""Mask, tile and quality queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable.functions.color import luma_709
from lumatable.operators import grade as G, masks as M, quality as Q, stats as T, tiles

from . import inputs as I
from .stats import LAB, r6

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


_ss = lambda lo, hi, v: f"least(1e0,greatest(0e0,(({v})-({lo}))/(({hi})-({lo}))))"
_sm = lambda lo, hi, v: f"({_ss(lo, hi, v)}*{_ss(lo, hi, v)}*(3e0-2e0*{_ss(lo, hi, v)}))"


def framed(spark, sf):
    return I.pixels(spark, sf).join(I.photos(spark, sf).select("image_id", "width", "height"), "image_id")


_FR = ", fr AS (SELECT p.*, f.width AS w0, f.height AS h0 FROM pixels p JOIN photos f ON p.image_id = f.image_id)"


@register("linear_gradient_mask", I.with_ctes(
    ["photos", "pixels"],
    _FR + f""", t AS (SELECT *, ((x/greatest(1,w0-1)-0.2e0)*0.6e0+(y/greatest(1,h0-1)-0.1e0)*0.5e0)/(0.6e0*0.6e0+0.5e0*0.5e0) AS t FROM fr)
    SELECT image_id, x, y, round({_sm('0e0', '1e0', 't')}, 6) AS w FROM t""",
))
def linear_gradient_mask(spark, sf):
    px = G.normalized_coordinates(framed(spark, sf))
    return M.linear_gradient(px, (0.2, 0.1), (0.8, 0.6)).select("image_id", "x", "y", *r6(w="w"))


@register("luminance_range_mask", I.with_ctes(
    ["pixels"],
    f""", l AS (SELECT *, (0.2126e0*r+0.7152e0*g+0.0722e0*b)/255e0 AS l FROM pixels)
    SELECT image_id, x, y, round({_sm('0.2e0', '0.3e0', 'l')}*(1e0-{_sm('0.7e0', '0.9e0', 'l')}), 6) AS w FROM l""",
))
def luminance_range_mask(spark, sf):
    luma = luma_709(F.col("r"), F.col("g"), F.col("b")) / 255.0
    return I.pixels(spark, sf).select(
        "image_id", "x", "y", F.round(M.luminance_range(luma, 0.3, 0.7, 0.1, 0.2), 6).alias("w")
    )


@register("color_range_mask", I.with_ctes(
    ["pixels"],
    LAB + f""", s AS (SELECT image_id, ll AS sl, la AS sa, lb_ AS sb FROM lab WHERE y = 2 AND x IN (3, 7))
    , d AS (SELECT l.image_id, l.x, l.y, min(sqrt((ll-sl)*(ll-sl)+(la-sa)*(la-sa)+(lb_-sb)*(lb_-sb))) AS d FROM lab l JOIN s ON l.image_id = s.image_id GROUP BY ALL)
    SELECT image_id, x, y, round(1e0-{_sm('0.05e0', '0.25e0', 'd')}, 6) AS w FROM d""",
))
def color_range_mask(spark, sf):
    px = T.perceptual(I.pixels(spark, sf))
    samples = px.filter("y = 2 AND x IN (3, 7)").select(
        "image_id", F.col("lab_l").alias("sample_l"), F.col("lab_a").alias("sample_a"), F.col("lab_b").alias("sample_b")
    )
    return M.color_range(px, samples, 0.05, 0.2).select("image_id", "x", "y", *r6(w="w"))


_DABS = [
    "image_id", "CAST(n % 3 AS INT) AS stroke", "CAST((image_id * 7 + n * 5) % 14 AS DOUBLE) AS x",
    "CAST((image_id * 3 + n * 4) % 11 AS DOUBLE) AS y", "CAST(2 + n % 3 AS DOUBLE) AS radius",
    "0.5e0 AS feather", "0.8e0 AS flow", "CASE WHEN n % 2 = 0 THEN 0.7e0 ELSE 1e0 END AS density", "n % 3 = 1 AS erase",
]


@register("brush_mask", I.with_ctes(
    ["photos"],
    f""", dabs AS (SELECT {', '.join(_DABS)} FROM (SELECT image_id, CAST(n AS INT) AS n FROM photos, range(0,8) t(n)))
    , grid AS (SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM photos, range(0,17) a(x), range(0,17) b(y) WHERE x < width AND y < height)
    , v AS (SELECT g.image_id, g.x, g.y, stroke, erase,
        max(least(density, flow*(1e0-{_sm('1e0-feather', '1e0', 'sqrt((g.x-d.x)*(g.x-d.x)+(g.y-d.y)*(g.y-d.y))/radius')}))) AS v
      FROM grid g JOIN dabs d ON g.image_id = d.image_id AND abs(g.x-d.x) <= radius AND abs(g.y-d.y) <= radius GROUP BY ALL HAVING v > 0)
    , p AS (SELECT image_id, x, y, coalesce(max(v) FILTER (stroke = 0), 0e0) AS p0, coalesce(max(v) FILTER (stroke = 1), 0e0) AS e1,
        coalesce(max(v) FILTER (stroke = 2), 0e0) AS p2 FROM v GROUP BY ALL)
    SELECT image_id, x, y, round(greatest(p0*(1e0-e1), p2), 6) AS w FROM p""",
))
def brush_mask(spark, sf):
    photos = I.photos(spark, sf)
    dabs = photos.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("n")).selectExpr(*_DABS)
    return M.brush_mask(photos, dabs).select("image_id", "x", "y", *r6(w="w"))


_NODES = "'add', 'subtract', 'intersect', 'add'"


@register("mask_algebra", I.with_ctes(
    ["pixels"],
    """, w AS (SELECT image_id, x, y, r/255e0 AS a, g/255e0 AS b, b/255e0 AS c, (x % 3)/3e0 AS d FROM pixels)
    , s AS (SELECT *, a*(1e0-b)*c AS m FROM w)
    SELECT image_id, x, y, round(least(1e0, greatest(0e0, m+d-m*d)), 6) AS w FROM s""",
))
def mask_algebra(spark, sf):
    nodes = I.pixels(spark, sf).selectExpr(
        "image_id", "x", "y",
        "stack(4, 0, 'intersect', r / 255D, 1, 'subtract', g / 255D, 2, 'intersect', b / 255D, 3, 'add', (x % 3) / 3D) AS (ord, op, w)",
    )
    return M.mask_algebra(nodes).select("image_id", "x", "y", *r6(w="w"))


@register("local_composite", I.with_ctes(
    ["pixels"],
    " SELECT image_id, x, y, "
    + ", ".join(f"CAST(floor({c}*(1e0-w)+(255-{c})*w+0.5e0) AS INT) AS {c}" for c in "rgb")
    + ", x % 7 <> 6 AS matched FROM (SELECT *, CASE WHEN x % 5 = 4 OR x % 7 = 6 THEN 0e0 ELSE (x % 5)/4e0 END AS w FROM pixels)",
))
def local_composite(spark, sf):
    px = I.pixels(spark, sf)
    # the adjusted version lacks some pixels, the mask others
    inverted = px.filter("x % 7 <> 6").select("image_id", "x", "y", *[(255 - F.col(c)).alias(c) for c in "rgb"])
    mask = px.filter("x % 5 <> 4").select("image_id", "x", "y", ((F.col("x") % 5) / 4.0).alias("w"))
    return M.local_composite(px, inverted, mask)


@register("strength_blend", I.with_ctes(
    ["pixels"],
    " SELECT image_id, x, y, "
    + ", ".join(f"CASE WHEN t = 0 OR y % 6 = 5 THEN {c} ELSE CAST(floor({c}+((255-{c})-{c})*t+0.5e0) AS INT) END AS {c}" for c in "rgb")
    + ", y % 6 <> 5 AS matched FROM (SELECT *, (image_id % 5)/4e0 AS t FROM pixels)",
))
def strength_blend(spark, sf):
    px = I.pixels(spark, sf)
    inverted = px.filter("y % 6 <> 5").select("image_id", "x", "y", *[(255 - F.col(c)).alias(c) for c in "rgb"])
    return M.strength_blend(px, inverted, (F.col("image_id") % 5) / 4.0)


_by = lambda e: f"CAST(floor({e}+0.5e0) AS INT)"
_GREY = "(0.2126e0*r+0.7152e0*g+0.0722e0*b)"


@register("mask_overlay", I.with_ctes(
    ["pixels"],
    f""", m AS (SELECT *, (x % 4)/3e0 AS w FROM pixels)
    SELECT image_id, x, y, 'red' AS mode, {_by('r+(255e0-r)*w/2e0')} AS r, {_by('g*(1e0-w/2e0)')} AS g, {_by('b*(1e0-w/2e0)')} AS b FROM m
    UNION ALL SELECT image_id, x, y, 'white_on_black', {_by('w*255e0')}, {_by('w*255e0')}, {_by('w*255e0')} FROM m
    UNION ALL SELECT image_id, x, y, 'black_on_white', {_by('(1e0-w)*255e0')}, {_by('(1e0-w)*255e0')}, {_by('(1e0-w)*255e0')} FROM m
    UNION ALL SELECT image_id, x, y, 'grayscale', {_by(_GREY + '*w')}, {_by(_GREY + '*w')}, {_by(_GREY + '*w')} FROM m""",
))
def mask_overlay(spark, sf):
    px = I.pixels(spark, sf).withColumn("w", (F.col("x") % 4) / 3.0)
    out = None
    for mode in M.OVERLAYS:
        part = M.overlay(px, mode).select("image_id", "x", "y", F.lit(mode).alias("mode"), "r", "g", "b")
        out = part if out is None else out.unionByName(part)
    return out


@register("image_quality", I.with_ctes(
    ["frames"],
    """, j AS (SELECT image_id, CAST(v AS DOUBLE) AS u, CAST(least(255, v + (x*3+y*5+image_id) % 7) AS DOUBLE) AS t FROM frames)
    , s AS (SELECT image_id, avg(u) AS mu, avg(t) AS mt, avg(u*u)-avg(u)*avg(u) AS vu, avg(t*t)-avg(t)*avg(t) AS vt,
        avg(u*t)-avg(u)*avg(t) AS cov, avg((u-t)*(u-t)) AS mse, count(*) FILTER (WHERE abs(u-t) <= 2)/count(*) AS wt FROM j GROUP BY image_id)
    SELECT image_id, round(mse, 6) AS mse, round(10e0*log10(65025e0/mse), 6) AS psnr,
      round((2e0*mu*mt+6.5025e0)*(2e0*cov+58.5225e0)/((mu*mu+mt*mt+6.5025e0)*(vu+vt+58.5225e0)), 6) AS ssim,
      round(wt, 6) AS within_tolerance, CAST(0 AS BIGINT) AS unmatched FROM s""",
))
def image_quality(spark, sf):
    a = I.frames(spark, sf)
    b = a.withColumn("v", F.expr("least(255, v + (x * 3 + y * 5 + image_id) % 7)"))
    q = Q.image_quality(a, b)
    return q.select("image_id", *r6(**{c: c for c in q.columns if c not in ("image_id", "unmatched")}), "unmatched")


@register("image_quality_blocks", I.with_ctes(
    ["pixels"],
    """, j AS (SELECT image_id, x // 8 AS bx, y // 8 AS bu, CAST(r AS DOUBLE) AS u,
        CASE WHEN (x + y + image_id) % 13 <> 0 THEN CAST(least(255, r + (x*3+y*5+image_id) % 7) AS DOUBLE) END AS t FROM pixels)
    , s AS (SELECT image_id, bx, bu, count(t) AS n, count(*) FILTER (WHERE t IS NULL) AS lost, avg(u) FILTER (WHERE t IS NOT NULL) AS mu, avg(t) AS mt,
        avg(u*u) FILTER (WHERE t IS NOT NULL) AS muu, avg(t*t) AS mtt, avg(u*t) AS mut, sum((u-t)*(u-t)) AS se, count(*) FILTER (WHERE abs(u-t) <= 2) AS wi FROM j GROUP BY ALL)
    , b AS (SELECT *, (2e0*mu*mt+6.5025e0)*(2e0*(mut-mu*mt)+58.5225e0)/((mu*mu+mt*mt+6.5025e0)*(muu-mu*mu+mtt-mt*mt+58.5225e0)) AS ssim FROM s)
    SELECT image_id, round(sum(se)/sum(n), 6) AS mse, round(10e0*log10(65025e0/(sum(se)/sum(n))), 6) AS psnr, round(avg(ssim), 6) AS ssim,
      round(sum(wi)/sum(n), 6) AS within_tolerance, CAST(sum(lost) AS BIGINT) AS unmatched FROM b GROUP BY image_id""",
))
def image_quality_blocks(spark, sf):
    """Several blocks per photo; the second version lacks some pixels."""
    a = I.pixels(spark, sf).select("image_id", "x", "y", F.col("r").alias("v"))
    b = a.filter("(x + y + image_id) % 13 <> 0").withColumn("v", F.expr("least(255, v + (x * 3 + y * 5 + image_id) % 7)"))
    q = Q.image_quality(a, b)
    return q.select("image_id", *r6(**{c: c for c in q.columns if c not in ("image_id", "unmatched")}), "unmatched")


@register("mask_quality_sparse", I.with_ctes(
    ["pixels"],
    """, m AS (SELECT image_id, x, y, CASE WHEN r >= 100 THEN r/255e0 ELSE 0e0 END AS p, CASE WHEN r >= 60 THEN least(255, r+40)/255e0 ELSE 0e0 END AS t FROM pixels)
    , nb AS (SELECT a.image_id, a.x, a.y, a.p, a.t, min(b.p) AS mp, min(b.t) AS mt
        FROM m a JOIN (SELECT image_id, x + dx AS x, y + dy AS y, p, t FROM m, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)) b
          ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y GROUP BY ALL)
    , e AS (SELECT *, CAST(p >= 0.5 AND mp < 0.5 AS INT) AS ep, CAST(t >= 0.5 AND mt < 0.5 AS INT) AS et FROM nb)
    SELECT image_id, round(sum(least(p,t))/sum(greatest(p,t)), 6) AS iou,
      CASE WHEN sum(ep+et) > 0 THEN round(2e0*sum(ep*et)/sum(ep+et), 6) END AS boundary_f FROM e GROUP BY image_id""",
))
def mask_quality_sparse(spark, sf):
    """Both masks hold their set pixels only."""
    px = I.pixels(spark, sf)
    pred = px.filter("r >= 100").selectExpr("image_id", "x", "y", "r / 255D AS w")
    truth = px.filter("r >= 60").selectExpr("image_id", "x", "y", "least(255, r + 40) / 255D AS w")
    out = Q.mask_quality(pred, truth, images=I.photos(spark, sf))
    return out.select("image_id", *r6(iou="iou", boundary_f="boundary_f"))


@register("mask_boundary_tolerance", I.with_ctes(
    ["frames"],
    """, m AS (SELECT image_id, x, y, v >= 140 AS p, (v + x*9 + y*5) % 256 >= 140 AS t FROM frames)
    , nb AS (SELECT a.image_id, a.x, a.y, a.p AND bool_or(NOT b.p) AS ep, a.t AND bool_or(NOT b.t) AS et
        FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.x-b.x)+abs(a.y-b.y) = 1 GROUP BY a.image_id, a.x, a.y, a.p, a.t)
    , h AS (SELECT a.image_id, a.x, a.y, a.ep, a.et, coalesce(bool_or(b.et), false) AS near_t, coalesce(bool_or(b.ep), false) AS near_p
        FROM nb a JOIN nb b ON a.image_id = b.image_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 2 GROUP BY ALL)
    , s AS (SELECT image_id, count(*) FILTER (ep) AS np, count(*) FILTER (et) AS nt,
        count(*) FILTER (ep AND near_t) AS hp, count(*) FILTER (et AND near_p) AS ht FROM h GROUP BY image_id)
    , f AS (SELECT image_id, np, nt, CASE WHEN np > 0 THEN CAST(hp AS DOUBLE)/np END AS pr, CASE WHEN nt > 0 THEN CAST(ht AS DOUBLE)/nt END AS re FROM s)
    SELECT image_id, round(pr, 6) AS precision, round(re, 6) AS recall, CASE WHEN np+nt > 0 THEN
      CASE WHEN coalesce(pr, 0)+coalesce(re, 0) > 0 THEN round(2e0*coalesce(pr, 0)*coalesce(re, 0)/(coalesce(pr, 0)+coalesce(re, 0)), 6) ELSE 0e0 END
      END AS boundary_f FROM f""",
))
def mask_boundary_tolerance(spark, sf):
    """Boundaries of two masks of a frame that may lie one step, also a diagonal one, apart."""
    px = I.frames(spark, sf)
    mask = lambda v: px.selectExpr("image_id", "x", "y", f"IF({v} >= 140, 1D, 0D) AS w")
    out = Q.boundary_score(mask("v"), mask("(v + x * 9 + y * 5) % 256"), tolerance=1.5)
    return out.select("image_id", *r6(precision="precision", recall="recall", boundary_f="boundary_f"))


_RADIAL = """, rm AS (SELECT p.image_id, p.x, p.y, q.maskFeather AS feather, p.image_id % 2 = 1 AS inv, q.mask AS m,
    x/greatest(1,w0-1) - q.mask.x AS dx, y/greatest(1,h0-1) - q.mask.y AS dy, -q.mask.rotation*pi()/180e0 AS ang FROM fr p JOIN recipes q ON p.image_id = q.image_id)
  , rd AS (SELECT *, (dx*cos(ang)-dy*sin(ang))/greatest(0.02e0, m.width/2e0) AS u, (dx*sin(ang)+dy*cos(ang))/greatest(0.02e0, m.height/2e0) AS v FROM rm)
  , rt AS (SELECT *, least(1e0, greatest(0e0, (sqrt(u*u+v*v)-1e0)/(greatest(0.02e0, feather/100e0*0.7e0)*2.2e0))) AS t FROM rd)
  , rw AS (SELECT image_id, x, y, CASE WHEN inv THEN t*t*(3e0-2e0*t) ELSE 1e0-t*t*(3e0-2e0*t) END AS w FROM rt)"""


@register("radial_mask", I.with_ctes(
    ["photos", "pixels", "recipes"], _FR + _RADIAL + " SELECT image_id, x, y, round(w, 6) AS w FROM rw"
))
def radial_mask(spark, sf):
    px = G.normalized_coordinates(framed(spark, sf)).join(
        I.recipes(spark, sf, ["maskFeather", "mask"]), "image_id"
    )
    out = M.radial_mask(px, F.col("mask"), F.col("maskFeather"), F.col("image_id") % 2 == 1)
    return out.select("image_id", "x", "y", *r6(w="w"))


_TREE = [  # node, parent, order, operation, inverted
    (1, None, 0, "add", False), (2, None, 1, "subtract", True), (3, 1, 0, "add", False), (4, 1, 1, "intersect", False),
    (5, 2, 0, "add", True), (6, 2, 1, "add", False),
]


@register("mask_tree", I.with_ctes(
    ["pixels"],
    """, w AS (SELECT image_id, x, y, r/255e0 AS n3, g/255e0 AS n4, 1e0 - b/255e0 AS n5, (x % 3)/3e0 AS n6 FROM pixels)
    , l AS (SELECT *, n3*n4 AS n1, 1e0 - (n5+n6-n5*n6) AS n2 FROM w)
    SELECT image_id, x, y, round(n1*(1e0-n2), 6) AS w FROM l""",
))
def mask_tree(spark, sf):
    tree = spark.createDataFrame(_TREE, "node_id long, parent_id long, ord int, op string, invert boolean")
    leaves = I.pixels(spark, sf).selectExpr(
        "image_id", "x", "y", "stack(4, 3L, r / 255D, 4L, g / 255D, 5L, b / 255D, 6L, (x % 3) / 3D) AS (node_id, w)"
    )
    return M.mask_tree(tree, leaves).select("image_id", "x", "y", *r6(w="w"))


@register("mask_quality", I.with_ctes(
    ["pixels"],
    """, m AS (SELECT image_id, x, y, r/255e0 AS p, least(255, r+40)/255e0 AS t FROM pixels)
    , nb AS (SELECT a.image_id, a.x, a.y, a.p, a.t, coalesce(min(b.p) FILTER (b.x IS NOT NULL), 1e0) AS mp, coalesce(min(b.t) FILTER (b.x IS NOT NULL), 1e0) AS mt
        FROM m a LEFT JOIN m b ON a.image_id = b.image_id AND abs(a.x-b.x)+abs(a.y-b.y) = 1 GROUP BY ALL)
    , e AS (SELECT *, CAST(p >= 0.5 AND mp < 0.5 AS INT) AS ep, CAST(t >= 0.5 AND mt < 0.5 AS INT) AS et FROM nb)
    SELECT image_id, round(sum(least(p,t))/sum(greatest(p,t)), 6) AS iou,
      CASE WHEN sum(ep+et) > 0 THEN round(2e0*sum(ep*et)/sum(ep+et), 6) END AS boundary_f FROM e GROUP BY image_id""",
))
def mask_quality(spark, sf):
    px = I.pixels(spark, sf)
    pred = px.selectExpr("image_id", "x", "y", "r / 255D AS w")
    truth = px.selectExpr("image_id", "x", "y", "least(255, r + 40) / 255D AS w")
    return Q.mask_quality(pred, truth).select("image_id", *r6(iou="iou", boundary_f="boundary_f"))


@register("tile_with_halo", I.with_ctes(
    ["photos", "pixels"],
    _FR + """ SELECT image_id, CAST(tx AS INT) AS tile_x, CAST(ty AS INT) AS tile_y, count(*) AS n,
      count(*) FILTER (x // 6 = tx AND y // 6 = ty) AS n_interior, CAST(sum(x*31+y) AS BIGINT) AS position_sum
    FROM fr, range(0,3) a(tx), range(0,3) b(ty)
    WHERE x BETWEEN tx*6-2 AND tx*6+7 AND y BETWEEN ty*6-2 AND ty*6+7 AND tx*6 < w0 AND ty*6 < h0 GROUP BY ALL""",
))
def tile_with_halo(spark, sf):
    t = tiles.tile_with_halo(framed(spark, sf), 6, 2)
    return t.groupBy("image_id", "tile_x", "tile_y").agg(
        F.count("*").alias("n"), F.count_if("is_interior").alias("n_interior"),
        F.sum(F.col("x") * 31 + F.col("y")).alias("position_sum"),
    )


@register("blend_tiles", I.with_ctes(
    ["frames"],
    """, t AS (SELECT image_id, x, y, v + tx*3 + ty AS v, least(x-tx*3+1, 5-(x-tx*3))*least(y-ty*3+1, 5-(y-ty*3)) AS w
      FROM frames, range(0,2) a(tx), range(0,2) b(ty) WHERE x BETWEEN tx*3 AND tx*3+4 AND y BETWEEN ty*3 AND ty*3+4)
    SELECT image_id, x, y, round(sum(CAST(w AS DOUBLE)*v)/sum(w), 6) AS v FROM t GROUP BY ALL""",
))
def blend_tiles(spark, sf):
    origin = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    t = I.frames(spark, sf).withColumn("o", origin).selectExpr(
        "image_id", "x", "y", "o.i * 3 AS tile_x0", "o.j * 3 AS tile_y0", "v + o.i * 3 + o.j AS v"
    ).filter("x BETWEEN tile_x0 AND tile_x0 + 4 AND y BETWEEN tile_y0 AND tile_y0 + 4")
    return tiles.blend_tiles(t, 5).select("image_id", "x", "y", *r6(v="v"))


@register("island_cleanup", I.with_ctes(
    ["frames"],
    """, m AS (SELECT image_id, x, y, v FROM frames WHERE v >= 140)
    , reach AS (SELECT image_id, x, y, y*8+x AS root FROM m
        UNION SELECT m.image_id, m.x, m.y, r.root FROM reach r JOIN m ON m.image_id = r.image_id AND abs(m.x-r.x)+abs(m.y-r.y) = 1)
    , comp AS (SELECT image_id, x, y, min(root) AS root FROM reach GROUP BY ALL)
    , big AS (SELECT image_id, root FROM comp GROUP BY ALL HAVING count(*) >= 4)
    SELECT c.image_id, c.x, c.y FROM comp c JOIN big b ON c.image_id = b.image_id AND c.root = b.root
    UNION ALL SELECT image_id, x, y FROM frames WHERE v < 140""",
    recursive=True,
))
def island_cleanup(spark, sf):
    mask = I.frames(spark, sf).withColumn("w", F.col("v").cast("double"))
    return M.island_cleanup(mask, 4, threshold=140.0).select("image_id", "x", "y")
