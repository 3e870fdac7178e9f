"""Small cases for the pixel stages, and a scalar witness written from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from lumatable import schema as S
from lumatable.operators import geometry, grade as G, masks, stats, tiles
from lumatable.operators.catalog import sanitize_recipe
from lumatable.functions.recipe import has_adjustments


def frame(spark, rows):
    """One image from rows of (r, g, b[, a]); returns (pixels, images)."""
    px = [
        (1, x, y, *v[:3], v[3] if len(v) > 3 else 255) for y, row in enumerate(rows) for x, v in enumerate(row)
    ]
    return (
        spark.createDataFrame(px, S.PIXELS),
        spark.createDataFrame([(1, len(rows[0]), len(rows))], "image_id long, width int, height int"),
    )


def recipe(spark, curve=None, mask=None, **values):
    points = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(curve)] if curve is not None else [tuple(p) for p in S.CURVE_DEFAULT]
    row = [1] + [float(values.get(k, v)) for k, v in S.ADJUSTMENT_DEFAULTS.items()]
    return spark.createDataFrame([(*row, points, mask or tuple(S.MASK_DEFAULTS.values()))], S.RECIPES)


def graded(spark, rows, tile=1024, **kw):
    px, im = frame(spark, rows)
    out = G.grade(px, im, recipe(spark, **kw), tile_size=tile).collect()
    return {(p["x"], p["y"]): (p["r"], p["g"], p["b"], p["a"]) for p in out}


PIXEL = [[(40, 80, 120)]]


def test_neutral_is_exact(spark):
    assert graded(spark, PIXEL)[0, 0] == (40, 80, 120, 255)


def test_exposure_brightens(spark):
    assert all(a > b for a, b in zip(graded(spark, PIXEL, exposure=1)[0, 0][:3], (40, 80, 120)))


def test_neutral_detection(spark):
    flag = lambda r: r.select(has_adjustments().alias("f")).first()["f"]
    assert not flag(recipe(spark)) and flag(recipe(spark, temperature=6000))


def test_tone_curve(spark):
    strip = [[(35, 35, 35), (128, 128, 128), (220, 220, 220)]]
    out = graded(spark, strip, curve=[(0, 0), (0.25, 0.5), (0.75, 0.5), (1, 1)])
    assert out[0, 0][0] > 35 and out[2, 0][0] < 220


def test_long_curve(spark):
    levels = list(range(0, 256, 15))
    curve = [(i / 20, (i / 20) ** 1.3) for i in range(21)]
    out = graded(spark, [[(v, v, v) for v in levels]], curve=curve)
    for x, v in enumerate(levels):
        nx = x / (len(levels) - 1)
        assert out[x, 0][:3] == scalar((v, v, v), nx, 0.0, S.ADJUSTMENT_DEFAULTS, curve, S.MASK_DEFAULTS)


def test_sharpen_edge(spark):
    rows = [[(80, 80, 80)] * 3, [(80, 80, 80), (160, 160, 160), (80, 80, 80)], [(80, 80, 80)] * 3]
    out = graded(spark, rows, sharpness=100)
    assert out[1, 1][0] > 160 and out[0, 0] == (80, 80, 80, 255)


def test_kelvin_warms(spark):
    r, _, b, _ = graded(spark, [[(100, 100, 100)]], temperature=10000)[0, 0]
    assert r > b


def test_histogram_scaled(spark):
    px, im = frame(spark, [[(0, 0, 0), (255, 255, 255)]])
    h = {r["bin"]: r["height"] for r in stats.luma_histogram(px, im, 8).collect()}
    assert max(h.values()) == 1 and h[0] > 0 and h[7] > 0 and len(h) == 8


def scalar(v, nx, ny, a, curve, mask):
    """One pixel through the tone stages, plain Python."""
    c01 = lambda t: min(1.0, max(0.0, t))
    step = lambda lo, hi, t: (lambda u: u * u * (3 - 2 * u))(c01((t - lo) / (hi - lo)))
    ang = -mask["rotation"] * math.pi / 180
    dx, dy = nx - mask["x"], ny - mask["y"]
    d = math.hypot(
        (dx * math.cos(ang) - dy * math.sin(ang)) / max(0.02, mask["width"] / 2),
        (dx * math.sin(ang) + dy * math.cos(ang)) / max(0.02, mask["height"] / 2),
    )
    inside = 1 - step(1, 1 + 2.2 * max(0.02, a["maskFeather"] / 100 * 0.7), d)
    e = min(1, math.hypot(nx - 0.5, ny - 0.5) / 0.707)
    gain = 2 ** a["exposure"] * (1 + (2 ** a["maskExposure"] - 1) * inside)
    gain *= 1 + 0.65 * a["lensBrightness"] / 100 * e * e - 0.78 * a["vignette"] / 100 * e * e
    warm, tint = min(1, max(-1, (a["temperature"] - 6500) / 4500)), a["tint"] / 100
    wb = (1 + 0.22 * warm + 0.08 * tint, 1 - 0.1 * tint, 1 - 0.22 * warm + 0.08 * tint)
    lin = [(b / 255 / 12.92 if b / 255 <= 0.04045 else ((b / 255 + 0.055) / 1.055) ** 2.4) * gain * w for b, w in zip(v, wb)]
    y = 0.2627 * lin[0] + 0.678 * lin[1] + 0.0593 * lin[2]
    c = c01(y)
    regions = (("shadows", (1 - c) ** 2, 0.72), ("highlights", c * c, 0.72),
               ("whites", step(0.55, 1, y), 0.62), ("blacks", 1 - step(0, 0.42, y), 0.62))
    for name, w, s in regions:
        m = a[name] / 100
        lin = [t + (1 - t) * m * w * s if m >= 0 else t * (1 + m * w * s) for t in lin]
    slope = 2 ** (a["contrast"] / 55) * (1 + a["clarity"] / 100 * max(0, 1 - 2 * abs(c - 0.5)) * 0.65)
    enc = []
    for t in lin:
        t = c01(0.18 + (t - 0.18) * slope)
        t = 12.92 * t if t <= 0.0031308 else 1.055 * t ** (1 / 2.4) - 0.055
        pts = sorted(curve)
        if t <= pts[0][0]:
            t = pts[0][1]
        elif t > pts[-1][0]:
            t = pts[-1][1]
        else:
            (x0, y0), (x1, y1) = next((p, q) for p, q in zip(pts, pts[1:]) if t <= q[0])
            t = y0 + (y1 - y0) * (t - x0) / max(1e-4, x1 - x0)
        enc.append(t)
    y = 0.2126 * enc[0] + 0.7152 * enc[1] + 0.0722 * enc[2]
    k = max(0, (1 + a["saturation"] / 100) * (1 + a["vibrance"] / 100 * (1 - (max(enc) - min(enc))) * 0.8))
    return tuple(math.floor(c01(y + (t - y) * k) * 255 + 0.5) for t in enc)


def test_scalar_witness(spark):
    a = dict(S.ADJUSTMENT_DEFAULTS, exposure=0.7, contrast=20, highlights=-40, shadows=35, whites=15, blacks=-25,
             temperature=7400, tint=12, vibrance=30, saturation=-15, clarity=25, maskExposure=0.8, maskFeather=35,
             vignette=40, lensBrightness=-20)
    curve = [(0, 0.02), (0.3, 0.25), (0.7, 0.8), (1, 1)]
    mask = {"x": 0.4, "y": 0.6, "width": 0.5, "height": 0.7, "rotation": 25.0}
    rows = [[((x * 37 + y * 11) % 256, (x * 5 + y * 53) % 256, (x * 91 + y * 7) % 256) for x in range(9)] for y in range(7)]
    out = graded(spark, rows, curve=curve, mask=tuple(mask.values()), **{k: v for k, v in a.items()})
    for y in range(7):
        for x in range(9):
            assert out[x, y][:3] == scalar(rows[y][x], x / 8, y / 6, a, curve, mask)


# pixels of sf0.1 and its copies that end exactly between two bytes, and what SQL gives
BETWEEN = [
    ((35, 171, 59), 0.0, -50.0, (85, 153, 97)),
    ((33, 115, 121), 0.0, 50.0, (0, 124, 133)),
    ((33, 115, 121), 0.0, 30.0, (13, 120, 128)),
    ((92, 228, 116), 0.0, -50.0, (142, 210, 154)),
    ((228, 220, 6), 0.0, 40.0, (237, 225, 0)),
]


@pytest.mark.parametrize("pixel, vibrance, saturation, want", BETWEEN)
def test_ends_between_two_bytes_as_in_sql(spark, pixel, vibrance, saturation, want):
    """The encoded value of an untouched byte decides these by its last bit, where Spark's own power differs."""
    kw = dict(vibrance=vibrance, saturation=saturation)
    assert scalar(pixel, 0.0, 0.0, S.ADJUSTMENT_DEFAULTS | kw, [(0, 0), (1, 1)], S.MASK_DEFAULTS) == want
    assert graded(spark, [[pixel]], **kw)[0, 0][:3] == want


def test_tiles_leave_no_seams(spark):
    rows = [[((x * 37 + y * 11) % 256, (x * 5 + y * 53) % 256, (x * 91 + y * 7) % 256) for x in range(13)] for y in range(11)]
    kw = dict(sharpness=60, noiseReduction=-30)
    assert graded(spark, rows, tile=4, **kw) == graded(spark, rows, **kw)


def test_holes_are_reported(spark):
    px, im = frame(spark, [[(9, 9, 9)] * 4 for _ in range(4)])
    holed = px.filter("NOT (x = 1 AND y = 1)")
    found = G.grid_gaps(holed, im).first()
    assert found["n_pixels"] == 15 and found["status"] == "incomplete" and G.grid_gaps(px, im).count() == 0
    assert G.grid_gaps(px, im.limit(0)).first()["status"] == "no-image-row"
    assert G.grid_gaps(px.limit(0), im).first()["status"] == "no-pixels"
    # the photo is still rendered; pixels beside the hole keep their values
    assert G.grade(holed, im, recipe(spark, sharpness=50)).count() == 15


def test_missing_bytes_stay_missing(spark):
    px, im = frame(spark, [[(9, 90, 200)] * 4 for _ in range(4)])
    torn = px.withColumn("g", F.when(F.col("x") != 2, F.col("g")))
    out = G.grade(torn, im, recipe(spark, exposure=1)).collect()
    assert {p["x"] for p in out if p["r"] is None or p["g"] is None} == {2}
    assert G.grid_gaps(torn, im).first()["n_pixels"] == 12


def test_four_quarter_turns(spark):
    px, im = frame(spark, [[(x * 9, y * 30, 7) for x in range(5)] for y in range(3)])
    start = {(r["x"], r["y"]): r["r"] * 1000 + r["g"] for r in px.collect()}
    for i in range(4):
        px = G.grade(px, im, recipe(spark, rotation=90))
        # break the lineage of the four renders into plain rows
        px = spark.createDataFrame(px.collect(), S.PIXELS)
        im = im.selectExpr("image_id", "height AS width", "width AS height")
        if i == 0:
            assert {(r["x"], r["y"]) for r in px.collect()} == {(x, y) for x in range(3) for y in range(5)}
    assert {(r["x"], r["y"]) : r["r"] * 1000 + r["g"] for r in px.collect()} == start


def test_free_angle_covers_the_frame_once(spark):
    px, im = frame(spark, [[(200, 100, 50)] * 12 for _ in range(8)])
    out = G.grade(px, im, recipe(spark, rotation=30)).collect()
    w = math.ceil(12 * math.cos(math.pi / 6) + 8 * 0.5)
    h = math.ceil(12 * 0.5 + 8 * math.cos(math.pi / 6))
    assert len(out) == w * h == len({(p["x"], p["y"]) for p in out})
    assert {p["a"] for p in out} == {0, 255}


def test_histogram_counts_every_pixel_unless_asked(spark):
    im = spark.createDataFrame([(1, 1000, 900)], "image_id long, width int, height int")
    px = geometry.full_grid(im).selectExpr("image_id", "x", "y", "x % 256 AS r", "0 AS g", "0 AS b", "255 AS a")
    assert stats.luma_histogram(px, im).agg(F.sum("n")).first()[0] == 900_000
    assert stats.luma_histogram(px, im, sample_target=300_000).agg(F.sum("n")).first()[0] == 300_000


def test_sanitize(spark):
    typed = recipe(spark, exposure=9, contrast=float("nan"), temperature=100)
    row = sanitize_recipe(typed, recipe(spark, contrast=33)).first()
    assert (row["exposure"], row["contrast"], row["temperature"]) == (5.0, 33.0, 2000.0)
    assert row["clamped_keys"] == ["exposure", "temperature"] and row["ignored_keys"] == ["contrast"]


def test_island_spiral(spark):
    on = [(1, x, 0) for x in range(20)] + [(1, 19, y) for y in range(1, 9)] + [(1, x, 8) for x in range(3, 19)]
    on += [(1, 0, 5), (1, 1, 5), (2, 0, 0)]
    m = spark.createDataFrame([(*p, 1.0) for p in on], "image_id int, x int, y int, w double")
    left = {(r["image_id"], r["x"], r["y"]) for r in masks.island_cleanup(m, 3).collect()}
    assert left == set(on[:-3])


def test_user_filter_per_tile(spark):
    px, im = frame(spark, [[(x, y, 0) for x in range(9)] for y in range(9)])
    schema = "image_id long, x int, y int, r int, is_interior boolean"

    def negative(pdf):
        out = pdf[["image_id", "x", "y", "r", "is_interior"]].copy()
        out["r"] = 255 - out["r"]
        return out

    got = tiles.apply_per_tile(px, negative, schema, size=4, halo=1, images=im).collect()
    assert len(got) == 81 and all(p["r"] == 255 - p["x"] for p in got)
