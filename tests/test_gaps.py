"""Missing bytes, missing rows and rows that contradict each other: what each operator makes of them."""

import math

import pytest
from pyspark.sql import functions as F

from lumatable.operators import catalog, editlog, grade as G, looks, masks, stats as T, tiles

PX = "image_id long, x int, y int, r int, g int, b int, a int"


@pytest.fixture(scope="module")
def frames(spark):
    whole = [(1, x, y, (x * 37 + y) % 256, (x * 11 + y * 53) % 256, (x * 3 + 90) % 256, 255) for x in range(9) for y in range(7)]
    gaps = [(1, 20 + k, 0, *bytes_, 255) for k, bytes_ in enumerate([(None, 1, 2), (3, None, 4), (250, 5, None), (None, None, None)])]
    images = spark.createDataFrame([(1, 9, 7)], "image_id long, width int, height int")
    return spark.createDataFrame(whole, PX), spark.createDataFrame(whole + gaps, PX), images


STATISTICS = {
    "luma_histogram": lambda px, im: T.luma_histogram(px, im, 8),
    "luma_histogram_sampled": lambda px, im: T.luma_histogram(px, im, 8, sample_target=20),
    "rgb_histogram": lambda px, im: T.rgb_histogram(px),
    "luma_quantiles": lambda px, im: T.luma_quantiles(px),
    "hue_band_stats": lambda px, im: T.hue_band_stats(px),
    "zone_centroids": lambda px, im: T.zone_centroids(px),
    "neutral_center": lambda px, im: T.neutral_center(px),
    "density_relation": lambda px, im: T.density_relation(px),
    "density_slope": lambda px, im: T.density_slope(px),
    "look_features": lambda px, im: T.look_features(px),
}


def rounded(df):
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(cell, r)) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", STATISTICS)
def test_statistics_are_those_of_the_whole_pixels(frames, name):
    whole, gaps, images = frames
    assert rounded(STATISTICS[name](gaps, images)) == rounded(STATISTICS[name](whole, images))


def test_class_stats_and_counts_with_gaps(spark, frames):
    whole, gaps, _ = frames
    mask = gaps.select("image_id", F.lit("sky").alias("class"), "x", "y", F.lit(0.5).alias("w"), F.lit(0.9).alias("confidence"))
    assert rounded(T.class_stats(gaps, mask)) == rounded(T.class_stats(whole, mask))
    assert T.gap_counts(gaps).collect() == [(1, 67, 4)]


def test_colour_stages_pass_missing_bytes_on(frames):
    whole, gaps, images = frames
    mixed = T.color_mixer(gaps, {"red": (10.0, 1.2, 1.0)})
    assert mixed.count() == gaps.count() and mixed.filter("r IS NULL AND g IS NULL AND b IS NULL").count() == 4
    assert rounded(mixed.filter("x < 9").select("x", "y", "r", "g", "b")) == rounded(T.color_mixer(whole, {"red": (10.0, 1.2, 1.0)}).select("x", "y", "r", "g", "b"))
    brighter = images.select("image_id", F.lit(0.7).alias("exposure"))
    assert G.grade(gaps, images, brighter).count() == gaps.count()


def test_quantiles_skip_missing_values(spark):
    px = spark.createDataFrame([(1, k, 0, v, v, v, 255) for k, v in enumerate((10, None, 10, 12))], PX)
    q = T.luma_quantiles(px).first()
    assert [round(q[c], 6) for c in ("p50", "p75", "p95")] == [10.0, 11.0, 11.8]


def test_class_confidence_is_that_of_the_class(spark, frames):
    whole, _, _ = frames
    conf = F.when(F.col("x") == 8, 0.3).otherwise(0.9)
    rows = lambda name, c: whole.select("image_id", F.lit(name).alias("class"), "x", "y", F.lit(1.0).alias("w"), c.alias("confidence"))
    mask = rows("sky", conf).unionByName(rows("skin", F.lit(0.9))).unionByName(rows("wall", F.when(F.col("x") > 0, 0.9)))
    assert [(r["class"], r["mass"]) for r in T.class_stats(whole, mask).collect()] == [("skin", 63.0)]


def test_tiles_blend_what_is_there(spark):
    rows = [(1, 2, 2, 0, 0, 10.0), (1, 2, 2, 1, 1, None), (1, 3, 3, 0, 0, None)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, tile_x0 int, tile_y0 int, v double")
    assert sorted(tuple(r) for r in tiles.blend_tiles(df, 8).collect()) == [(1, 2, 2, 10.0), (1, 3, 3, None)]


def test_styles_without_weight_or_value_do_not_weigh_in(spark):
    rows = [
        (1, "a", 3.0, "clarity_kind", 1.0), (1, "b", None, "clarity_kind", 0.0),
        (2, "a", 3.0, "clarity_kind", None), (2, "b", 1.0, "clarity_kind", 5.0),
        (3, "a", 0.0, "turn", 90.0), (3, "b", 0.0, "turn", 10.0), (4, "a", None, "turn", 90.0), (4, "b", 1.0, "turn", 10.0),
        (5, "a", 0.0, "clarity_kind", 1.0),
    ]
    df = spark.createDataFrame(rows, "image_id long, style string, weight double, param string, value double")
    kinds = looks.PARAM_KINDS
    before = dict(kinds)
    kinds.update(clarity_kind="category", turn="hue")
    try:
        got = {r["image_id"]: r["value"] for r in looks.mix_styles(df).collect()}
    finally:
        kinds.clear()
        kinds.update(before)
    assert got[1] == 1.0 and got[2] == 5.0 and got[3] is None and math.isclose(got[4], 10.0) and got[5] is None


def test_mask_nodes_without_their_parent_are_an_error(spark):
    tree = spark.createDataFrame([(1, None, 0, "add", False), (2, 9, 0, "add", False)], "node_id long, parent_id long, ord int, op string, invert boolean")
    rasters = spark.createDataFrame([(1, 1, 0, 0, 0.5), (2, 1, 0, 0, 0.9)], "node_id long, image_id long, x int, y int, w double")
    with pytest.raises(ValueError, match=r"\[2\]"):
        masks.mask_tree(tree, rasters)


def test_photos_without_samples_keep_their_pixels(spark):
    px = spark.createDataFrame([(1, 0, 0, 0.5, 0.1, 0.1), (2, 0, 0, 0.5, 0.1, 0.1)], "image_id long, x int, y int, lab_l double, lab_a double, lab_b double")
    samples = spark.createDataFrame([(1, 0.1, 0.1, 0.5)], "image_id long, sample_a double, sample_b double, sample_l double")
    assert {r["image_id"]: r["w"] for r in masks.color_range(px, samples, 0.1, 0.1).collect()} == {1: 1.0, 2: 0.0}


def test_identity_is_decided_by_rows_not_by_hashes(spark):
    schema = "path string, content_hash string"
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3"), ("d", "4"), ("e", None)], schema)
    new = spark.createDataFrame([("a", None), ("b", "2"), ("c", "3"), ("f", None), ("e", None)], schema)
    assert dict(map(tuple, catalog.verify_unchanged(old, new).collect())) == {
        "a": "unreadable", "b": "unverified", "c": "unchanged", "d": "missing", "e": "unreadable", "f": "new",
    }


def test_two_recipes_of_a_photo_render_it_once(spark, frames):
    whole, _, images = frames
    recipes = spark.createDataFrame([(1, 2.0, 1), (1, -1.0, 2), (1, 0.5, 2)], "image_id long, exposure double, version int")
    assert G.repeated_recipes(recipes).collect() == [(1, 3)]
    assert [(r["exposure"], r["version"]) for r in G.one_recipe_each(recipes).collect()] == [(0.5, 2)]
    once = G.grade(whole, images, recipes.filter("exposure = 0.5").select("image_id", "exposure"))
    assert sorted(G.grade(whole, images, recipes).collect()) == sorted(once.collect())
    assert sorted(G.attach_recipe(whole, images, recipes).select("x", "y").collect()) == sorted(whole.select("x", "y").collect())


def test_invalid_events_are_no_changes(spark):
    rows = [(1, 1, "commit", "exposure", float("nan")), (1, 2, "commit", "exposure", 1.0), (1, 3, "commit", "unknown", 1.0), (1, 2, "commit", "exposure", 1.0)]
    log = spark.createDataFrame(rows, "photo_id long, seq long, action string, key string, value double")
    assert [r["seq"] for r in editlog.suppress_noop(log).collect()] == [2]
    assert [tuple(r) for r in editlog.param_history(log).collect()] == [(1, 2, "exposure", 0.0, 1.0)]
