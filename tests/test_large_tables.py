"""Tables that grow with the library: never broadcast on an estimate, tasks of bounded size."""

import re

import pytest

import suite
from pyspark.sql import functions as F

from lumatable.plans import joins, session
from lumatable.operators import geometry, grade, looks, stats, tiles

SF = "/root/testdata/sf0.001"
JOINED = [
    "attach_recipe", "class_stats", "paired_class_stats", "grade_exposure", "local_composite", "strength_blend",
    "mask_quality", "wb_eyedropper", "neutral_short_circuit",
]


@pytest.fixture()
def many_photos(monkeypatch):
    """Every table counts as too large for a broadcast."""
    for module in (joins, grade, geometry, stats, tiles):
        monkeypatch.setattr(module, "has_few_rows", lambda df, limit=0: False)
    monkeypatch.setattr(geometry, "BROADCAST_ROWS", -1)


@pytest.mark.parametrize("name", JOINED)
def test_exploded_tables_are_not_broadcast(spark, many_photos, name):
    plan = suite.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["look_features", "rgb_histogram", "luma_histogram", "mix_styles", "mix_curves", "match_strength", "hue_band_medians"])
def test_tasks_do_not_grow_with_the_photos(spark, monkeypatch, name):
    """200 photos at 10 a task: 20 tasks or more make the rows, whatever the shuffle setting says."""
    monkeypatch.setattr(session, "PHOTOS_A_TASK", 10)
    plan = suite.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and min(dealt) == 20


def test_pixels_dealt_out_by_photo_meet_without_an_exchange(spark):
    plan = suite.queries()["image_quality_blocks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"hashpartitioning\([^()]*\b[xy]#", plan)


def test_filters_on_graded_bytes_are_not_rewritten(spark):
    """Rewritten into the tone stages, the filter of ``look_features`` kept the planner busy for over ten minutes."""
    graded = grade.settled(suite.queries()["grade_tone_full"](spark, SF), ["image_id", "x", "y"], ["r", "g", "b", "a"])
    plan = graded.filter("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    top, below = plan.split("\n")[:2]
    assert top.startswith("Filter") and "Generate inline" in below and len(top) < 200


@pytest.mark.parametrize("name", [
    "grade_tone_curve", "grade_tone_full", "grade_tone_regions", "grade_vibrance_saturation", "grade_vignette", "grade_white_balance",
    "grade_contrast_clarity", "grade_radial_mask", "rotate_bilinear", "rotate_flip", "compare_renditions", "detail_filter", "grade_full",
])
def test_no_rendering_is_broadcast(spark, many_photos, name):
    plan = suite.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_known_edits_are_matched_in_one_pass_over_the_pixels(spark, monkeypatch):
    """Features that no known key is matched by had a second pass over both renditions, with 55 sums a pixel."""
    seen = []
    monkeypatch.setattr(looks, "cut_lineage", lambda df: seen.append(df) or df)
    suite.queries()["closed_loop_report"](spark, SF)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("explode(sequence(0, (height") == 2 and "ATAN2" not in plan and "array_position" not in plan


def test_features_in_use_do_not_change_the_report(spark):
    px, images = (f(spark, SF).filter("image_id < 40") for f in (suite.inputs.pixels, suite.inputs.photos))
    few = suite.inputs.recipes(spark, SF, ["exposure", "tint"]).filter("image_id < 40")
    more = few.withColumns({"temperature": F.lit(6500.0), "saturation": F.lit(0.0)})
    some, whole = (set(looks.closed_loop_report(px, images, r).collect()) for r in (few, more))
    assert len(some) == 2 and len(whole) == 4 and some < whole


@pytest.mark.parametrize("wanted", [("p25", "neutral_a"), ("neutral_confidence", "neutral_b"), ("p99", "red_hue", "density_slope"), ("toe",)])
def test_wanted_features_are_the_same(spark, wanted):
    px = suite.inputs.pixels(spark, SF).filter("image_id < 40")
    some = stats.look_features(px, wanted)
    assert set(some.columns) == {"image_id", *wanted}
    # sums of doubles may differ in the last bits between runs
    rows = lambda df: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("image_id", *wanted).collect()])
    assert rows(some) == rows(stats.look_features(px))


@pytest.mark.parametrize("keys", [("exposure", "tint"), ("contrast", "vibrance"), ("vignette", "shadows"), ("clarity", "curve", "mask", "maskFeather")])
def test_stages_of_missing_keys_are_not_planned(spark, keys):
    assert len(grade.stages_needed(keys)) < len(grade.ROW_STAGES)
    assert grade.stages_needed(suite.grading.TONE_KEYS) == grade.ROW_STAGES
    px, images = (f(spark, SF).filter("image_id < 40") for f in (suite.inputs.pixels, suite.inputs.photos))
    recipes = suite.inputs.recipes(spark, SF, list(keys)).filter("image_id < 40")
    graded = sorted(grade.grade(px, images, recipes).collect())
    assert graded == sorted(grade.grade(px, images, grade.complete_recipes(images, recipes).drop("width", "height")).collect())
    assert graded != sorted(px.select("image_id", "x", "y", *"rgba").collect())
