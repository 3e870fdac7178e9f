"""Keeping a stored table of renditions up to date, and smooth turns."""

import glob
import math

import pytest
from pyspark.sql import functions as F

from lumatable import schema as S
from lumatable.operators import geometry, grade as G
from lumatable.sources import renditions as R

PHOTOS = 24


@pytest.fixture()
def library(spark):
    images = spark.range(1, PHOTOS + 1).select(F.col("id").alias("image_id"), F.lit(5).alias("width"), F.lit(4).alias("height"))
    px = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("x")).select(
        "image_id", "x", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("y")
    )
    byte = lambda a, b, c: F.expr(f"cast((image_id * {a} + x * {b} + y * {c}) % 256 as int)")
    px = px.select("*", byte(31, 17, 7).alias("r"), byte(11, 5, 23).alias("g"), byte(3, 29, 13).alias("b"), F.lit(255).alias("a"))
    recipes = images.select("image_id", (F.col("image_id") % 5 - 2).cast("double").alias("exposure"), F.lit(0.0).alias("contrast"))
    return px, images, recipes


def files(path):
    return {f for f in glob.glob(f"{path}/image_bucket=*/*.parquet")}


def check(spark, path, px, images, recipes):
    columns = S.PIXELS.fieldNames()
    want = G.grade(px.join(images, "image_id", "left_semi"), images, recipes).select(*columns)
    assert sorted(R.read_renditions(spark, path).select(*columns).collect()) == sorted(want.collect())


def test_only_buckets_of_changed_photos_are_written(spark, folder, library):
    px, images, recipes = library
    path = f"{folder}/out"
    done = R.refresh_renditions(path, px, images, recipes, buckets=8)
    assert {tuple(r) for r in done.collect()} == {(i, "new") for i in range(1, PHOTOS + 1)}
    check(spark, path, px, images, recipes)

    first = files(path)
    assert R.refresh_renditions(path, px, images, recipes, buckets=8).count() == 0 and files(path) == first

    bump = recipes.withColumn("exposure", F.expr("exposure + CASE WHEN image_id IN (3, 4) THEN 1D ELSE 0D END"))
    done = R.refresh_renditions(path, px, images, bump, buckets=8)
    assert {tuple(r) for r in done.collect()} == {(3, "tone"), (4, "tone")}
    buckets = {r[0] for r in images.filter("image_id IN (3, 4)").select(R._bucket(8)).collect()}
    kept = {f for f in first if not any(f"image_bucket={b}/" in f for b in buckets)}
    assert kept and first & files(path) == kept
    check(spark, path, px, images, bump)


def test_new_removed_and_replaced_photos(spark, folder, library):
    px, images, recipes = library
    path = f"{folder}/out"
    some = images.filter("image_id <= 6")
    R.refresh_renditions(path, px, some, recipes, buckets=32)
    other = images.filter("image_id BETWEEN 3 AND 9")
    done = R.refresh_renditions(path, px, other, recipes, buckets=32)
    assert {tuple(r) for r in done.collect()} == {(1, "removed"), (2, "removed"), (7, "new"), (8, "new"), (9, "new")}
    check(spark, path, px, other, recipes)
    # the recipe of photo 5 goes; that of photo 6 was neutral in all but name
    fewer = recipes.filter("image_id <> 5")
    done = R.refresh_renditions(path, px, other, fewer, buckets=32)
    assert {tuple(r) for r in done.collect()} == ({(5, "tone")} if recipes.filter("image_id = 5").first()["exposure"] else set())
    check(spark, path, px, other, fewer)
    with_hash = other.withColumn("content_hash", F.when(F.col("image_id") == 4, "new file").otherwise("old"))
    R.refresh_renditions(f"{folder}/hashed", px, with_hash.withColumn("content_hash", F.lit("old")), recipes, buckets=4)
    done = R.refresh_renditions(f"{folder}/hashed", px, with_hash, recipes, buckets=4)
    assert {tuple(r) for r in done.collect()} == {(4, "source")}


def test_empty_library_and_failed_run(spark, folder, library):
    px, images, recipes = library
    path = f"{folder}/out"
    assert R.refresh_renditions(path, px, images.limit(0), recipes).count() == 0
    R.refresh_renditions(path, px, images, recipes, buckets=4)

    def breaks(*_):
        raise RuntimeError("no render")

    bump = recipes.withColumn("exposure", F.lit(1.5))
    before = files(path)
    with pytest.raises(RuntimeError):
        R.refresh_renditions(path, px, images, bump, render=breaks, buckets=4)
    assert files(path) == before
    R.refresh_renditions(path, px, images, bump, buckets=4)
    check(spark, path, px, images, bump)


def test_rounds_bound_what_is_on_disk_at_once(spark, folder, library, monkeypatch):
    """All pixels went through one exchange, and its files stayed on disk while the next table was written."""
    px, images, recipes = library
    path, seen, bound = f"{folder}/out", [], 8 * 20
    monkeypatch.setattr(R, "PIXELS_A_ROUND", bound, raising=False)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    exchanged = lambda: {f.getName() for f in map(blocks.getAllFiles().apply, range(blocks.getAllFiles().size()))}

    def render(some, *rest):
        out = G.grade(some, *rest)
        seen.append(out.count())
        return out

    steps = (
        (images.filter("image_id % 4 <> 1"), recipes),
        (images.filter("image_id <> 2"), recipes.withColumn("exposure", F.expr("exposure + CASE WHEN image_id % 5 = 2 THEN 0.5D ELSE 0D END"))),
    )
    for library_now, wanted in steps:
        seen.clear()
        before = exchanged()
        R.refresh_renditions(path, px, library_now, wanted, render=render, buckets=12)
        assert not any(n.startswith("shuffle_") for n in exchanged() - before)
        assert len(seen) > 1 and max(seen) <= bound
        check(spark, path, px, library_now, wanted)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert R.refresh_renditions(path, px, library_now, wanted, buckets=12).count() == 0


def test_rounds_hold_every_bucket_once(monkeypatch):
    monkeypatch.setattr(R, "PIXELS_A_ROUND", 10)
    assert R._rounds({3: 1, 1: 2, 2: 1, 7: 9, 9: 1}, {1: 4, 2: 6, 3: 30, 7: None}) == [[1, 2], [3], [7, 9]]
    assert R._rounds({5: 1}, {}) == [[5]] and R._rounds({}, {}) == []


@pytest.mark.parametrize("angle, flip", [(33.0, 0.0), (-71.5, 1.0), (0.3, 0.0), (45.0, 0.0)])
def test_smooth_turn_against_four_taps(spark, angle, flip):
    w, h = 9, 6
    byte = lambda x, y, c: (x * 37 + y * 53 + c * 91) % 256
    hole = (4, 3)
    px = [(1, x, y, None if (x, y) == hole else byte(x, y, 0), byte(x, y, 1), byte(x, y, 2), 255) for x in range(w) for y in range(h)]
    held = {(x, y): bytes_ for _, x, y, *bytes_ in px}
    images = spark.createDataFrame([(1, w, h)], "image_id long, width int, height int")
    recipes = spark.createDataFrame([(1, angle, flip)], "image_id long, rotation double, flipHorizontal double")
    dims = G.render_table(images, recipes)
    df = spark.createDataFrame(px, "image_id long, x int, y int, r int, g int, b int, a int")
    got = {(r["x"], r["y"]): [r[c] for c in "rgba"] for r in geometry.rotate_smooth(df, dims).collect()}
    turn = math.radians(angle % 360)
    co, si = math.cos(turn), math.sin(turn)
    ow, oh = math.ceil(abs(w * co) + abs(h * si)), math.ceil(abs(w * si) + abs(h * co))
    assert set(got) == {(x, y) for x in range(ow) for y in range(oh)}
    for (x, y), bytes_ in got.items():
        dx, dy = (x + 0.5 - ow / 2) * (-1 if flip else 1), y + 0.5 - oh / 2
        bx, by = w / 2 + dx * co + dy * si, h / 2 + dy * co - dx * si
        if not (0 <= math.floor(bx) < w and 0 <= math.floor(by) < h):
            assert bytes_ == [0, 0, 0, 0]
            continue
        bx, by = bx - 0.5, by - 0.5
        taps = [(tx, ty) for tx in (math.floor(bx), math.floor(bx) + 1) for ty in (math.floor(by), math.floor(by) + 1) if (tx, ty) in held]
        for c in range(4):
            both = [((1 - abs(bx - tx)) * (1 - abs(by - ty)), held[tx, ty][c]) for tx, ty in taps]
            both = [(wt, v) for wt, v in both if v is not None and wt > 1e-12]
            mean = sum(wt * v for wt, v in both) / sum(wt for wt, _ in both) if both else None
            assert bytes_[c] is None if mean is None else abs(bytes_[c] - mean) <= 0.5 + 1e-5


def test_weights_inside_the_frame_add_up_to_one(spark):
    images = spark.createDataFrame([(1, 20, 20)], "image_id long, width int, height int")
    dims = G.render_table(images, spark.createDataFrame([(1, 27.0)], "image_id long, rotation double"))
    px = geometry.full_grid(images).select("image_id", "x", "y").join(dims.select("image_id", "geo"), "image_id")
    sums = geometry.scatter_weights(px).groupBy("x", "y").agg(F.sum("w").alias("w"))
    middle = sums.filter("abs(x - 13) < 6 AND abs(y - 13) < 6").collect()
    assert len(middle) == 121 and all(abs(r["w"] - 1) < 1e-12 for r in middle)


def test_quarter_turns_are_the_same_as_unsmoothed(spark, library):
    px, images, _ = library
    recipes = images.select("image_id", (F.col("image_id") % 4 * 90.0).alias("rotation"), (F.col("image_id") % 2).cast("double").alias("flipVertical"))
    dims = G.render_table(images, recipes)
    columns = ["image_id", "x", "y", "r", "g", "b", "a", "width", "height"]
    assert sorted(geometry.rotate_smooth(px, dims).select(*columns).collect()) == sorted(geometry.rotate_flip(px, dims).select(*columns).collect())
