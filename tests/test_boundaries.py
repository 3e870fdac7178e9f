"""Boundaries within a tolerance and median hues, against plain loops."""

import math
import random

import pytest

from lumatable.operators import quality as Q, stats as T

MASK = "image_id long, x int, y int, w double"
W, H = 9, 7


def masks(seed):
    rng = random.Random(seed)
    return {(i, x, y): float(rng.random() < 0.6) for i in (1, 2, 3) for x in range(W) for y in range(H)}


def edge(mask, i):
    on = {(x, y) for (k, x, y), w in mask.items() if k == i and w >= 0.5}
    near = lambda x, y: [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    return {(x, y) for x, y in on if any(0 <= a < W and 0 <= b < H and (a, b) not in on for a, b in near(x, y))}


def plain(pred, truth, i, tolerance):
    a, b = edge(pred, i), edge(truth, i)
    share = lambda own, other: sum(any(math.dist(p, q) <= tolerance for q in other) for p in own) / len(own) if own else None
    p, r = share(a, b), share(b, a)
    total = (p or 0) + (r or 0)
    f = None if p is None and r is None else 2 * (p or 0) * (r or 0) / total if total else 0.0
    return tuple(None if v is None else round(v, 9) for v in (p, r, f))


def table(spark, mask):
    return spark.createDataFrame([(*k, w) for k, w in mask.items()], MASK)


def scores(df):
    return {r["image_id"]: tuple(None if v is None else round(v, 9) for v in (r["precision"], r["recall"], r["boundary_f"])) for r in df.collect()}


@pytest.mark.parametrize("tolerance", [0, 1, 1.5, 3])
def test_boundary_score(spark, tolerance):
    pred, truth = masks(1), masks(2)
    for k in list(truth):  # the third photo has no boundary in the truth, the fourth has none at all
        if k[0] == 3:
            truth[k] = 0.0
            pred[(4, *k[1:])] = truth[(4, *k[1:])] = 1.0
    a, b = table(spark, pred), table(spark, truth)
    got = scores(Q.boundary_score(a, b, tolerance))
    assert got == {i: plain(pred, truth, i, tolerance) for i in (1, 2, 3, 4)}
    assert got[3][1:] == (None, 0.0) and got[4] == (None, None, None)
    if tolerance == 0:
        same = {r["image_id"]: r["boundary_f"] and round(r["boundary_f"], 9) for r in Q.mask_quality(a, b).collect()}
        assert {i: v[2] for i, v in got.items()} == same


def test_boundary_score_of_sparse_masks_and_nothing(spark):
    pred, truth = masks(3), masks(4)
    images = spark.createDataFrame([(i, W, H) for i in (1, 2, 3)], "image_id long, width int, height int")
    set_ = lambda m: table(spark, m).filter("w > 0")
    got = scores(Q.boundary_score(set_(pred), set_(truth), 2, images=images))
    assert got == {i: plain(pred, truth, i, 2) for i in (1, 2, 3)}
    assert Q.boundary_score(set_(pred).limit(0), set_(truth).limit(0)).count() == 0
    with pytest.raises(ValueError):
        Q.boundary_score(set_(pred), set_(truth), -1)


def test_median_hue(spark):
    rng = random.Random(5)
    px = [(i, k, 0, rng.randrange(256), rng.randrange(256), rng.randrange(256), 255) for i in (1, 2) for k in range(60)]
    px += [(3, k, 0, 200 + k, 20, 20 + 9 * k, 255) for k in range(5)] + [(4, 0, 0, 80, 80, 80, 255), (3, 9, 9, None, 1, 2, 255)]
    df = spark.createDataFrame(px, "image_id long, x int, y int, r int, g int, b int, a int")
    hues = [(r["image_id"], r["hue"], r["chroma"]) for r in T.perceptual(T.whole_pixels(df)).collect()]
    want = {}
    for i in (1, 2, 3, 4):
        for band, centre in T.HUE_BANDS.items():
            own = []
            for k, hue, chroma in hues:
                d = (hue - centre + 180) % 360 - 180
                n = math.floor(max(0.0, 1 - abs(d) / 45) * chroma * 1e6 + 0.5)
                if k == i and n:
                    own.append((math.floor(d * 10 + 0.5), n))
            total, cum = sum(n for _, n in own), 0
            for step, n in sorted(own):
                cum += n
                if 2 * cum >= total:
                    want[i, band] = round((step / 10 + centre) % 360, 6)
                    break
    got = {(r["image_id"], r["band"]): round(r["median_hue"], 6) for r in T.hue_band_medians(df).collect()}
    assert got == want
    assert any(b == "red" for _, b in got)
