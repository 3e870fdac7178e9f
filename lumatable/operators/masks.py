"""Mask rasters as tables (image_id, mask_id, x, y, w) and their algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import clamp01, half_up, length2, smoothstep
from ..plans.joins import join_large
from ..plans.session import cut_lineage, spread
from .geometry import full_grid

OVERLAYS = ("red", "white_on_black", "black_on_white", "grayscale")


def linear_gradient(px: DataFrame, start: tuple, end: tuple) -> DataFrame:
    """0 before ``start``, 1 after ``end``, smooth between; points in normalised coordinates.

    Needs ``nx`` and ``ny``. The distance between the two points is the feather width.
    """
    dx, dy = end[0] - start[0], end[1] - start[1]
    t = ((F.col("nx") - start[0]) * dx + (F.col("ny") - start[1]) * dy) / (dx * dx + dy * dy)
    return px.withColumn("w", smoothstep(F.lit(0.0), F.lit(1.0), t))


def luminance_range(luma: Column, low: float, high: float, fall_low: float, fall_high: float) -> Column:
    """1 between low and high, falling to 0 over the given widths outside."""
    rise = smoothstep(F.lit(low - fall_low), F.lit(low), luma)
    fall = 1.0 - smoothstep(F.lit(high), F.lit(high + fall_high), luma)
    return rise * fall


def color_range(px: DataFrame, samples: DataFrame, tolerance: float, softness: float) -> DataFrame:
    """Nearness to the closest sampled colour of the photo, in OKLab.

    ``samples``: image_id, sample_a, sample_b, sample_l; a photo has a handful of them. They are
    gathered into one array per photo, so the pixel table keeps its row count. In a photo without
    samples nothing is near: its pixels keep their rows with weight 0.
    """
    picked = samples.groupBy("image_id").agg(
        F.collect_list(F.struct("sample_l", "sample_a", "sample_b")).alias("_s")
    )

    def distance(s):
        dl = F.col("lab_l") - s["sample_l"]
        da = F.col("lab_a") - s["sample_a"]
        db = F.col("lab_b") - s["sample_b"]
        return F.sqrt(dl * dl + da * da + db * db)

    nearest = F.array_min(F.transform("_s", distance))
    w = 1.0 - smoothstep(F.lit(tolerance), F.lit(tolerance + softness), nearest)
    w = F.when(F.col("_s").isNull(), 0.0).otherwise(w)
    return px.join(picked, "image_id", "left").withColumn("w", w).drop("_s")


def brush_mask(images: DataFrame, dabs: DataFrame) -> DataFrame:
    """Rasterise brush strokes.

    ``dabs``: image_id, stroke (order), x, y, radius, feather, flow, density, erase. Each dab is
    expanded to the pixels under it, so there is no pixel-to-dab join; a stroke takes the
    strongest of its dabs at a pixel. Strokes then apply in order: painting keeps the larger
    weight, erasing multiplies by the rest.
    """
    dims = images.select("image_id", "width", "height")
    d = dabs.join(dims, "image_id")
    span = lambda pos, size: F.sequence(
        F.greatest(F.lit(0), F.ceil(F.col(pos) - F.col("radius")).cast("int")),
        F.least(F.col(size) - 1, F.floor(F.col(pos) + F.col("radius")).cast("int")),
    )
    inside = lambda pos, size: (F.floor(F.col(pos) + F.col("radius")) >= 0) & (
        F.ceil(F.col(pos) - F.col("radius")) <= F.col(size) - 1
    )
    d = d.filter(inside("x", "width") & inside("y", "height") & (F.col("radius") >= 0))
    # rows of a dab are dealt out before they become pixels: one large brush is many tasks
    d = spread(d.withColumn("py", F.explode(span("y", "height"))), "image_id", "py").withColumn(
        "px", F.explode(span("x", "width"))
    )
    away = length2(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    # a dab without a radius is the pixel it sits on
    dist = F.when(F.col("radius") > 0, F.try_divide(away, F.col("radius"))).otherwise(
        F.when(away == 0, 0.0).otherwise(2.0)
    )
    fall = 1.0 - smoothstep(
        1.0 - F.greatest(F.lit(1e-6), F.col("feather")), F.lit(1.0), dist
    )
    d = d.withColumn("v", F.least(F.col("density"), F.col("flow") * fall)).filter("v > 0")
    strokes = d.groupBy(
        "image_id", F.col("px").alias("x"), F.col("py").alias("y"), "stroke", "erase"
    ).agg(F.max("v").alias("v"))
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("stroke", "erase", "v"))),
        F.lit(0.0),
        lambda m, s: F.when(s["erase"], m * (1.0 - s["v"])).otherwise(F.greatest(m, s["v"])),
    )
    return strokes.groupBy("image_id", "x", "y").agg(folded.alias("w"))


OPS = ("add", "subtract", "intersect")
#: Positions of a level that one aggregation holds side by side.
MAX_NODES = 64


def mask_algebra(nodes: DataFrame, by=("image_id", "x", "y"), positions: list[int] | None = None) -> DataFrame:
    """Combine mask nodes in order at each pixel.

    ``nodes``: keys, ord, op (add, subtract, intersect), w. A pixel's first node counts as added; a
    position without a row at a pixel changes nothing there. ``positions`` are the values of ``ord``;
    they are looked up if not given. Each becomes a column of one hash aggregate, so pixels are
    summed map-side and nothing is gathered or sorted.
    """
    if positions is None:
        found = nodes.select("ord").distinct().orderBy("ord").limit(MAX_NODES + 1).collect()
        positions = [r["ord"] for r in found]
    if len(positions) > MAX_NODES:
        raise ValueError(f"a mask level has more than {MAX_NODES} nodes; nest them with mask_tree")
    code = F.col("op")
    number = F.when(code == "subtract", 1).when(code == "intersect", 2).otherwise(0)
    here = {i: F.col("ord") == F.lit(i) for i in positions}
    aggs = [
        a
        for k, at in enumerate(here.values())
        for a in (F.max(F.when(at, F.col("w"))).alias(f"_w{k}"), F.max(F.when(at, number)).alias(f"_op{k}"))
    ]
    if not aggs:
        return nodes.select(*by, "w").limit(0)
    out = nodes.groupBy(*by).agg(*aggs).withColumn("_m", F.lit(None).cast("double"))
    for k in range(len(positions)):
        m, w, op = F.col("_m"), F.col(f"_w{k}"), F.col(f"_op{k}")
        joined = (
            F.when(w.isNull(), m).when(m.isNull(), w)
            .when(op == 1, m * (1.0 - w)).when(op == 2, m * w).otherwise(m + w - m * w)
        )
        out = out.withColumn("_m", joined)
    return out.select(*by, clamp01(F.col("_m")).alias("w"))


def mask_tree(tree: DataFrame, rasters: DataFrame, by=("image_id", "x", "y"), max_depth: int = 16) -> DataFrame:
    """Combine a tree of masks: the levels fold from the deepest up.

    ``tree``: node_id, parent_id (null for top nodes), ord, op, invert. ``rasters``: node_id, keys, w
    for the leaves. The result of a group is the raster of its node; ``invert`` turns a node's weight
    around before it joins its siblings. One ``mask_algebra`` per depth. A node whose parent is not in
    the table, a cycle or a tree deeper than ``max_depth`` is an error that names the node: leaving such a
    node out would change the mask without a word.
    """
    level = {r["node_id"]: r["parent_id"] for r in tree.select("node_id", "parent_id").limit(10_001).collect()}
    if len(level) > 10_000:
        raise ValueError("a mask tree is hand-made; more than 10,000 nodes are not one")

    lost = sorted(n for n, parent in level.items() if parent is not None and parent not in level)
    if lost:
        raise ValueError(f"mask nodes under a parent that is not in the tree: {lost[:10]}")

    def depth(node):
        n = 0
        while level.get(node) is not None:
            node, n = level[node], n + 1
            if n > max_depth:
                raise ValueError("mask tree is deeper than max_depth or has a cycle")
        return n

    depths = {n: depth(n) for n in level}
    rows = tree.join(
        tree.sparkSession.createDataFrame([(n, d) for n, d in depths.items()], "node_id long, _depth int"), "node_id"
    )
    ready = rasters.select("node_id", *by, "w")
    for d in range(max(depths.values(), default=0), -1, -1):
        nodes = ready.join(F.broadcast(rows.filter(F.col("_depth") == d)), "node_id")
        w = F.when(F.coalesce(F.col("invert"), F.lit(False)), 1.0 - F.col("w")).otherwise(F.col("w"))
        nodes = nodes.select(F.col("parent_id").alias("_parent"), *by, "ord", "op", w.alias("w"))
        folded = mask_algebra(nodes, ("_parent", *by))
        if d == 0:
            return folded.select(*by, "w")
        ready = ready.unionByName(folded.select(F.col("_parent").alias("node_id"), *by, "w"))
    return ready.select(*by, "w")


def radial_mask(px: DataFrame, mask: Column, feather: Column, invert: Column | bool = False) -> DataFrame:
    """The elliptic mask of a recipe as a raster: 1 inside, 0 beyond the feather, or the reverse.

    Needs ``nx`` and ``ny``; ``mask`` is a struct of x, y, width, height, rotation and ``feather``
    a percentage, both as in recipes.
    """
    angle = -mask["rotation"] * (math.pi / 180.0)
    dx, dy = F.col("nx") - mask["x"], F.col("ny") - mask["y"]
    u = (dx * F.cos(angle) - dy * F.sin(angle)) / F.greatest(F.lit(0.02), mask["width"] / 2.0)
    v = (dx * F.sin(angle) + dy * F.cos(angle)) / F.greatest(F.lit(0.02), mask["height"] / 2.0)
    soft = F.greatest(F.lit(0.02), feather / 100.0 * 0.7) * 2.2
    w = 1.0 - smoothstep(F.lit(1.0), F.lit(1.0) + soft, length2(u, v))
    turned = invert if isinstance(invert, Column) else F.lit(bool(invert))
    return px.withColumn("w", F.when(turned, 1.0 - w).otherwise(w))


def local_composite(original: DataFrame, adjusted: DataFrame, mask: DataFrame) -> DataFrame:
    """original x (1 - w) + adjusted x w.

    Pixels without a mask row or without an adjusted pixel stay original; ``matched`` tells which
    pixels had an adjusted one.
    """
    key = ["image_id", "x", "y"]
    adj = adjusted.select(*key, *[F.col(c).alias(f"_{c}") for c in "rgb"], F.lit(True).alias("_there"))
    j = join_large(join_large(original, adj, key, "left"), mask.select(*key, F.col("w").alias("_w")), key, "left")
    w = F.coalesce("_w", F.lit(0.0))
    matched = F.coalesce("_there", F.lit(False))
    mixed = lambda c: F.when(matched, half_up(F.col(c) * (1.0 - w) + F.col(f"_{c}") * w)).otherwise(F.col(c))
    return j.select(*key, *[mixed(c).alias(c) for c in "rgb"], matched.alias("matched"))


def strength_blend(source: DataFrame, processed: DataFrame, strength: Column) -> DataFrame:
    """Mix towards a processed version; strength 0 gives the input exactly.

    Pixels without a processed one stay as they are, with ``matched`` false.
    """
    key = ["image_id", "x", "y"]
    other = processed.select(*key, *[F.col(c).alias(f"_{c}") for c in "rgb"], F.lit(True).alias("_there"))
    j = join_large(source.withColumn("_t", strength), other, key, "left")
    matched = F.coalesce("_there", F.lit(False))
    mix = lambda c: F.when((F.col("_t") == 0.0) | ~matched, F.col(c)).otherwise(
        half_up(F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col("_t"))
    )
    return j.select(*key, *[mix(c).alias(c) for c in "rgb"], matched.alias("matched"))


def overlay(px: DataFrame, mode: str) -> DataFrame:
    """Show a mask: red tint, white on black, black on white or the weighted grey photo."""
    w = F.col("w")
    grey = F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722
    if mode == "red":
        out = {
            "r": F.col("r") + (255.0 - F.col("r")) * w / 2.0,
            "g": F.col("g") * (1.0 - w / 2.0),
            "b": F.col("b") * (1.0 - w / 2.0),
        }
    elif mode == "white_on_black":
        out = {c: w * 255.0 for c in "rgb"}
    elif mode == "black_on_white":
        out = {c: (1.0 - w) * 255.0 for c in "rgb"}
    elif mode == "grayscale":
        out = {c: grey * w for c in "rgb"}
    else:
        raise ValueError(f"unknown overlay {mode!r}; choose one of {', '.join(OVERLAYS)}")
    return px.withColumns({c: half_up(v) for c, v in out.items()})


def island_cleanup(mask: DataFrame, min_area: int, threshold: float = 0.5) -> DataFrame:
    """Drop 4-connected islands with fewer than ``min_area`` pixels.

    Pixels are first merged into horizontal runs; runs that touch in adjacent rows are edges.
    Labels then spread by minimum, with a jump to the label of the label in every round, so the
    rounds grow with the logarithm of an island's length. Each round is checkpointed; the loop ends
    when no label changes, which the falling labels guarantee.
    Rows below the threshold are no part of any island and are returned unchanged.
    """
    key = ["image_id", "x", "y"]
    on = mask.filter(F.col("w") >= threshold).select(*key)
    row = Window.partitionBy("image_id", "y").orderBy("x")
    # x minus its rank is constant inside a run; a row holds at most one frame width of pixels
    runs = on.withColumn("_g", F.col("x") - F.row_number().over(row))
    start = F.min("x").over(Window.partitionBy("image_id", "y", "_g"))
    node = F.struct(F.col("image_id"), F.col("y"), start.alias("x"))
    runs = cut_lineage(runs.select(*key, node.alias("node")))
    below = runs.select("image_id", "x", (F.col("y") - 1).alias("y"), F.col("node").alias("other"))
    half = runs.join(below, key).select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()
    edges = cut_lineage(half.union(half.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = cut_lineage(runs.select("node", F.col("node").alias("label")).distinct())
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        # the label is itself a node; its own new label is at least as small
        parents = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        step = cut_lineage(
            step.join(parents, "label").select("node", "before", F.col("root").alias("label"))
        )
        changed = step.filter(F.col("before") != F.col("label")).limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            break
    labelled = runs.join(labels, "node").select(*key, "label")
    area = labelled.groupBy("label").agg(F.count("*").alias("_area"))
    small = labelled.join(area.filter(F.col("_area") < min_area), "label").select(*key)
    return mask.join(small, key, "left_anti")
