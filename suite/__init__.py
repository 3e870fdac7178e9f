"""All registered queries, grouped by area, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable.functions.color import luma_level
from lumatable.operators.grade import grade

from . import catalog, edits, grading, inputs, looks, masks, stats

AREAS = [grading, catalog, edits, stats, masks, looks]


def flagship(spark, sf):
    px = inputs.pixels(spark, sf)
    graded = grade(px, inputs.photos(spark, sf), inputs.recipes(spark, sf))
    mean = lambda df, name: df.groupBy("image_id").agg(
        F.round(F.avg(luma_level(*map(F.col, "rgb"))) / 10000.0, 6).alias(name)
    )
    return mean(px, "luma_before").join(mean(graded, "luma_after"), "image_id")


def queries():
    return {k: v for area in AREAS for k, v in area.QUERIES.items()}


def oracle_sql():
    return {k: v for area in AREAS for k, v in area.ORACLE.items()}
