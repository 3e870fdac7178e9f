"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate on a site (host) if it stands on more than ``max_ratio`` of the site's pages
and on at least ``min_pages`` of them. Such lines are removed from the site's pages.

Pages are counted by (site, 64-bit line hash), which Spark sums before it shuffles; the few hashes
that pass are counted again by the whole line, so a collision can't remove anything. A site has at
most ``mean lines per page / max_ratio`` such lines. They reach the pages as one array per site:
texts are never shuffled unless that table exceeds Spark's broadcast limit, and then AQE splits a
dominant site.

Defined results: null text stays null with 0 lines; lines without a visible character are neither
counted nor removed; a line twice on one page counts once and goes wherever it stands; a null site
is a site of its own; a site below ``min_pages`` pages loses nothing; rows with equal ids are
separate pages; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import SPACES, stage_table

MAX_RATIO = 0.1
MIN_PAGES = 3


def _lines(text):
    return F.split(text, "\n", -1)


def _visible(line):
    return F.btrim(line, F.lit(SPACES)) != ""


def boilerplate_lines(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site, lines`` from ``site, text``: the lines to remove on each site that has any."""
    totals = pages.groupBy("site").agg(F.count("*").alias("_pages"))
    totals = stage_table(totals.select(F.col("site").alias("_site"), "_pages"), "sites")

    def over(counted, name):
        counted = counted.filter(F.col(name) >= min_pages)
        counted = counted.join(totals, F.col("site").eqNullSafe(F.col("_site")))
        return counted.filter(F.col(name) > F.lit(max_ratio) * F.col("_pages"))

    lines = pages.select("site", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).filter(_visible(F.col("line")))
    hashed = lines.select("site", F.xxhash64("line").alias("_hash"))
    likely = over(hashed.groupBy("site", "_hash").agg(F.count("*").alias("_on")), "_on")
    likely = stage_table(likely.select(F.col("site").alias("_lsite"), F.col("_hash").alias("_lhash")), "likely")
    exact = lines.join(
        likely,
        F.col("site").eqNullSafe(F.col("_lsite")) & (F.xxhash64("line") == F.col("_lhash")),
        "left_semi",
    )
    exact = over(exact.groupBy("site", "line").agg(F.count("*").alias("_on")), "_on")
    return stage_table(exact.groupBy("site").agg(F.sort_array(F.collect_list("line")).alias("lines")), "boilerplate")


def dedup_lines(
    docs: DataFrame, site_col: str = "source", text_col: str = "text",
    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``docs`` with cleaned ``text_col``, and a struct ``line_dedup`` of n_lines, n_dropped."""
    pages = docs.select(F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    found = boilerplate_lines(pages, max_ratio, min_pages)
    found = found.select(F.col("site").alias("_bp_site"), F.col("lines").alias("_bp_lines"))
    out = docs.join(found, docs[site_col].eqNullSafe(F.col("_bp_site")), "left")
    lines = _lines(docs[text_col])
    kept = F.when(
        F.col("_bp_lines").isNull(), lines
    ).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("_bp_lines"), x)))
    before, after = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("_bp_kept"), F.lit(0))
    none = docs[text_col].isNull()
    info = F.struct(
        F.when(none, 0).otherwise(before).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(before - after).cast("long").alias("n_dropped"),
    )
    out = out.withColumn("_bp_kept", kept)
    columns = [F.array_join("_bp_kept", "\n").alias(c) if c == text_col else docs[c] for c in docs.columns if c != "line_dedup"]
    return out.select(*columns, info.alias("line_dedup"))
