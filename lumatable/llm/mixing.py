"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source's target is ``min(level * weight, cap * size)`` with one water level for all, chosen so
that the targets add up to the size of the corpus. That is where clamping at the cap and resharing
the excess by weight, over and over, comes to rest. Sources sorted by the level at which they reach
their cap give the level from running sums, without rounds.

A source is then taken ``floor(target / size)`` times as a whole, and once more for a seeded part:
documents in the order of a seeded hash, up to the one whose middle passes the remaining words.
The running sum of a large source is split by prefixes of that hash, so no task holds a source.

Defined results: null text has size 0; a null source is a source of its own and comes last; null
ids are hashed as the empty string; repeated rows count as often as they appear; rows that tie in
hash and size are alike, so their order doesn't show; an empty table gives an empty result; columns
other than the three named ones are ignored (``mix_plan``) or kept (``mixed_documents``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, running_totals, stage_table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def _key(id_col: str, seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _size(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size`` (one row per source) with its ``target``."""
    n = len(weights)
    ranked = running_totals(
        sources, [F.col("source").asc_nulls_last()], {"_rank": F.lit(1).cast("long")}
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % n + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("_cap", (F.lit(cap) * F.col("source_size")).cast("double"))
    ranked = ranked.withColumn("_full", F.col("_cap") / F.col("weight")).drop("_rank")
    filled = stage_table(
        running_totals(
            ranked, [F.col("_full"), F.col("source").asc_nulls_last()],
            {"_capped": F.col("_cap"), "_weights": F.col("weight")},
        ),
        "sources",
    )
    total = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    if total[0] is None:
        return filled.select("source", "source_size", F.lit(0.0).alias("target"))
    level = (F.lit(float(total[0])) - F.col("_capped")) / (F.lit(float(total[1])) - F.col("_weights"))
    first = filled.withColumn("_level", level).filter("_level <= _full").agg(F.min("_full"), F.min_by("_level", "_full")).first()
    height = F.lit(float(first[1]))
    target = F.when(F.col("_full") < height, F.col("_cap")).otherwise(F.col("weight") * height)
    return filled.select("source", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source",
    weights=WEIGHTS, cap: int = CAP, seed: str = SEED, digits: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(sizes, plan)``: a slim row per document, and per source how it is taken.

    ``sizes``: doc_id, source, size, _key. ``plan``: source, source_size, target, whole, last (the
    largest (key, size) of the seeded part, null if that part is empty). A source is cut by the first
    ``digits`` of the hash: by default so that the largest one has about as many slices as documents
    in a slice, since one task orders the slices and one the documents of the slice it is cut in.
    """
    sizes = stage_table(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            _size(text_col).alias("size"), _key(id_col, seed).alias("_key"),
        ),
        "sizes",
    )
    counted = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    counted = stage_table(counted, "counted")
    most = counted.agg(F.max("_n")).first()[0] or 1
    digits = math.ceil(math.log(most, 16) / 2) if digits is None else digits

    targets = source_targets(counted.select("source", "source_size"), weights, cap)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("_share", share).withColumn("whole", F.floor("_share").cast("long"))
    targets = stage_table(
        targets.withColumn("_part", (F.col("_share") - F.col("whole")) * F.col("source_size")), "targets"
    )

    sliced = sizes.withColumn("_slice", F.substring("_key", 1, digits))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy("source", "_slice").agg(F.sum("size").alias("_in"))
    slices = slices.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    slices = slices.join(
        targets.select(F.col("source").alias("_s"), "_part"), F.col("source").eqNullSafe(F.col("_s"))
    )
    # only the slice that the cut falls into has to be ordered; slices before it are taken whole
    cut = stage_table(
        slices.filter((F.col("_before") < F.col("_part")) & (F.col("_before") + F.col("_in") >= F.col("_part")))
        .select("_s", F.col("_slice").alias("_cut"), "_before", "_part"),
        "cuts",
    )
    at = sliced.join(
        cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_cut"))
    )
    inside = Window.partitionBy("source").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_sum", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    taken = at.filter(F.col("_sum") + F.col("size") / 2 <= F.col("_part"))
    last = taken.groupBy("source").agg(F.max(F.struct("_key", "size")).alias("last"))
    last = last.select(F.col("source").alias("_l"), "last")
    cut = cut.select(F.col("_s").alias("_c"), "_cut")
    plan = targets.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left")
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("_l")), "left")
    # nothing of the cut slice taken: everything that sorts before the slice still is
    edge = F.struct(F.col("_cut").alias("_key"), F.lit(-1).cast("long").alias("size"))
    plan = plan.withColumn("last", F.when(F.col("_part") > 0, F.coalesce("last", edge)))
    return sizes, stage_table(plan.select("source", "source_size", "target", "whole", "last"), "plan")


def _repeats(key, size):
    extra = F.when(F.struct(key.alias("_key"), size.alias("size")) <= F.col("last"), 1).otherwise(0)
    return (F.col("whole") + F.coalesce(extra, F.lit(0))).cast("long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, repeats`` for every row."""
    sizes, plan = mix_plan(docs, **options)
    plan = plan.withColumnRenamed("source", "_source")
    out = sizes.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    out = out.withColumn("repeats", _repeats(F.col("_key"), F.col("size")))
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats"
    )


def mixed_documents(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: str = SEED, **options
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns kept."""
    _, plan = mix_plan(docs, id_col, text_col, source_col, seed=seed, **options)
    plan = plan.select(F.struct("whole", "last").alias("_mix_how"), F.col("source").alias("_mix_source"))
    out = docs.join(plan, F.col(source_col).eqNullSafe(F.col("_mix_source")))
    how = F.col("_mix_how")
    extra = F.when(
        F.struct(_key(id_col, seed).alias("_key"), _size(text_col).alias("size")) <= how["last"], 1
    ).otherwise(0)
    times = (how["whole"] + F.coalesce(extra, F.lit(0))).cast("int")
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), times)).alias("_mix_copy")).drop("_mix_copy")
