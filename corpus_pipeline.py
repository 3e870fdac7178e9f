"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import uuid

from lumatable.llm import line_dedup, mixing, near_copies, pieces, quality
from lumatable.llm.common import bound_batches, read_table
from lumatable.plans.session import checkpoint_dir
from pyspark.sql import DataFrame, SparkSession, functions as F


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and hold mostly content lines."""
    bound_batches(spark)
    judged = quality.judged(docs, read_table(spark, sf_dir, "labels"), out="_judged")
    return judged.filter("_judged.kept").drop("_judged")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are common on their source; n_chars follows."""
    out = line_dedup.dedup_lines(docs).drop("line_dedup")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash and BK-trees over five-word shingles, then similarity 0.8 or more."""
    return near_copies.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    bound_batches(spark)
    return pieces.encoded(docs).select("doc_id", "source", "lang", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix),
    ("encoding", encode),
]
#: SQL can't express Viterbi decoding or piece merging; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
