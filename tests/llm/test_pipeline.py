import corpus_pipeline
import pytest
from fixtures import awkward_docs, rows, shared_docs
from lumatable.llm import pieces, queries
from lumatable.llm.common import read_table
from test_line_dedup import plain as plain_lines
from test_quality import plain_counts
from test_near_copies import plain_groups as near_groups
from sentencepiece import SentencePieceProcessor

SF = "/root/testdata/sf0.001"


def write(df):
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-") + "/docs"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@pytest.mark.parametrize("make", [shared_docs, awkward_docs, lambda s: awkward_docs(s).limit(0)])
def test_every_stage_on_what_the_one_before_kept(spark, make):
    docs = write(make(spark))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = write(stage(spark, docs, SF))
        before, after = docs.collect(), out.collect()
        if k < 4:
            assert out.columns == docs.columns, name
        if name == "quality_rules":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before if not plain_counts(r["text"])[5]}
        elif name == "line_dedup":
            want = plain_lines([(r["source"], r["text"]) for r in before], 0.1, 3)
            assert rows(out, "text") == sorted((w[0],) for w in want)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "near_dedup":
            # five words and similarity 0.8, not the two bits of the op9 query
            groups = near_groups([r["text"] for r in before])
            first = {}
            for r, g in zip(before, groups):
                if r["doc_id"] is not None:
                    first[g] = min(r["doc_id"], first.get(g, r["doc_id"]))
            assert sorted(r["doc_id"] or 0 for r in after) == sorted(first.get(g) or 0 for g in set(groups))
        elif name == "source_mixing":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        else:
            sp = SentencePieceProcessor(model_file=pieces.model_path())
            # two rows with different texts may share an id
            want = sorted((r["doc_id"] or 0, sp.encode(r["text"] or "")) for r in before)
            assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in after) == want
            assert all(r["round_trip"] for r in after)
        docs = out


def test_run(spark):
    assert queries.pipeline(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "encoding"]
    assert read_table(spark, SF, "documents").count() > 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE and n != "pipeline"])
def test_queries_without_sql_run(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.count() > 0 and len(set(out.columns)) == len(out.columns)


def test_python_stages_get_batches_of_bounded_size(spark):
    """Set when the result is computed, not only while it is planned: rows of 20 kB, far fewer than ten thousand a batch."""
    import pandas as pd
    from pyspark.sql import functions as F

    corpus_pipeline.encode(spark, awkward_docs(spark), SF)
    docs = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("word "), 4000).alias("text"))
    sizes = docs.select(F.pandas_udf(lambda t: pd.Series([len(t)] * len(t)), "long")("text").alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 400
