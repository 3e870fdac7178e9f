import pytest
from compare import diff, duck
from fixtures import awkward_docs, rows
from lumatable.llm import mixing, queries
from pyspark.sql import functions as F


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Clamp and reshare in rounds until nothing is above its cap."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[n] for n in full)
        open_ = [n for n in names if n not in full]
        share = sum(weight[n] for n in open_)
        target = {n: cap * sizes[n] if n in full else left * weight[n] / share for n in names}
        over = {n for n in open_ if target[n] > cap * sizes[n]}
        if not over:
            return target
        full |= over


def check(df):
    out = mixing.mix_report(df).collect()
    sizes, taken, most = {}, {}, {}
    for r in out:
        assert r["taken"] == r["size"] * r["repeats"] and 0 <= r["repeats"] <= 3
    joined = {}
    for r in df.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n")).collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["n"]
        joined.setdefault((r["doc_id"], r["n"]), []).append(r["source"])
        most[r["source"]] = max(r["n"], most.get(r["source"], 0))
    target = plain_targets(sizes)
    for r in out:
        source = joined[r["doc_id"], r["size"]].pop()
        taken[source] = taken.get(source, 0) + r["taken"]
    for source in sizes:
        assert abs(taken[source] - target[source]) <= most[source], source
    assert sorted({(r["source_size"], round(r["target"], 4)) for r in out}) == sorted({(sizes[s], round(target[s], 4)) for s in sizes})
    return out


def test_awkward(spark):
    df = awkward_docs(spark).filter("doc_id IS NULL OR doc_id != 9")
    check(df.selectExpr("*", "1 AS size", "2 AS target", "'x' AS whole", "3 AS _key"))
    assert mixing.mix_report(df.limit(0)).count() == 0
    one = df.limit(3)
    assert mixing.mix_report(one).count() == 3


def test_caps_and_slices(spark):
    data = [(i, " ".join(["w"] * (1 + i * 7 % 13)), s) for i, s in enumerate(["big"] * 900 + ["mid"] * 60 + ["tiny"] * 3 + [None] * 20 + ["z"])]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)
    whole = rows(mixing.mix_report(df))
    check(df)
    for digits in (0, 3):
        assert rows(mixing.mix_report(df.repartition(3), digits=digits)) == whole


def test_mix_holds_each_row_as_often_as_reported(spark):
    df = awkward_docs(spark).selectExpr("*", "1 AS last", "2 AS whole")
    report = mixing.mix_report(df).groupBy("doc_id").agg(F.sum("repeats").alias("n")).filter("n > 0")
    mix = mixing.mixed_documents(df)
    assert mix.columns == df.columns
    assert rows(mix.groupBy("doc_id").count()) == rows(report)
    assert mixing.mixed_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_documents(spark, sf):
    got = queries.op8_source_mixing(spark, f"/root/testdata/{sf}").toPandas()
    assert diff(got, duck(f"/root/testdata/{sf}").sql(queries.ORACLE["op8_source_mixing"]).df()) is None
