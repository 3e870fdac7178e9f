import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward_docs, rows, shared_docs
from lumatable.llm import queries, sharding as S
from pyspark.sql import functions as F


def placed(df, **options):
    return [(tuple(r)[:-1], r["shard_place"]["shard"], r["shard_place"]["slot"]) for r in S.sharded(df, **options).collect()]


def check(df, shards=24, **options):
    got = placed(df, shards=shards, **options)
    assert sorted(map(repr, (r for r, _, _ in got))) == sorted(map(repr, map(tuple, df.collect())))
    sizes = Counter(s for _, s, _ in got)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(x for _, t, x in got if t == s) == list(range(counts[s]))
    return got


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_sizes_slots_and_rows(spark, shards):
    check(shared_docs(spark).repartition(7), shards)
    check(awkward_docs(spark).repartition(5), shards)


def test_empty_one_row_and_empty_partitions(spark):
    check(awkward_docs(spark).limit(0))
    check(awkward_docs(spark).limit(1))
    lone = spark.range(0, 40, 1, 20).filter("id % 20 > 16 OR id = 5")
    check(lone)


def test_copies_and_clashing_names(spark):
    same = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("shard"), F.lit(2).alias("slot"), F.lit(None).cast("int").alias("_at"), F.lit(0).alias("_row"))
    check(same)
    assert S.sharded(same.withColumn("shard_place", F.lit(1))).columns == [*same.columns, "shard_place"]


def test_reruns_agree_and_seeds_differ(spark):
    df = spark.range(0, 1000, 1, 5)
    one, two, other = (sorted(placed(df, seed=s)) for s in (1, 1, 2))
    assert one == two and one != other


def test_matrix_sums(spark):
    n = [500, 0, 1, 37, 12_000, 88, 0, 3, 9]
    counts = spark.createDataFrame([(p, x) for p, x in enumerate(n) if x], "part int, n long")
    matrix = {r["part"]: r["row"] for r in S.communication_matrix(counts, 5).collect()}
    assert {p: sum(row) for p, row in matrix.items() if sum(row)} == {p: x for p, x in enumerate(n) if x}
    columns = [sum(row[s] for row in matrix.values()) for s in range(5)]
    assert columns == [sum(n) // 5 + (s < sum(n) % 5) for s in range(5)]


def draws(spark, total, good, take, n):
    unit = (F.col("id") + 0.5) / n
    at = [F.lit(x).cast("long") for x in (total, good, take)]
    return np.array([r[0] for r in spark.range(n).select(S.hypergeometric(*at, unit)).collect()])


@pytest.mark.parametrize("total, good, take", [(10, 4, 5), (50, 3, 40), (9, 9, 4), (7, 0, 3), (1000, 420, 300), (200_000, 8_000, 90_000)])
def test_draws_follow_the_law(spark, total, good, take):
    """Evenly spread numbers give every value as often as its probability says, to one draw."""
    from math import exp, lgamma

    n = 4000
    got = Counter(draws(spark, total, good, take, n).tolist())
    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    for x in range(max(0, take + good - total), min(good, take) + 1):
        p = exp(choose(good, x) + choose(total - good, take - x) - choose(total, take))
        assert abs(got.pop(x, 0) - n * p) <= 1.01, x
    assert not got


def test_rows_are_spread_evenly(spark):
    """Partitions, places in a partition, slots and neighbours tell nothing of each other."""
    n = 40_000
    at = {r[0]: (s, x) for r, s, x in placed(spark.range(0, n, 1, 10), shards=8)}
    shard, slot = (np.array([at[i][k] for i in range(n)]) for k in (0, 1))
    part, tenth = np.arange(n) * 10 // n, slot * 10 // (n // 8)
    for one, other in ((shard, part), (shard, np.arange(n) % 10), (tenth, part), (tenth, np.roll(tenth, 1)), (shard, np.roll(shard, 1))):
        table = np.histogram2d(one, other, bins=(len(set(one)), len(set(other))))[0]
        expect = n / table.size
        freedom = (table.shape[0] - 1) * (table.shape[1] - 1)
        assert abs(((table - expect) ** 2 / expect).sum() - freedom) < 4.5 * (2 * freedom) ** 0.5
    assert abs(np.corrcoef(np.arange(n), slot)[0, 1]) < 0.02


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_sharding(spark, sf).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, x) for s, n in counts.items() for x in range(n))


def test_written_shards(spark, folder):
    df = awkward_docs(spark).withColumn("slot", F.lit("own"))
    names = S.write_shards(df, f"{folder}/out", shards=3)
    assert names == ("shard", "slot_")
    back = spark.read.parquet(f"{folder}/out")
    assert rows(back, *df.columns) == rows(df)
    assert Counter(r["shard"] for r in back.collect()) == {0: 7, 1: 7, 2: 6}
