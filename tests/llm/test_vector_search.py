import math

import numpy as np
import pytest
from compare import diff, duck
from lumatable.llm import queries, vector_search as V

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def plain(data, k=20, every=20):
    rows = []
    for i, v in data:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((i, [max(-(2**63), min(2**63 - 1, math.floor(64 * float(np.float32(x))))) for x in v]))
    out = []
    for a, (i, q) in enumerate(rows):
        if i % every == 0:
            dots = [(sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(rows) if b != a and len(v) == len(q)]
            scores = sorted((-max(-(2**63) + 2, min(2**63 - 1, s)), j) for s, j in dots)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, data, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in V.top_k(df, **options).collect())
    assert got == plain(data, options.get("k", 20), options.get("every", 20))


def vectors(n, d, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=d) * scale]) for i in range(n)]


def test_random_and_chunks(spark):
    check(spark, vectors(600, 16))
    check(spark, vectors(300, 5, scale=40), k=3, every=7, chunk=10, block=50)


def test_ties_copies_and_few_candidates(spark):
    flat = [(i, [0.5, 0.25]) for i in range(120)]
    check(spark, flat, block=16)
    check(spark, vectors(5, 3), every=1)
    check(spark, [(0, [1.0])])
    check(spark, flat[:60] + flat[:60] + [(3, [0.0, 0.0])] + vectors(30, 2))


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 2.0]), (40, None), (60, []), (80, [None, 1.0]), (100, [nan, 1.0]), (120, [inf, 1.0]), (140, [-inf, 0.0]), (160, [1.0] * 3), (-20, [-0.01, 0.01])]
    check(spark, odd + vectors(30, 2, 3) + [(200, [0.0, 0.0])])
    check(spark, [])


def test_rows_that_share_an_id(spark):
    data = [(20, [1.0, 1.0]), (1, [5.0, 5.0]), (1, [0.5, 0.5]), (1, [5.0, 5.0]), (20, [2.0, 0.0]), (40, [0.25, 9.0])]
    check(spark, data)
    check(spark, data, k=2, chunk=1, block=2)


def test_large_components(spark):
    data = [(0, [1e9, 1.0]), (1, [-1e9, 3.0]), (2, [1e9, 2.0]), (20, [0.5, 0.5]), (40, [3e38, -3e38]), (60, [1e-3, 1e12])]
    check(spark, data + [(100 + i, [float(i), 1.0]) for i in range(40)])


def test_offset_dimensions(spark):
    data = [(i, [1e5 + i % 7, (i % 5) * 1e-3, -3e4]) for i in range(200)]
    check(spark, data, k=4, block=32)


def test_bounds_hold_and_save_reads():
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(4000, 32)) * 40).astype(np.int64)
    q, ids = v[::100], np.arange(4000)
    cells = V.Approximation(v.min(0), v.max(0))
    middle = q @ cells.middle(cells.of(v)).T
    assert (np.abs(middle - q @ v.T) <= cells.slack(q)[:, None]).all()
    s, i = np.full((len(q), 20), V.NONE), np.full((len(q), 20), V.LAST)
    reads = V.search_block(ids[::100], q, ids, ids, v, cells, s, i, 20)
    assert reads < 0.1 * len(q) * len(v)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_embeddings(spark, sf):
    got = queries.op10_vector_search(spark, f"/root/testdata/{sf}").toPandas()
    assert diff(got, duck(f"/root/testdata/{sf}").sql(queries.ORACLE["op10_vector_search"]).df()) is None
