import hashlib
import math

import numpy as np
import pytest
from compare import diff, duck
from lumatable.llm import centroids as C, queries

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string"
BIG = np.iinfo(np.int64).max


def whole(v):
    return [math.floor(64 * x) if abs(x) < 1 << 53 else int(x) * 64 for x in (float(np.float32(x)) for x in v)]


def plain(data, k=16, rounds=3, dim=64):
    """``(vec_id, cluster, distance)`` sorted, and the centroids; plain integers throughout."""
    kept = [(i, whole(v)) for i, v in data if v is not None and len(v) == dim and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), a in zip(kept, at) if a == n] for n in range(len(cs))]
        cs = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, cs)]
    out = []
    for i, v in kept:
        d, n = nearest(v)
        out.append((i, n, d if d <= BIG else None))
    return sorted(out, key=str), cs


def check(spark, data, **options):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in data], SCHEMA).repartition(4)
    got, cs = C.cluster_vectors(df, **options)
    want, plain_cs = plain(data, **{n: o for n, o in options.items() if n in ("k", "rounds", "dim")})
    assert cs == plain_cs
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def vectors(n, dim, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(7, dim)) * 2
    return [(i, [float(x) for x in (middle[i % 7] + rng.normal(size=dim)) * scale]) for i in range(n)]


def test_groups_of_vectors(spark):
    check(spark, vectors(500, 64))
    check(spark, vectors(200, 5, scale=300.0), dim=5, k=9, rounds=5)


def test_ties_repeated_rows_and_few_vectors(spark):
    same = [(i % 40, [0.5, -0.25, 0.0]) for i in range(150)]
    check(spark, same, dim=3)
    check(spark, same + [(3, [9.0, 1.0, 0.0]), (3, [-9.0, 1.0, 0.0])] + vectors(60, 3, 2), dim=3)
    check(spark, vectors(4, 64))
    check(spark, [(1, [1.0, 2.0])], dim=2)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 2.0]), (None, [3.0, 0.0]), (40, None), (41, []), (42, [None, 1.0]), (43, [nan, 1.0]), (44, [inf, 1.0]), (45, [1.0] * 3)]
    check(spark, odd + vectors(30, 2, 3), dim=2, k=4)
    check(spark, [], dim=2)
    check(spark, odd[2:], dim=2)


def test_components_of_any_size(spark):
    """Some vectors, then centroids, then sums beyond what 64 bits hold."""
    large = [(900 + k, [x] * 3) for k, x in enumerate((1e9, -1e9, 3e38, -3.3e38, 2e6, 1.5e7))]
    check(spark, vectors(80, 3, 5) + large, dim=3, k=5)
    check(spark, [(i, [3e38 - i * 1e37, 1e9, -1.0]) for i in range(30)], dim=3, k=3)


def test_moves_touch_changed_components_only():
    move = C._move([[1, 2, 3], [4, 4, 4]], [[1, 5, 3], [4, 4, 4]], 3)
    assert move.deltas == [([1], [3]), ([], [])] and move.norms == [35, 48] and move.small


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    got = queries.op13_centroid_clustering(spark, f"/root/testdata/{sf}").toPandas()
    assert diff(got, duck(f"/root/testdata/{sf}").sql(queries.ORACLE["op13_centroid_clustering"]).df()) is None
