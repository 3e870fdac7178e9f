import random

import xxhash
from fixtures import awkward_docs, rows, sentence, shared_docs
from lumatable.llm.simhash import BKTree, components, links, near_duplicates, shard_links, simhash, without_near_duplicates


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.encode().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(values):
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    vs = sorted(parent)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in vs}


def check(df, **options):
    docs = [(r["doc_id"], plain_print(r["text"])) for r in df.collect()]
    group = plain_groups([f for _, f in docs])
    first = {}
    for d, f in docs:
        if d is not None:
            first[group[f]] = min(d, first.get(group[f], d))
    want = [(d, f"{f:016x}", first.get(group[f])) for d, f in docs]
    assert rows(near_duplicates(df, **options)) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_given_documents(spark):
    check(shared_docs(spark))


def test_awkward(spark):
    check(awkward_docs(spark).selectExpr("*", "1 AS fp", "2 AS label", "3 AS component_id", "'x' AS node"))
    check(awkward_docs(spark).limit(0))


def test_links_in_a_dense_ball_with_split_shards(spark):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(200)}
    for centre in (0, 0xFFFF0000FFFF0000):
        for _ in range(400):
            values.add(centre ^ sum(1 << b for b in rnd.sample([0, 1, 5, 17, 30, 33, 34, 47, 50, 63], rnd.randrange(6))))
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")

    by_group = {}
    for v, g in plain_groups(values).items():
        by_group.setdefault(g, set()).add(v)
    for shard in (8, 64):
        label = {r["node"] & (2**64 - 1): r["label"] for r in components(links(df, shard)).collect()}
        got = {}
        for v in values:
            got.setdefault(label.get(v, signed(v)), set()).add(v)
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in by_group.values()}



def test_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def test_tree_finds_all_within_radius():
    rnd = random.Random(1)
    values = list({rnd.getrandbits(12) for _ in range(300)})
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 97):
        assert sorted(tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)
    assert dict(shard_links(values)) == {v: g for v, g in plain_groups(values).items() if g != v}


def test_fingerprints():
    texts = [None, "", "  ", "One", "one two", "A b C", "É b C d", sentence(1, 500), "x y z " * 40]
    assert [int(v) for v in simhash(texts)] == [plain_print(t) for t in texts]


def test_one_of_each_group_stays(spark):
    df = awkward_docs(spark)
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns
    prints = [(r["doc_id"], plain_print(r["text"])) for r in df.collect()]
    groups = plain_groups([p for _, p in prints])
    # one row for every group, the one with its smallest id; id 9 stands in two groups
    got = sorted((groups[plain_print(r["text"])], r["doc_id"] or 0) for r in kept.collect())
    first = {}
    for d, p in prints:
        first[groups[p]] = min(d or 0, first.get(groups[p], 99)) if d is not None or groups[p] not in first else first[groups[p]]
    assert got == sorted(first.items())
