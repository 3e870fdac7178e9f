import random

import numpy as np
import corpus_pipeline
import pytest
from fixtures import DOCS, awkward_docs, rows, sentence, shared_docs
from lumatable.llm import near_copies


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(texts):
    """The group of every text, all pairs compared."""
    sets = [plain_set(t) for t in texts]
    top = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if top[i] != top[j] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(top[i], top[j]), min(top[i], top[j])
                top = [new if t == old else t for t in top]
    return top


def check(df, **options):
    docs = df.collect()
    groups = plain_groups([r["text"] for r in docs])
    kept = near_copies.without_near_copies(df, **options)
    assert kept.columns == df.columns
    got = rows(kept)
    assert len(got) == len(set(groups))
    first = {}
    for r, g in zip(docs, groups):
        if r["doc_id"] is not None:
            first[g] = min(r["doc_id"], first.get(g, r["doc_id"]))
    want = [first.get(g) for g in set(groups)]
    assert sorted(r[0] or 0 for r in got) == sorted(w or 0 for w in want)


def edited(seed, n, share):
    """Texts of a base with single words changed, similar to the base by about 1 - 5 * share."""
    rnd = random.Random(seed)
    base = sentence(seed, n).split()
    return " ".join(f"z{rnd.randrange(10**6)}" if rnd.random() < share else w for w in base)


def copies(spark, n):
    rnd = random.Random(3)
    out = [(k, edited(1 + k % 7, 200, 0), "en", "a", 0) for k in range(7)]
    for k in range(7, n):
        words = sentence(1 + k % 7, 200).split()
        for at in rnd.sample(range(200), rnd.randrange(1, 9)):
            words[at] = f"z{k}"
        out.append((k, " ".join(words), "en", "a", 0))
    return spark.createDataFrame(out, DOCS)


@pytest.mark.parametrize("make", [shared_docs, awkward_docs, lambda s: awkward_docs(s).limit(0)])
def test_documents(spark, make):
    check(make(spark))


@pytest.mark.parametrize("shard", [4, 64])
def test_edited_copies_and_split_buckets(spark, shard):
    check(copies(spark, 300), shard=shard)


@pytest.mark.parametrize("shard", [3, 64])
def test_chains_and_outsiders_share_a_bucket(spark, shard):
    """Sets in one bucket that hubs alone don't bring together: links in a chain, and some of no group."""
    words = sentence(4, 400).split()
    texts = [" ".join(words[k : k + 150]) for k in range(0, 250, 9)]  # neighbours 0.88 alike, every second 0.78
    rnd = random.Random(1)
    texts += [" ".join(w if rnd.random() > 0.03 else f"q{rnd.randrange(999)}" for w in words[:150]) for _ in range(40)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    check(spark.createDataFrame([(i, texts[k], "en", "a", 0) for i, k in enumerate(order)], DOCS), shard=shard)


@pytest.mark.parametrize("seed", range(3))
def test_set_links_bring_all_groups_together(seed):
    rnd = np.random.default_rng(seed)
    pool = np.arange(1, 60, dtype=np.uint64)
    sets = [np.sort(rnd.choice(pool, rnd.integers(3, 50), replace=False)) for _ in range(40)]
    for base in sets[:10]:
        sets += [np.sort(rnd.choice(base, max(1, int(len(base) * 0.9)), replace=False)) for _ in range(3)]
    members = [(k, k // 2, s) for k, s in enumerate(sets)]

    def groups(pairs):
        top = {k: k // 2 for k in range(len(sets))}
        for a, b in pairs:
            x, y = top[a], top[b]
            top = {k: min(x, y) if t in (x, y) else t for k, t in top.items()}
        return top

    every = [(a, b) for a in range(len(sets)) for b in range(a) if near_copies.similar(sets[a], sets[b])]
    plain = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    assert every == plain and groups(near_copies.set_links(members)) == groups(every)


def test_stage_drops_an_edited_copy(spark):
    """Four of 200 words changed: similarity 0.82, more than two bits apart by the op9 fingerprint."""
    base = sentence(1, 200).split()
    other = [f"changed{k}" if k in (30, 80, 130, 180) else w for k, w in enumerate(base)]
    df = spark.createDataFrame([(1, " ".join(base), "en", "a", 0), (2, " ".join(other), "en", "a", 0), (3, sentence(9, 200), "en", "a", 0)], DOCS)
    a, b = plain_set(" ".join(base)), plain_set(" ".join(other))
    assert 0.8 <= len(a & b) / len(a | b) < 0.83
    assert rows(corpus_pipeline.drop_near_copies(spark, df, ""), "doc_id") == [(1,), (3,)]


def test_hardly_any_pair_shares_no_bucket():
    rnd = np.random.default_rng(0)
    for _ in range(300):
        pool = rnd.integers(1 << 62, size=100, dtype=np.uint64)
        a, b = np.unique(pool[:90]), np.unique(pool[10:])  # 80 of 100 shared
        assert (near_copies.buckets(a) == near_copies.buckets(b)).any()


def mark_of(grams):
    """The bits that are set in over half of the hashes, counted one by one."""
    return sum(1 << k for k in range(64) if 2 * sum(g >> k & 1 for g in grams.tolist()) > len(grams))


def test_fingerprints_of_sets():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 64, near_copies.STEP + 3):
        grams = np.sort(rnd.integers(1 << 64, size=n, dtype=np.uint64))
        assert near_copies.set_print(grams) == mark_of(grams)


def test_similar_sets_are_within_the_radius():
    """Similarity 0.8: four of five shingles, and longer texts."""
    rnd = np.random.default_rng(2)
    for common, a, b in ((4, 0, 1), (8, 1, 1), (12, 0, 3), (160, 20, 20)):
        for _ in range(2000):
            pool = rnd.integers(1 << 64, size=common + a + b, dtype=np.uint64)
            one, other = pool[: common + a], np.concatenate([pool[:common], pool[common + a :]])
            assert (near_copies.set_print(one) ^ near_copies.set_print(other)).bit_count() <= near_copies.RADIUS


def test_trees_find_the_candidates(monkeypatch):
    """Shards ask a tree, and compare only what it finds; a tree around a hub finds what is within the radius."""
    rnd = np.random.default_rng(3)
    sets = [np.sort(rnd.integers(1 << 64, size=100, dtype=np.uint64)) for _ in range(40)]
    sets += [np.sort(np.concatenate([s[5:], rnd.integers(1 << 64, size=5, dtype=np.uint64)])) for s in sets[:20]]
    compared, similar = [], near_copies.similar
    monkeypatch.setattr(near_copies, "similar", lambda a, b: compared.append((mark_of(a) ^ mark_of(b)).bit_count()) or similar(a, b))
    found = near_copies.set_links([(k, k, s) for k, s in enumerate(sets)])
    assert sorted(tuple(sorted(p)) for p in found) == [(k, k + 40) for k in range(20)]
    assert max(compared) <= near_copies.RADIUS and len(compared) < 60 * 59 / 2 / 2

    far = {(1 << n) - 1: [n, 100 + n] for n in range(65)}
    assert sorted(near_copies.near_prints(0, far)) == sorted(m for n in range(near_copies.RADIUS + 1) for m in (n, 100 + n))
    assert near_copies.near_prints((1 << 64) - 1, {0: [1]}) == []


def test_trees_of_any_radius():
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) & rnd.getrandbits(64) for _ in range(300)}
    tree = near_copies.BKTree()
    for v in values:
        tree.add(v)
    for radius in (0, 2, 10, 28, 64):
        for v in list(values)[:20]:
            assert sorted(tree.within(v, radius)) == sorted(w for w in values if (v ^ w).bit_count() <= radius)
