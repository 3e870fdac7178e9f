import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import diff, duck
from lumatable.llm import prefixes as P, queries
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, seq string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA).repartition(4)


def own_turns(data):
    convs = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), tie, (role, text)))
    return {c: [t for *_, t in sorted(ts)] for c, ts in convs.items()}


def plain_rebuilt(data):
    own = own_turns(data)
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children.get(p, 0)
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (
            min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), children.get(p, 0), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, cs in members.items()
    )


def trie(convs, cells, chunk):
    nodes = P.prefix_trie(convs, cells)
    found = nodes.join(P.end_digests(convs, chunk), "end_key", "left").fillna(hashlib.sha256(b"").hexdigest(), "ends_sha256").fillna(-1, "parent_conv_id")
    return sorted(tuple(r) for r in found.select(COLUMNS).collect())


def check(spark, data, cells=P.CELLS, chunk=P.CHUNK, rebuild=True):
    df = table(spark, data)
    convs = P.rebuilt(df) if rebuild else P.conversations(df)
    assert trie(convs, cells, chunk) == plain(plain_rebuilt(data) if rebuild else own_turns(data))


def talks(n, seed=0, words=3, longest=7):
    """Conversations over few different turns, so that many share their beginnings."""
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rnd.randrange(1, longest)):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", "é" * rnd.randrange(1, words)))
    return out


@pytest.mark.parametrize("cells", [P.CELLS, 60, 1])
def test_blocks_of_any_size(spark, cells):
    check(spark, talks(300), cells)
    check(spark, talks(120, 1, 2, 5), cells, rebuild=False)


def test_equal_conversations_and_long_lists(spark):
    data = talks(40, 2) + [(c, t, "user", f"hot {t}") for c in range(200, 900) for t in range(3)]
    check(spark, data, chunk=64)
    check(spark, data, 50, 8, rebuild=False)


def test_long_conversation_among_short_ones(spark):
    data = talks(30, 3) + [(77, t, "user", f"w{t % 5}") for t in range(260)] + [(78, t, "user", f"w{t % 5}") for t in range(250)]
    convs = P.conversations(table(spark, data))
    for cells in (500, 5000):
        assert trie(convs, cells, 64) == plain(own_turns(data))


def test_awkward_rows(spark):
    odd = [
        (None, 1, "user", "lost"), (1, None, "user", "first"), (1, 0, None, "x"), (1, 0, "x", None), (1, 0, "x", None),
        (2, None, None, None), (3, 5, "user", "a" * 40_000), (3, 6, "user", ""), (-5, 0, "user", "minus"), (-100, 0, "user", "base"),
        (105, 0, "a", "bc"), (106, 0, "ab", "c"), (2**62, 0, "user", "large id"), (100, 3, "user", "\x00"), (100, 2, "user", "\U0001f600"),
    ]
    check(spark, odd + talks(20, 4))
    check(spark, odd, 3, rebuild=False)
    check(spark, [(None, 1, "user", "lost")])
    check(spark, [])


def test_turnless_conversations(spark):
    """The first turns come from a conversation that isn't there, and there are no more."""
    data = [(c, 0, "user", "only") for c in range(201, 260)]
    assert [] in plain_rebuilt(data).values()
    check(spark, data)
    bare = table(spark, data).select("conv_id", F.lit(b"").alias("seq"))
    assert trie(bare, 10, 4) == plain({c: [] for c, *_ in data})


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    got = queries.op11_prefix_trie(spark, f"/root/testdata/{sf}").toPandas()
    assert diff(got, duck(f"/root/testdata/{sf}").sql(queries.ORACLE["op11_prefix_trie"]).df()) is None
