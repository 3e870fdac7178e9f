"""Near copies by SimHash and BK-trees over sets of five-word shingles, then an exact check.

A text's set holds the XXH64 (seed 42) of each of its runs of five words, in lower case; a shorter
text is one shingle. Two texts are near copies if their sets have a Jaccard similarity of at least
``SIMILAR`` (0.8), and near copies form groups, also over several links.

Equal sets are one set from then on. A set's fingerprint has a bit for each bit that is set in over half of
its hashes. BK-trees (``simhash.BKTree``) find the fingerprints within ``RADIUS`` bits of each other; only
those sets are compared exactly. Similarity 0.8 leaves about 10 bits different and not two, so equal
blocks can't deal such fingerprints into shards as they do for two bits. MinHash does: ``BANDS * ROWS``
smallest hashes of a set make ``BANDS`` bucket numbers, and each tree holds sets that share a bucket.

A pair of similarity s shares no bucket with probability ``(1 - s ** ROWS) ** BANDS``: 3e-6 at 0.8, less
above. A pair at 0.8 is more than ``RADIUS`` bits apart with probability 1e-8 for long texts and at most
1e-6, for four shingles against five; both by calculation. Those are the only ways to miss one.

What is written for every row is its id, the number of its set, its fingerprint and its buckets. Only the
texts of sets in shared buckets are fetched and hashed again. Each set is first looked up in a tree around
one hub, the set of its buckets that meets most others; that brings most groups together with one pair a set.
Buckets that still hold several groups are cut into bounded shards in which the sets outside the largest
group meet all others: a tree a shard, asked by each set; sets of one group are not compared.

Defined results: null or wordless texts have the empty set and are copies of each other; a very long
text is one set of 8 bytes a word in one task, its smallest hashes are taken ``STEP`` shingles at a time;
ids, ties, repeated rows and other columns are as in ``simhash.without_near_duplicates``; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_batches, drop_staged, give_back, stage_table
from .simhash import SEED, BKTree, components, labelled, one_of_each

WORDS = 5
SIMILAR = (4, 5)
BANDS = 42
ROWS = 6
#: Bits in which the fingerprints of sets that are compared may differ.
RADIUS = 28
SHARD = 64
#: Bytes of texts or sets that a Python stage gets at once.
BATCH = "4m"
#: Members that one task compares with a hub.
STAR = 1024
#: Shingles whose hashes are taken at once; bounds memory whatever the text's length.
STEP = 4096
_FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ALL = (1 << 64) - 1
_ADDED = np.random.default_rng(SEED + 1).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The set of a text, in order."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    runs = zip([0, *ends], ends[WORDS - 1 :])
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in runs), np.uint64, len(words) - WORDS + 1))


def buckets(grams: np.ndarray) -> np.ndarray:
    """A number per band, different from those of other bands."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), STEP):
        np.minimum(least, (grams[at : at + STEP, None] * _FACTORS + _ADDED).min(axis=0), out=least)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b.tobytes(), SEED + k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def set_print(grams: np.ndarray) -> int:
    """The SimHash of a set: bits that are set in over half of its hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(grams), STEP):
        octets = grams[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grams), bitorder="little").view("<u8")[0])


def _key(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED)


def set_key(text: Column) -> Column:
    """The number of a text's set, as a signed long."""

    def keys(texts: pd.Series) -> pd.Series:
        values = texts.where(texts.notna(), None)
        return pd.Series(np.fromiter((_key(shingles(t)) for t in values), np.uint64, len(values)).view(np.int64))

    return F.pandas_udf(keys, "long")(text)


def _bands(texts: Column) -> Column:
    def rows(texts: pd.Series) -> pd.DataFrame:
        fps, prints, bands = [], [], []
        for t in texts.where(texts.notna(), None):
            grams = shingles(t)
            fps.append(_key(grams))
            prints.append(set_print(grams))
            bands.append(buckets(grams).view(np.int64))
        give_back()
        signed = [np.array(n, np.uint64).view(np.int64) for n in (fps, prints)]
        return pd.DataFrame({"fp": signed[0], "simhash": signed[1], "bands": bands})

    return F.pandas_udf(rows, "fp long, simhash long, bands array<long>")(texts)


def _grams(texts: Column) -> Column:
    def rows(texts: pd.Series) -> pd.DataFrame:
        fps, grams = [], []
        for t in texts.where(texts.notna(), None):
            own = shingles(t)
            fps.append(_key(own))
            grams.append(own.tobytes())
        give_back()
        return pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "grams": grams})

    return F.pandas_udf(rows, "fp long, grams binary")(texts)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Are two sorted sets similar enough; the sizes alone often tell."""
    up, down = SIMILAR
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(few) or down * len(few) < up * len(many):
        return False
    place = np.minimum(np.searchsorted(many, few), len(many) - 1)
    both = int((many[place] == few).sum())
    return down * both >= up * (len(a) + len(b) - both)


def _rows(found: list[tuple[int, ...]], names: tuple[str, ...] = ("a", "b")) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))], list(names))
    found.clear()
    return batch


def near_prints(centre: int, members: dict[int, list[int]]) -> list[int]:
    """Those of ``members`` (by fingerprint) that a tree around ``centre`` has within the radius."""
    tree = BKTree()
    for value in (centre, *members):
        tree.add(value)
    return [m for value in tree.within(centre, RADIUS) for m in members.get(value, ())]


def _tree_rays(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub and part in; those near enough to their hub out. A shard may cross a border between batches."""
    names = ("hub", "salt", "fp")
    key, centre, members, out = None, 0, {}, []
    for part in parts:
        for hub, salt, fp, own, hubs in zip(*[part.column(c).to_pylist() for c in (*names, "simhash", "hub_simhash")]):
            if (hub, salt) != key:
                out += [(*key, m) for m in near_prints(centre, members)] if members else []
                key, centre, members = (hub, salt), hubs & _ALL, {}
            members.setdefault(own & _ALL, []).append(fp)
        if len(out) > 10_000:
            yield _rows(out, names)
    out += [(*key, m) for m in near_prints(centre, members)] if members else []
    yield _rows(out, names)


def _star_links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub and part in, the hub itself first; links to it out."""
    key, own, out = None, None, []
    for part in parts:
        held = part.column("grams")
        for k, (hub, salt, fp) in enumerate(zip(*[part.column(c).to_pylist() for c in ("hub", "salt", "fp")])):
            grams = np.frombuffer(held[k].as_buffer(), np.uint64)
            if (hub, salt) != key:
                key, own = (hub, salt), grams.copy()
            elif similar(own, grams):
                out.append((fp, hub))
        if len(out) > 10_000:
            yield _rows(out)
    yield _rows(out)
    give_back()


def set_links(members: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between members (number, group, set) that bring groups together; one is enough for two groups.

    Each member asks a tree of the shorter ones; what is within the radius and of another group is compared.
    """
    members = sorted(members, key=lambda m: (len(m[2]), m[0]))
    groups: dict[int, int] = {g: g for _, g, _ in members}

    def top(g):
        while groups[g] != g:
            groups[g] = g = groups[groups[g]]
        return g

    tree, held, out = BKTree(), {}, []
    for a, g, own in members:
        mark = set_print(own)
        for near in tree.within(mark, RADIUS):
            for b, other, grams in held[near]:
                x, y = top(g), top(other)
                if x != y and similar(own, grams):
                    out.append((a, b))
                    groups[max(x, y)] = min(x, y)
        tree.add(mark)
        held.setdefault(mark, []).append((a, g, own))
    return out


def _shard_links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard in, links out; a shard may cross a border between batches."""
    key, members, out = None, [], []
    for part in parts:
        held = part.column("grams")
        for k, (*own, fp, label) in enumerate(zip(*[part.column(c).to_pylist() for c in ("bucket", "i", "j", "fp", "label")])):
            if own != key:
                out += set_links(members) if len(members) > 1 else []
                key, members = own, []
            members.append((fp, label, np.frombuffer(held[k].as_buffer(), np.uint64).copy()))
        if len(out) > 10_000:
            yield _rows(out)
    out += set_links(members) if len(members) > 1 else []
    yield _rows(out)
    members.clear()
    give_back()


def _members(sets: DataFrame) -> DataFrame:
    """``fp, simhash, bucket, n``: memberships of buckets that sets share.

    Buckets of the same members (a group usually shares many) count once.
    """
    dealt = sets.select("fp", "simhash", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(
        F.count("*").alias("n"), *[F.sum(F.xxhash64("fp", F.lit(k)).cast("decimal(38,0)")).alias(f"_p{k}") for k in (0, 1)],
    ).filter("n > 1")
    once = shared.groupBy("n", "_p0", "_p1").agg(F.min("bucket").alias("_bucket"))
    once = stage_table(once.select("_bucket", "n"), "buckets")
    members = stage_table(dealt.join(once, F.col("bucket") == F.col("_bucket")).drop("_bucket"), "members")
    drop_staged(once)
    return members


def _hubs(members: DataFrame) -> DataFrame:
    """``fp, hub`` and their fingerprints: for each set the one, of those in its buckets, that meets most others; not itself.

    A text that others were edited from is closer to them than they are to each other, so it meets most.
    """
    weights = members.groupBy("fp").agg(F.sum("n").alias("_weight")).withColumnRenamed("fp", "_fp")
    heaviest = members.join(weights, F.col("fp") == F.col("_fp")).groupBy("bucket").agg(F.max(F.struct("_weight", "fp", "simhash")).alias("_hub"))
    heaviest = heaviest.withColumnRenamed("bucket", "_bucket")
    best = members.join(heaviest, F.col("bucket") == F.col("_bucket")).groupBy("fp", "simhash").agg(F.max("_hub").alias("_hub"))
    return best.select("fp", "simhash", F.col("_hub.fp").alias("hub"), F.col("_hub.simhash").alias("hub_simhash")).filter("fp != hub")


def _stars(members: DataFrame, grams: DataFrame) -> DataFrame:
    """Links of sets to their hubs; a hub of very many sets is many shards.

    The trees need fingerprints only, so that the sets themselves are sent for the pairs they find.
    """
    pairs = stage_table(_hubs(members), "pairs")
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).alias("_salts")).withColumnRenamed("hub", "_hub")
    counts = stage_table(counts, "hubs")
    held = grams.select(F.col("fp").alias("_fp"), "grams")
    rays = pairs.join(counts, F.col("hub") == F.col("_hub")).select(
        "hub", F.pmod(F.xxhash64("fp"), F.col("_salts")).alias("salt"), "fp", "simhash", "hub_simhash"
    )
    rays = rays.repartition("hub", "salt").sortWithinPartitions("hub", "salt")
    rays = rays.mapInArrow(_tree_rays, "hub long, salt long, fp long").withColumn("ray", F.lit(1))
    centres = counts.select(
        F.col("_hub").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("salt"),
        F.col("_hub").alias("fp"), F.lit(0).alias("ray"),
    )
    rows = rays.unionByName(centres).join(held, F.col("fp") == F.col("_fp")).drop("_fp")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "ray")
    found = stage_table(rows.mapInArrow(_star_links, "a long, b long"), "links")
    drop_staged(pairs)
    drop_staged(counts)
    return found


def _rest(members: DataFrame, grams: DataFrame, labels: DataFrame, shard: int) -> DataFrame | None:
    """Links between the groups that still share a bucket: the smaller ones against all of the bucket.

    Members of a bucket are cut into blocks of ``shard``, and so are those outside its largest group; each
    pair of blocks is a shard, so shards are bounded and no pair of groups is left out.
    """
    named = members.join(labels.select(F.col("node").alias("_node"), "label"), F.col("fp") == F.col("_node"), "left")
    named = named.select("fp", "bucket", F.coalesce("label", "fp").alias("label"))
    parts = stage_table(named.groupBy("bucket", "label").agg(F.count("*").alias("n")), "parts")
    open_ = parts.groupBy("bucket").agg(
        F.sum("n").alias("_n"), F.count("*").alias("_labels"), F.max(F.struct("n", "label")).alias("_most")
    ).filter("_labels > 1")
    open_ = open_.select(
        F.col("bucket").alias("_bucket"), F.col("_most.label").alias("_most"),
        F.ceil(F.col("_n") / shard).cast("int").alias("_blocks"),
        F.ceil((F.col("_n") - F.col("_most.n")) / shard).cast("int").alias("_outer"),
    )
    open_ = stage_table(open_, "open")
    if open_.isEmpty():
        return None
    rows = named.join(open_, F.col("bucket") == F.col("_bucket"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("_blocks")).cast("int")
    outer = F.pmod(F.xxhash64("fp", F.lit(8)), F.col("_outer")).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    inner = rows.select("fp", "bucket", "label", F.explode(span(F.col("_outer"))).alias("i"), own.alias("j"))
    outside = rows.filter("label != _most").select("fp", "bucket", "label", outer.alias("i"), F.explode(span(F.col("_blocks"))).alias("j"))
    # a member may be in a shard for both reasons
    placed = inner.unionByName(outside).distinct().join(grams.select(F.col("fp").alias("_fp"), "grams"), F.col("fp") == F.col("_fp")).drop("_fp")
    placed = placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = stage_table(placed.mapInArrow(_shard_links, "a long, b long"), "links")
    drop_staged(parts)
    drop_staged(open_)
    return found


def links(sets: DataFrame, grams_of, shard: int = SHARD) -> DataFrame:
    """``a, b`` from distinct ``fp, simhash, bands``: edges with the groups of all near copies found.

    ``grams_of`` gives ``fp, grams`` for a table of ``fp``.
    """
    members = _members(sets)
    grams = stage_table(grams_of(members.select("fp").distinct()), "grams")
    found = _stars(members, grams)
    more = _rest(members, grams, stage_table(components(found), "labels"), shard)
    for old in (members, grams):
        drop_staged(old)
    return found if more is None else found.unionByName(more)


def without_near_copies(docs: DataFrame, id_col="doc_id", text_col="text", shard: int = SHARD) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _bands(F.col(text_col)).alias("_s")).select("doc_id", "_s.*")
    with arrow_batches(docs.sparkSession, BATCH):
        rows = stage_table(rows, "sets")
    sets = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("simhash").alias("simhash"), F.first("bands").alias("bands"))
    sets = stage_table(sets, "distinct")

    def grams_of(wanted: DataFrame) -> DataFrame:
        """Sets of the texts that are asked for, hashed anew from the rows with their first ids."""
        need = wanted.join(sets.select(F.col("fp").alias("_fp"), "first"), F.col("fp") == F.col("_fp")).select("_fp", "first")
        need = stage_table(need, "need")
        ids = need.select(F.col("first").alias("_nc_id")).distinct()
        texts = docs.join(ids, docs[id_col].eqNullSafe(F.col("_nc_id")), "left_semi")
        # rows that share an id may hold other texts too
        found = texts.select(_grams(docs[text_col]).alias("_s")).select("_s.*")
        found = found.join(need, F.col("fp") == F.col("_fp"), "left_semi")
        return found.groupBy("fp").agg(F.first("grams").alias("grams"))

    with arrow_batches(docs.sparkSession, BATCH):
        edges = links(sets, grams_of, shard)
    grouped = stage_table(labelled(rows.select("doc_id", "fp"), sets.select("fp", "first"), edges), "grouped")
    for old in (rows, sets):
        drop_staged(old)
    return one_of_each(docs, grouped, set_key, id_col, text_col)
