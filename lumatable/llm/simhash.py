"""SimHash near-dedup with BK-trees.

A text's fingerprint has a bit for each bit of XXH64 (seed 42) that is set in over half of its
three-word shingles. Fingerprints link if at most ``RADIUS`` (2) bits differ, and links form groups.

Distinct fingerprints are dealt into shards that must hold every linked pair together: of four
16-bit blocks, two differing bits leave at least two blocks equal, so each fingerprint goes to the
six shards named by a pair of its blocks. A shard above ``SHARD`` fingerprints is dealt again: its
free bits are cut in three, and at least one third is equal again. That ends at free bits that can't
tell more than ``SHARD`` fingerprints apart, so shards are bounded without dropping any. Each shard
builds a BK-tree (children keyed by their Hamming distance to the parent) and asks it for each of
its members, following only edges within the radius. A tree lives in the task that owns its shard;
sending every tree to every fingerprint would be quadratic.

A shard reports its links as one edge per member to its smallest linked member. Large-star and
small-star rounds turn edges into groups; no links, groups or fingerprints reach the driver.

Defined results: null or wordless text has fingerprint 0 and links like any other; a null id is never
a group's id unless all of its ids are null; rows with equal ids are fingerprinted on their own and
keep their rows; an empty table gives an empty result; other columns are ignored
(``near_duplicates``) or kept (``without_near_duplicates``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_staged, stage_table
from .quality import batches

WORDS = 3
SEED = 42
RADIUS = 2
SHARD = 64
BLOCKS = 4


def simhash(texts: list) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes, counts, rows = [], [], []
    for i, t in enumerate(texts):
        words = (t or "").encode("utf-8", "replace").lower().split()
        n = len(words)
        if not n:
            continue
        joined = b" ".join(words)
        if n <= WORDS:
            hashes.append(digest(joined, SEED))
            counts.append(1)
        else:
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            starts = [0, *ends]
            hashes += [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[WORDS - 1 :])]
            counts.append(n - WORDS + 1)
        rows.append(i)
    if rows:
        n = np.array(counts)
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
        out[rows] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long."""

    def signed(texts: pd.Series) -> pd.Series:
        values = texts.where(texts.notna(), None).tolist()
        parts = [simhash(p) for p in batches(values, 2_000_000)]
        return pd.Series((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))

    return F.pandas_udf(signed, "long")(text)


class BKTree:
    """Each node: value and children by distance."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (value, {})
                return
            node = node[1][d]

    def within(self, value: int, radius: int) -> list[int]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            own, children = open_.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(own)
            if 2 * radius < len(children):
                open_ += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
            else:
                open_ += [child for k, child in children.items() if abs(k - d) <= radius]
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, smallest member it is linked with in this shard), members that are not that one."""
    tree, parent = BKTree(), {}

    def top(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for v in values:
        if v in parent:
            continue
        parent[v] = v
        for near in tree.within(v, radius):
            a, b = top(near), top(v)
            parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, top(v)) for v in parent if top(v) != v]


def _masks(free: int, parts: int) -> list[int]:
    """Cut the set bits of ``free`` into ``parts`` masks of about equal size."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _shard_masks():
    blocks = _masks((1 << 64) - 1, BLOCKS)
    return [blocks[i] | blocks[j] for i in range(BLOCKS) for j in range(i)]


def _deal(rows: DataFrame, masks: dict[int, list[int]] | None) -> DataFrame:
    """``fp, mask, value``: a row for each shard of a fingerprint."""
    def shards(ms):
        return F.array(*[
            F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("value"))
            for m in ms
        ])

    if masks is None:
        dealt = shards(_shard_masks())
    else:
        dealt = F.coalesce(*[F.when(F.col("mask") == F.lit(_signed(m)).cast("long"), shards(ms)) for m, ms in masks.items()])
    return rows.select("fp", F.explode(dealt).alias("_s")).select("fp", "_s.mask", "_s.value")


def _tree_links(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard in, links out; a shard may cross a border between batches."""
    key, members, out = None, [], []

    def flush():
        links = out.copy()
        out.clear()
        a = pa.array([x for x, _ in links], pa.int64())
        return pa.RecordBatch.from_arrays([a, pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    for batch in batches_:
        for mask, value, fp in zip(*[batch.column(c).to_pylist() for c in ("mask", "value", "fp")]):
            if (mask, value) != key:
                out += _signed_links(members)
                key, members = (mask, value), []
            members.append(fp & 0xFFFFFFFFFFFFFFFF)
        if len(out) > 10_000:
            yield flush()
    out += _signed_links(members)
    yield flush()


def _signed_links(members):
    return [(_signed(a), _signed(b)) for a, b in shard_links(members)] if len(members) > 1 else []


def links(fps: DataFrame, shard: int = SHARD) -> DataFrame:
    """``a, b`` from distinct ``fp``: edges with the same groups as all links of at most two bits."""
    masks, rows, ready = None, fps.select("fp"), []
    free = {m: ((1 << 64) - 1) ^ m for m in _shard_masks()}
    while True:
        dealt = _deal(rows, masks) if masks is None else _deal(rows, masks).distinct()
        counts = dealt.groupBy("mask", "value").agg(F.count("*").alias("_n")).filter("_n > 1")
        counts = counts.select(F.col("mask").alias("_m"), F.col("value").alias("_v"), "_n")
        counts = stage_table(counts, "shards")
        shared = (F.col("mask") == F.col("_m")) & (F.col("value") == F.col("_v"))
        small = [m for m, f in free.items() if 1 << f.bit_count() <= shard]
        is_small = F.col("mask").isin([_signed(m) for m in small]) if small else F.lit(False)
        members = stage_table(dealt.join(counts, shared).select("fp", "mask", "value", ((F.col("_n") <= shard) | is_small).alias("_fits")), "members")
        ready.append(members.filter("_fits").drop("_fits"))
        rows = members.filter("NOT _fits")
        if rows.isEmpty():
            break
        masks = {m: [m | part for part in _masks(f, 3)] for m, f in free.items() if m not in small}
        free = {n: ((1 << 64) - 1) ^ n for ns in masks.values() for n in ns}
    all_members = ready[0]
    for more in ready[1:]:
        all_members = all_members.unionByName(more)
    placed = all_members.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return placed.mapInArrow(_tree_links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component, for nodes on an edge.

    Alternates large-star and small-star until nothing changes. Each round is a sum and a join; the
    joins read written tables, so Spark splits a node with very many edges.
    """
    edges = stage_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")

    def print_of(e):
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    def step(e, large):
        both = e if not large else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_b"))
        least = stage_table(least.select(F.col("a").alias("_a"), F.least(F.col("a"), F.col("_b")).alias("_to")), "least")
        joined = both.join(least, F.col("a") == F.col("_a"))
        if large:
            new = joined.filter("b > a").select(F.col("b").alias("a"), F.col("_to").alias("b"))
        else:
            new = joined.select(F.col("b").alias("a"), F.col("_to").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("_to").alias("b")))
        done = stage_table(new.filter("a != b").distinct(), "edges")
        drop_staged(least)
        return done

    last = print_of(edges)
    while last[0]:
        mid = step(edges, True)
        new = step(mid, False)
        drop_staged(mid)
        drop_staged(edges)
        edges, now = new, print_of(new)
        if now == last:
            break
        last = now
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops)


def _grouped(docs: DataFrame, id_col, text_col, shard: int) -> DataFrame:
    """``doc_id, fp, label, component_id`` for every row; the label names the group."""
    prints = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"))
    prints = stage_table(prints, "prints")
    distinct = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    return labelled(prints, distinct, links(distinct, shard))


def labelled(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``prints`` with ``label, component_id``: the groups that ``edges`` between values of ``fp`` make."""
    groups = stage_table(components(edges), "groups")
    named = distinct.join(groups, F.col("fp") == F.col("node"), "left")
    named = stage_table(named.select("fp", "first", F.coalesce("label", "fp").alias("label")), "named")
    heads = named.groupBy("label").agg(F.min("first").alias("component_id"))
    heads = stage_table(heads.withColumnRenamed("label", "_label"), "heads")
    named = named.join(heads, F.col("label") == F.col("_label")).select(F.col("fp").alias("_fp"), "label", "component_id")
    return prints.join(stage_table(named, "components"), F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shard: int = SHARD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row."""
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return _grouped(docs, id_col, text_col, shard).select("doc_id", hexed.alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shard: int = SHARD) -> DataFrame:
    """``docs`` with one row of each group, all columns kept.

    It is the row with the smallest id; among rows that share that id, the first by content.
    """
    return one_of_each(docs, _grouped(docs, id_col, text_col, shard), fingerprint, id_col, text_col)


def one_of_each(docs: DataFrame, grouped: DataFrame, print_of, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with one row of each group of ``grouped``, whose ``fp`` is ``print_of`` the text."""
    found = stage_table(grouped, "found")
    once = found.groupBy("doc_id").agg(F.count("*").alias("_n"), F.max(~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_goes"))
    # ids that go, or that need a look at their rows since they occur more than once
    gone = stage_table(once.filter("_goes OR _n > 1").select(F.col("doc_id").alias("_nd_id"), (F.col("_n") > 1).alias("_nd_again")), "gone")
    same = docs[id_col].eqNullSafe(F.col("_nd_id"))
    stay = docs.join(gone, same, "left_anti")
    if gone.filter("_nd_again").isEmpty():
        return stay
    groups = found.select(F.col("fp").alias("_fp"), F.col("label").alias("_label"), F.col("component_id").alias("_head"))
    again = docs.join(gone.filter("_nd_again"), same, "left_semi").select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_nd_id"), print_of(docs[text_col]).alias("_print")
    )
    again = again.join(stage_table(groups.distinct(), "again"), F.col("_print") == F.col("_fp"))
    again = again.filter(F.col("_nd_id").eqNullSafe(F.col("_head"))).groupBy("_label").agg(F.min("_row").alias("_row"))
    return stay.unionByName(again.select("_row.*"))
