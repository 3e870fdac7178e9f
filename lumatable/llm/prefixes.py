"""Prefix trie of conversations from padded matrices of turn ids.

A turn is named by ``TURN`` bytes: the first 16 of the SHA-256 of its role and text, and the code points of
the text. A conversation is the bytes of its turns, one after the other, so byte order is the order of
turn sequences, a prefix before what continues it. Equal conversations become one row with a count
before anything else, so that a common one weighs no more than a rare one.

Rows are sorted into ranges, and a task cuts its range into blocks. In a block the turns get small
numbers, the conversations are a matrix of them padded with -1, ``lexsort`` orders its rows, and a mask says
where a column differs from the row above. Accumulated with OR over the columns, it marks where a node of
each depth starts, and ``reduceat`` over these starts adds up the nodes of one depth after the other.

A node that doesn't lie on the path of the first or last row of its block is complete. The others are
named by the hash of their turns and recombined from all blocks by a sum, together with corrections
for each border: nodes shared by the rows on both sides were counted as children, leaves and texts by
both. All figures are sums over rows that way:

* saved tokens are those of all conversations from the node on, less those of the distinct nodes;
* a row is a leaf unless the next one continues it.

Defined results: turns are ordered by number, null first, ties by role and text hash; null role or text
is empty; rows with a null conversation id belong to no conversation and are left out; repeated rows
are turns of their own; a conversation of no turns ends at the root; an empty table gives an empty result;
other columns are ignored. The names of one conversation's turns (24 bytes each) must fit into a task;
texts are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import drop_staged, stage_table

#: Bytes of a turn: hash and length.
HASH = 16
TURN = 24
#: Cells of a block's matrix.
CELLS = 2_000_000
EVERY = 100
HEADS = 6
#: Ids joined at a time; a power of two, so that numbers of different ranges make different chunks.
CHUNK = 1024

NODE = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "end_key": pa.binary(), "key": pa.binary(), "parent_key": pa.binary(),
    # only of the rows at the ends of a range
    "border": pa.int32(), "first": pa.binary(), "last": pa.binary(),
}
SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "end_key binary, key binary, parent_key binary, border int, first binary, last binary"
)


def _turn(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    name = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.unhex(F.substring(name, 1, 2 * HASH)), F.unhex(F.lpad(F.hex(F.length(text)), 2 * (TURN - HASH), "0")))


def conversations(
    turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", group_every: int | None = None
) -> DataFrame:
    """``conv_id, seq``: the turns of every conversation in order.

    With ``group_every`` also ``base, head``: the first multiple of it toward zero, and the turns of
    the conversation with that id. Both come from the one exchange by base.
    """
    conv = F.col(conv_col).cast("long")
    rows = turns.filter(conv.isNotNull()).select(
        conv.alias("conv_id"), F.col(turn_col).alias("turn"), _turn(F.col(role_col), F.col(text_col)).alias("name")
    )
    base = F.col("conv_id") - F.col("conv_id") % (group_every or 1)
    rows = rows.withColumn("base", base).repartition("base") if group_every else rows.withColumn("base", F.lit(0))
    listed = F.sort_array(F.collect_list(F.struct("turn", "name")))
    names = F.transform(listed, lambda t: F.hex(t["name"]))
    keys = ["base", "conv_id"] if group_every else ["conv_id"]
    out = rows.groupBy(*keys).agg(F.unhex(F.array_join(names, "")).alias("seq"))
    if not group_every:
        return out
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.col("seq"))).over(Window.partitionBy("base"))
    return out.withColumn("head", head)


def rebuilt(turns: DataFrame, every: int = EVERY, heads: int = HEADS, **columns) -> DataFrame:
    """``conv_id, seq`` with the first turns taken from the conversation at the multiple of ``every`` before.

    Their number is the unsigned CRC-32 of the decimal id, modulo ``heads``.
    """
    own = conversations(turns, group_every=every, **columns)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int") * TURN
    start = F.coalesce(F.substring(F.col("head"), F.lit(1), h), F.lit(b""))
    rest = F.substring(F.col("seq"), h + 1, F.lit((1 << 31) - 1))
    return own.select("conv_id", F.concat(start, rest).alias("seq"))


def sequence_key(seq: Column) -> Column:
    """The name of a sequence, and of the node where it ends."""
    return F.substring(F.unhex(F.sha2(seq, 256)), 1, HASH)


def _view(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind) if data else np.zeros(0, kind)


def _lengths(seq: bytes) -> np.ndarray:
    """Code points of every turn."""
    return _view(seq, ">i8").reshape(-1, TURN // 8)[:, -1].astype(np.int64)


def _path_keys(seq: bytes) -> list[bytes]:
    """The names of all nodes from the root to the end of a sequence."""
    digest, out = hashlib.sha256(), []
    for at in range(0, len(seq) + 1, TURN):
        out.append(digest.digest()[:HASH])
        digest.update(seq[at : at + TURN])
    return out


def _shared(a: bytes, b: bytes) -> int:
    """Turns at the start that two sequences share."""
    n = min(len(a), len(b))
    x, y = _view(a[:n], "i8"), _view(b[:n], "i8")
    other = (x != y).reshape(-1, TURN // 8).any(axis=1)
    return int(other.argmax()) if other.any() else n // TURN


def _batch(columns: dict) -> pa.RecordBatch:
    n = max(map(len, columns.values()))
    arrays = []
    for name, kind in NODE.items():
        value = columns.get(name)
        arrays.append(pa.nulls(n, kind) if value is None else pa.array(value, kind, from_pandas=False))
    return pa.RecordBatch.from_arrays(arrays, list(NODE))


def _border(last: bytes, first: bytes) -> dict:
    """What was counted twice by the blocks on both sides: a correction for each node they share."""
    depth = _shared(last, first)
    keys = _path_keys(first[: depth * TURN])
    tokens = np.concatenate([[0], _lengths(first[: depth * TURN])])
    ended = -1 if len(last) == depth * TURN else 0
    return {
        "key": keys, "parent_key": [None, *keys[:-1]], "depth": list(range(depth + 1)), "n_convs": [0] * (depth + 1),
        "n_children": [-1] * depth + [0], "n_leaves": [ended] * (depth + 1),
        "saved_tokens": tokens[::-1].cumsum()[::-1].tolist(),
    }


def block_nodes(seqs: list[bytes], counts: np.ndarray, firsts: np.ndarray) -> Iterator[dict]:
    """The nodes of different sequences, as columns of ``NODE``, depth by depth.

    Nodes on the path of the first or last sequence carry a ``key`` and hold what this block knows.
    """
    m = len(seqs)
    turns = np.fromiter(map(len, seqs), np.int64, m) // TURN
    width = int(turns.max(initial=0))
    row = np.repeat(np.arange(m), turns)
    column = np.arange(len(row)) - np.repeat(np.cumsum(turns) - turns, turns)
    flat = b"".join(seqs)
    # numbers in the order of the bytes; all names have one length, so it does no harm that numpy drops zeros at the end
    _, codes = np.unique(_view(flat, f"S{TURN}"), return_inverse=True)
    matrix = np.full((m, max(width, 1)), -1, np.int32)
    matrix[row, column] = codes
    order = np.lexsort(matrix.T[::-1])
    matrix, turns, counts, firsts = matrix[order], turns[order], counts[order], firsts[order]
    seqs = [seqs[i] for i in order]

    before = np.zeros((m, width + 1), np.int64)  # code points of the first d turns
    tokens = np.zeros((m, width), np.int64)
    tokens[row, column] = _lengths(flat)
    before[:, 1:] = tokens[order].cumsum(axis=1)
    total = before[:, -1]

    change = np.ones((m, width), bool)
    if m > 1 and width:
        change[1:] = np.logical_or.accumulate(matrix[1:, :width] != matrix[:-1, :width], axis=1)
    same = width - change.sum(axis=1)  # turns shared with the row above
    new = total - before[np.arange(m), same]
    leaf = np.ones(m, np.int64)
    leaf[:-1] = same[1:] < turns[:-1]
    keys, last_keys = _path_keys(seqs[0]), _path_keys(seqs[-1])
    ends = [hashlib.sha256(s).digest()[:HASH] for s in seqs]

    own, own_first, path = np.zeros(m, np.int64), None, None  # node of each row one depth up
    for d in range(width + 1):
        start = np.zeros(1, np.int64) if d == 0 else np.flatnonzero(change[:, d - 1])
        segment = np.zeros(m, np.int64)
        segment[start[1:]] = 1
        segment = segment.cumsum()
        n = np.add.reduceat(counts, start)
        first = np.minimum.reduceat(firsts, start)
        child = np.zeros(m, np.int64) if d == width else (change[:, d] & (turns > d)).astype(np.int64)
        child = np.add.reduceat(child, start)
        leaves = np.add.reduceat(leaf, start)
        done = before[start, max(d - 1, 0)]
        all_tokens = np.add.reduceat(counts * total, start) - n * done
        distinct = np.add.reduceat(new, start) - new[start] + total[start] - done
        real = turns[start] >= d
        here = {}
        if turns[0] >= d:
            here[int(segment[0])] = keys[d]
        if turns[-1] >= d:
            here[int(segment[-1])] = last_keys[d]
        at = np.flatnonzero(real)
        if not len(at):
            break
        head = start[at]
        up = own[head]
        out = {
            "conv_id": first[at], "depth": np.full(len(at), d), "n_convs": n[at], "n_children": child[at], "n_leaves": leaves[at],
            "saved_tokens": (all_tokens - distinct)[at],
            "end_key": [ends[i] if turns[i] == d else None for i in head.tolist()],
            "key": [here.get(s) for s in at.tolist()],
        }
        if d:
            out["parent_key"] = [path.get(s) for s in up.tolist()]
            out["parent_conv_id"] = [None if s in path else f for s, f in zip(up.tolist(), own_first[up].tolist())]
        yield out
        own, own_first, path = segment, first, here


def _range_nodes(cells: int):
    """Sorted rows of one range in, nodes out; the range's first and last sequence as a row of their own."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs, counts, firsts, widest = [], [], [], 0
        begin = end = border = None

        def flush():
            for columns in block_nodes(seqs, np.array(counts, np.int64), np.array(firsts, np.int64)):
                yield _batch(columns)

        for part in parts:
            for seq, n, first, place in zip(*[part.column(c).to_pylist() for c in ("seq", "n", "first_id", "_range")]):
                border = place
                begin = seq if begin is None else begin
                wide = max(widest, len(seq) // TURN + 1)
                if seqs and wide * (len(seqs) + 1) > cells:
                    yield from flush()
                    yield _batch(_border(end, seq))
                    seqs, counts, firsts, wide = [], [], [], len(seq) // TURN + 1
                widest = wide
                seqs.append(seq)
                counts.append(n)
                firsts.append(first)
                end = seq
        if seqs:
            yield from flush()
            yield _batch({"border": [border], "first": [begin], "last": [end]})

    return run


def _joined_borders(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for last, first in zip(part.column("before").to_pylist(), part.column("first").to_pylist()):
            yield _batch(_border(last, first))


def prefix_trie(convs: DataFrame, cells: int = CELLS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, end_key``: a row per node.

    ``convs``: ``conv_id, seq`` as from :func:`conversations`. A node's ``conv_id`` is its smallest member;
    ``end_key`` is the :func:`sequence_key` of conversations that end there, null if none does.
    """
    distinct = convs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_id"))
    distinct = stage_table(distinct, "sequences")
    placed = distinct.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("_range", F.spark_partition_id())
    made = stage_table(placed.mapInArrow(_range_nodes(cells), SCHEMA), "nodes")
    drop_staged(distinct)
    # a row per range
    before = F.lag("last").over(Window.orderBy("border"))
    pairs = made.filter("border IS NOT NULL").select("border", "first", before.alias("before")).filter("before IS NOT NULL")
    borders = pairs.select("before", "first").mapInArrow(_joined_borders, SCHEMA)
    shared = made.filter("key IS NOT NULL").unionByName(borders).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("end_key").alias("end_key"),
    )
    shared = stage_table(shared, "shared")
    inner = made.filter("key IS NULL AND border IS NULL")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_key", "parent_key"]
    parents = shared.select(F.col("key").alias("_key"), F.col("conv_id").alias("_parent"))
    known = inner.filter("parent_key IS NULL").withColumn("_parent", F.col("parent_conv_id"))
    asked = inner.select(*columns).unionByName(shared.select(*columns)).filter("parent_key IS NOT NULL")
    asked = asked.join(parents, F.col("parent_key") == F.col("_key"), "left")
    root = shared.filter("parent_key IS NULL").withColumn("_parent", F.lit(None).cast("long"))
    out = None
    for part in (known, asked, root):
        part = part.select("conv_id", "depth", F.col("_parent").alias("parent_conv_id"), *columns[2:7])
        out = part if out is None else out.unionByName(part)
    return out


def _streamed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts sorted by key and place in, one SHA-256 per key out."""
    key, digest, out = None, None, []
    for part in parts:
        for k, text in zip(part.column("end_key").to_pylist(), part.column("text").to_pylist()):
            if k == key:
                digest.update(b",")
            else:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            digest.update(text.encode())
    if key is not None:
        out.append((key, digest.hexdigest()))
    columns = [pa.array([r[j] for r in out], t) for j, t in enumerate((pa.binary(), pa.string()))]
    yield pa.RecordBatch.from_arrays(columns, ["end_key", "ends_sha256"])


def end_digests(convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``end_key, ends_sha256``: per sequence, the SHA-256 of its conversations' ids in order, comma-joined.

    Up to ``chunk`` ids are joined at once. The ids of a longer list are sorted into ranges and joined
    ``chunk`` at a time; a hash is sequential by its nature, so these texts of one list pass one task,
    which holds a batch of them.
    """
    rows = convs.select(sequence_key(F.col("seq")).alias("end_key"), "conv_id")
    many = rows.groupBy("end_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk)
    many = stage_table(many.select(F.col("end_key").alias("_many")), "many")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    few = rows.join(many, F.col("end_key") == F.col("_many"), "left_anti").groupBy("end_key").agg(F.sha2(text, 256).alias("ends_sha256"))
    if many.isEmpty():
        return few
    long = rows.join(many, F.col("end_key") == F.col("_many"), "left_semi")
    long = long.repartitionByRange("end_key", "conv_id").sortWithinPartitions("end_key", "conv_id")
    # the upper bits are the range, the rest runs on in it: a chunk never reaches over a range
    number = F.expr(f"monotonically_increasing_id() div {chunk}")
    long = stage_table(long.select("end_key", "conv_id", number.alias("_chunk")), "long")
    long = long.groupBy("end_key", "_chunk").agg(text.alias("text"))
    long = long.repartition("end_key").sortWithinPartitions("end_key", "_chunk").select("end_key", "text")
    return few.unionByName(long.mapInArrow(_streamed, "end_key binary, ends_sha256 string"))
