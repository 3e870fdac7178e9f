"""Centroid clustering (Lloyd's rounds) in exact integers, with an incremental distance matrix.

Every component becomes ``floor(scale * x)``. The first centroids are the ``k`` vectors with the
smallest SHA-256 of ``seed:id``. Each row keeps its integer dot product with every centroid; the
squared distance is ``|v|^2 - 2 dot + |c|^2``. When centroids move, a dot product only changes by the
row's components where its centroid changed, times that change: a centroid that stays costs nothing.
Then the smallest distance is looked up again, ties to the smaller number.

Rows with their dot products are a written table per round; the one before is dropped. Only centroids
(``k * dim`` numbers) and sums over clusters pass the driver. Sums are exact: each task adds up its
rows and hands them on in pieces of ``LIMB`` bits, however large they get.

Components are held in one to four bytes. A vector with a larger one keeps its given numbers and goes
through Python integers, as do all rows while some centroid has one; results are the same.

Defined results: vectors that are null, of another length or hold null, NaN or infinite components take
no part; repeated ids are rows of their own, and if they tie in the choice of the first centroids, the
smaller vector comes first; a null id is hashed as the empty string; fewer vectors than ``k`` give as
many centroids as there are vectors; an empty table gives an empty result; a distance or sum beyond 63
bits is null, the assignment still exact; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_staged, stage_table

K = 16
ROUNDS = 3
DIM = 64
SCALE = 64
SEED = "1"
LIMB = 40
LAST = np.iinfo(np.int64).max


def _bound(dim: int) -> int:
    """Components up to this size have squared distances within 62 bits."""
    return math.isqrt((1 << 60) // dim)


def _whole(x: float, scale: int) -> int:
    """``floor(scale * x)`` for any finite x."""
    return int(x) * scale if abs(x) >= 1 << 53 else math.floor(scale * x)


def _pack(scale: int, dim: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(over="ignore"):
                whole = np.floor(x * scale)
            most = np.abs(whole).max(axis=1, initial=0)
            size = np.searchsorted([1 << 7, 1 << 15, _bound(dim)], most, side="right")
            blobs = np.empty(len(x), object)
            for s, kind in enumerate((np.int8, np.int16, np.int32, np.float64)):
                own = np.flatnonzero(size == s)
                rows = x[own] if kind is np.float64 else whole[own].astype(kind)
                blobs[own] = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(blobs, pa.binary())], ["vec_id", "v"])

    return run


def _unpack(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Rows with small components and their matrix, and the others as lists of integers."""
    blobs = column.to_pylist()
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // dim
    small = np.flatnonzero(sizes < 8)
    out = np.empty((len(small), dim), np.int64)
    for s, kind in ((1, np.int8), (2, np.int16), (4, np.int32)):
        own = np.flatnonzero(sizes[small] == s)
        if len(own):
            out[own] = np.frombuffer(b"".join([blobs[i] for i in small[own]]), kind).reshape(-1, dim)
    large = {i: [_whole(x, scale) for x in np.frombuffer(blobs[i])] for i in np.flatnonzero(sizes == 8).tolist()}
    return small, out, large


def _taking_part(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    x = F.col(vec_col)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    return df.filter((F.size(x) == dim) & F.forall(x, finite))


def kept_vectors(df: DataFrame, id_col="vec_id", vec_col="embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: rows that take part, components packed."""
    rows = _taking_part(df, vec_col, dim).select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(_pack(scale, dim), f"vec_id {kind}, v binary")


def first_centroids(
    df: DataFrame, k: int = K, id_col="vec_id", vec_col="embedding", dim: int = DIM, scale: int = SCALE, seed: str = SEED
) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash, in its order; equal hashes by their components."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    scaled = lambda e: e.cast("double") * F.lit(float(scale))
    # a double of 2**53 or more is whole as it is, and may not fit the long that floor gives
    whole = lambda e: F.when(F.abs(e) < float(1 << 53), F.floor(e).cast("double")).otherwise(e)
    rows = _taking_part(df, vec_col, dim).select(
        F.sha2(F.concat(F.lit(f"{seed}:"), name), 256).alias("_key"),
        F.transform(F.col(vec_col), lambda e: whole(scaled(e))).alias("_order"),
        F.col(vec_col).cast("array<double>").alias("v"),
    )
    return [[_whole(x, scale) for x in r["v"]] for r in rows.orderBy("_key", "_order").limit(k).collect()]


@dataclass
class Move:
    """Centroids of a round and how they differ from the round before."""

    now: list[list[int]]
    deltas: list[tuple[list[int], list[int]]]  # per centroid: changed components, changes
    norms: list[int]
    small: bool


def _move(before: list[list[int]], now: list[list[int]], dim: int) -> Move:
    deltas = []
    for a, b in zip(before, now):
        cols = [i for i in range(dim) if a[i] != b[i]]
        deltas.append((cols, [b[i] - a[i] for i in cols]))
    most = max((abs(x) for c in before + now for x in c), default=0)
    return Move(now, deltas, [sum(x * x for x in c) for c in now], most < _bound(dim))


def _assign(move: Move, dim: int, scale: int, first: bool):
    """``dots`` (packed, or in ``big`` as text where they may not fit) and the nearest centroid of every row."""
    k = len(move.now)
    norms = np.array(move.norms if move.small else [0] * k, np.int64)

    def exact(v, dots):
        dots = [d + sum(v[i] * x for i, x in zip(*delta)) for d, delta in zip(dots, move.deltas)]
        own = sum(x * x for x in v)
        distances = [own - 2 * d + n for d, n in zip(dots, move.norms)]
        best = min(range(k), key=distances.__getitem__)
        return dots, best, distances[best] if distances[best] <= LAST else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = len(part)
            small, v, large = _unpack(part.column("v"), dim, scale)
            cluster, distance = np.zeros(n, np.int32), np.zeros(n, object)
            held, big = np.full(n, None, object), np.full(n, None, object)
            old = [None] * n if first else part.column("dots").to_pylist()
            old_big = [None] * n if first else part.column("big").to_pylist()

            def before(i):
                if first:
                    return [0] * k
                return list(map(int, old_big[i].split(","))) if old[i] is None else np.frombuffer(old[i], np.int64).tolist()

            fast = small if move.small and (first or all(old[i] is not None for i in small)) else small[:0]
            if len(fast):
                dots = np.zeros((len(fast), k), np.int64) if first else np.frombuffer(b"".join([old[i] for i in fast]), np.int64).reshape(-1, k).copy()
                for c, (cols, change) in enumerate(move.deltas):
                    if cols:
                        dots[:, c] += v[:, cols] @ np.array(change, np.int64)
                to = norms - 2 * dots
                cluster[fast] = to.argmin(axis=1)
                distance[fast] = np.einsum("ij,ij->i", v, v) + to.min(axis=1)
                held[fast] = [r.tobytes() for r in dots]
            slow = {} if len(fast) else dict(zip(small.tolist(), v.tolist()))
            for i, row in (slow | large).items():
                dots, cluster[i], distance[i] = exact(row, before(i))
                big[i] = ",".join(map(str, dots))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("v"), pa.array(held, pa.binary()), pa.array(big, pa.string()), pa.array(cluster), pa.array(distance, pa.int64())],
                ["vec_id", "v", "dots", "big", "cluster", "distance"],
            )

    return run


def _sums(k: int, dim: int, scale: int):
    """Per task: rows and component sums of each cluster, in limbs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, [[0] * dim for _ in range(k)]
        for part in parts:
            small, v, large = _unpack(part.column("v"), dim, scale)
            cluster = part.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                own = v[cluster[small] == c].sum(axis=0).tolist()
                rest = [row for i, row in large.items() if cluster[i] == c]
                count[c] += int((cluster == c).sum())
                total[c] = [a + sum(more) for a, *more in zip(total[c], own, *rest)]
        out = []
        for c in range(k):
            left, limb = total[c], 0
            while count[c] and (limb == 0 or any(left)):
                # the sign stays with every piece
                piece = [abs(x) % (1 << LIMB) * (1 if x >= 0 else -1) for x in left]
                out.append((c, limb, count[c] if limb == 0 else 0, piece))
                left = [(abs(x) >> LIMB) * (1 if x >= 0 else -1) for x in left]
                limb += 1
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["cluster", "limb", "n", "sums"]
        )

    return run


def _means(assigned: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The next centroids; one without rows stays. At most ``k`` rows a limb come to the driver."""
    k, dim = len(centroids), len(centroids[0])
    parts = assigned.select("v", "cluster").mapInArrow(_sums(k, dim, scale), "cluster int, limb int, n long, sums array<long>")
    added = parts.groupBy("cluster", "limb").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    )
    count, total = [0] * k, [[0] * dim for _ in range(k)]
    for r in added.collect():
        count[r["cluster"]] += r["n"]
        total[r["cluster"]] = [t + (int(r[f"s{i}"]) << LIMB * r["limb"]) for i, t in enumerate(total[r["cluster"]])]
    return [[t // n for t in ts] if n else old for n, ts, old in zip(count, total, centroids)]


def cluster_vectors(
    df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED,
    id_col="vec_id", vec_col="embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance per row, the final centroids)`` after ``rounds`` rounds."""
    centroids = first_centroids(df, k, id_col, vec_col, dim, scale, seed)
    rows = stage_table(kept_vectors(df, id_col, vec_col, dim, scale), "vectors")
    k = len(centroids)
    state, before = rows, [[0] * dim for _ in range(k)]
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, v binary, dots binary, big string, cluster int, distance long"
    for r in range(rounds + 1 if k else 0):
        work = _assign(_move(before, centroids, dim), dim, scale, r == 0)
        columns = ["vec_id", "v"] if r == 0 else ["vec_id", "v", "dots", "big"]
        after = stage_table(state.select(*columns).mapInArrow(work, schema), "assigned")
        drop_staged(state)
        state = after
        if r < rounds:
            before, centroids = centroids, _means(state, centroids, scale)
    if not k:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    return state.select("vec_id", "cluster", "distance"), centroids


def sum_within_long(value: Column) -> Column:
    """An exact sum of longs; null if one of them is null or the sum takes more than 63 bits."""
    total = F.sum(value.cast("decimal(38,0)"))
    return F.when(F.count("*") == F.count(value), F.when(total <= F.lit(int(LAST)), total)).cast("long")
