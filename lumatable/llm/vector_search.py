"""Exact top-k by integer inner product with vector-approximation files.

Every component becomes ``floor(scale * x)``. A vector's approximation is the number of its cell in
each dimension (``CELLS`` equal cells between the smallest and largest value of that dimension), one
byte each. Cells have one width per dimension, so for a query ``q`` the score of any vector in a cell
lies within ``|q| . half width`` of the score of the cell's middle: that gives bounds.

The search goes through blocks of vectors. In each block the approximations are scanned first; with
the best exact scores so far and the lower bounds, vectors whose upper bound can't reach the kth
score are left out. The others are read exactly in order of falling upper bound, in rounds, until
the next bound lies below the kth score found: then the result is certain.

All queries see all rows, in blocks: queries are dealt into chunks of at most about ``CHUNK`` rows by
a hash of their row number, a chunk is sent to all tasks, and each task returns at most ``k`` rows per
query. A chunk's result is written before the next one is read, so the driver holds one chunk at a time.

Defined results: vectors that are null or empty or hold null, NaN or infinite components take no
part, nor do rows with a null id; rows that share an id are rows of their own, as candidates (also of
each other) and as queries; vectors meet only vectors of their own length; ties go to the smaller id;
fewer candidates give fewer rows; an empty table gives an empty result; other columns are ignored.
Scores are exact for components of any size; a component or score beyond 63 bits becomes the nearest
one of 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage_table

SCALE = 64
K = 20
EVERY = 20
CELLS = 64
CHUNK = 4096
BLOCK = 4096
ROUND = 64


def integers(vectors: DataFrame, id_col="vec_id", vec_col="embedding", scale: int = SCALE) -> DataFrame:
    """``row, vec_id, v`` (array of long): the rows that take part, numbered; write them before a second use."""
    x = F.col(vec_col)
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    ok = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, bad) & F.col(id_col).isNotNull()
    rows = vectors.filter(ok).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    v = F.transform("x", lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v"))


def cell_edges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length, the smallest and largest value of every dimension."""
    each = vectors.select(F.size("v").alias("n"), F.posexplode("v").alias("d", "x"))
    rows = each.groupBy("n", "d").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    out = {}
    for r in rows:
        low, high = out.setdefault(r["n"], (np.zeros(r["n"], np.int64), np.zeros(r["n"], np.int64)))
        low[r["d"]], high[r["d"]] = r["low"], r["high"]
    return out


class Approximation:
    """Cells of one vector length."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        self.low = low.astype(float)
        self.most = np.maximum(np.abs(self.low), np.abs(high.astype(float)))
        self.width = np.maximum((high.astype(float) - self.low + 1) / cells, 1e-9)
        self.cells = cells

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.clip((v - self.low) // self.width, 0, self.cells - 1).astype(np.uint8)

    def middle(self, cells: np.ndarray) -> np.ndarray:
        return self.low + (cells + 0.5) * self.width

    def slack(self, q: np.ndarray) -> np.ndarray:
        # half a cell, and room for rounding in the sums
        return np.abs(q) @ (self.width / 2 + self.most * 1e-12) + 1e-6


def merge(best_s, best_i, s, i, k):
    """Keep the k best of two lists per query: higher score first, then smaller id."""
    s, i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, i], axis=1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


LAST = np.iinfo(np.int64).max
NONE = -LAST  # can be negated


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows; those beyond 63 bits are cut."""
    out = np.einsum("ij,ij->i", a, b)
    # sums of this size may not fit; every partial sum is below the sum of the absolute values
    wide = np.flatnonzero(np.einsum("ij,ij->i", np.abs(a.astype(float)), np.abs(b.astype(float))) >= 2.0**62)
    for n in wide.tolist():
        exact = sum(x * y for x, y in zip(a[n].tolist(), b[n].tolist()))
        out[n] = min(max(exact, NONE + 1), LAST)
    return out


def search_block(q_rows, q, rows, ids, v, cells: Approximation, best_s, best_i, k, step=ROUND):
    """Improve the best lists of all queries, in place, with one block; returns the exact reads."""
    score = q.astype(float) @ cells.middle(cells.of(v)).T
    slack = cells.slack(q)
    score[q_rows[:, None] == rows[None, :]] = -np.inf
    kth = best_s[:, -1].astype(float)
    if len(ids) >= k:
        kth = np.maximum(kth, -np.partition(-score, k - 1, axis=1)[:, k - 1] - slack)
    upper = score + slack[:, None]
    row, col = np.nonzero((upper >= kth[:, None]) & (upper > -np.inf))
    bound = upper[row, col]
    order = np.lexsort((-bound, row))
    row, col, bound = row[order], col[order], bound[order]
    count = np.bincount(row, minlength=len(q))
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    reads = 0
    for at in range(0, int(count.max(initial=0)), step):
        # a bound equal to the kth score may still win a tie by its id
        now = np.flatnonzero((place >= at) & (place < at + step) & (bound >= kth[row]))
        if not len(now):
            break  # bounds only fall and kth scores only rise from here on
        a, b = row[now], col[now]
        s, i = np.full((len(q), step), NONE), np.full((len(q), step), LAST)
        s[a, place[now] - at] = products(q[a], v[b])
        i[a, place[now] - at] = ids[b]
        reads += len(now)
        best_s[:], best_i[:] = merge(best_s, best_i, s, i, k)
        kth = np.maximum(kth, best_s[:, -1])
    return reads


def _search(chunk, edges, k, block):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, held, best = chunk.value, {}, {}

        def scan(n):
            rows, ids, v = (np.concatenate(x) for x in zip(*held.pop(n)))
            q_rows, _, q = queries[n]
            cells = Approximation(*edges[n])
            s, i = best.setdefault(n, (np.full((len(q), k), NONE), np.full((len(q), k), LAST)))
            for a in range(0, len(ids), block):
                own = slice(a, a + block)
                for b in range(0, len(q), 512):
                    p = slice(b, b + 512)
                    search_block(q_rows[p], q[p], rows[own], ids[own], v[own], cells, s[p], i[p], k)

        for part in parts:
            column = part.column("v")
            size = column.value_lengths().to_numpy()
            rows, ids = part.column("row").to_numpy(), part.column("vec_id").to_numpy()
            flat = column.flatten().to_numpy()
            at = np.cumsum(size) - size
            for n in np.unique(size).tolist():
                if n not in queries:
                    continue
                own = np.flatnonzero(size == n)
                held.setdefault(n, []).append((rows[own], ids[own], flat[at[own][:, None] + np.arange(n)]))
                if sum(len(x[0]) for x in held[n]) >= block:
                    scan(n)
        for n in list(held):
            scan(n)
        for n, (s, i) in best.items():
            a, b = np.nonzero(s != NONE)
            q_rows, q_ids, _ = queries[n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_rows[a]), pa.array(q_ids[a]), pa.array(i[a, b]), pa.array(s[a, b])],
                ["query", "query_id", "vec_id", "score"],
            )

    return run


def top_k(
    vectors: DataFrame, id_col="vec_id", vec_col="embedding", k: int = K, every: int = EVERY,
    scale: int = SCALE, chunk: int = CHUNK, block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row whose id divides by ``every``."""
    spark = vectors.sparkSession
    rows = stage_table(integers(vectors, id_col, vec_col, scale), "vectors")
    edges = cell_edges(rows)
    queries = rows.filter(F.col("vec_id") % every == 0)
    chunks = max(1, -(-queries.count() // chunk))
    queries = queries.withColumn("_chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    found = None
    for c in range(chunks):
        by_length: dict[int, tuple[list, list, list]] = {}
        for r in queries.filter(F.col("_chunk") == c).select("row", "vec_id", "v").toLocalIterator():
            for held, x in zip(by_length.setdefault(len(r["v"]), ([], [], [])), r):
                held.append(x)
        packed = {n: tuple(np.array(x, np.int64) for x in own) for n, own in by_length.items()}
        shared = spark.sparkContext.broadcast(packed)  # about ``chunk`` vectors, whatever the table
        near = rows.mapInArrow(_search(shared, edges, k, block), "query long, query_id long, vec_id long, score long")
        near = stage_table(near, "near")
        shared.destroy()
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
