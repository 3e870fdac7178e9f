"""Substring dedup by seed and extend.

A window of ``WINDOW`` (35) words is removed if its words also start anywhere else. Winnowing picks
the seeds: of the ``SEED_WORDS``-word hashes in a window the smallest, leftmost one is the window's
anchor, so equal windows have equal anchors at equal places. Consecutive windows with one anchor
form a run; a run is an anchor occurrence together with the text it may be extended over.

1. Occurrences are counted by anchor. Those of an anchor that occurs once can't be repeated.
2. Where all runs of an anchor have the same words, the match extends over all of each run.
3. Elsewhere, one run of each wording is extended both ways: a hash for each of its windows (at most
   ``WINDOW - SEED_WORDS + 1``), counted with the number of runs of that wording. Windows found twice
   or more are maximal repeats, kept as a bit mask per wording.
4. The masks go back to all runs, and the covered words are cut out of the documents.

No pairs of occurrences are formed, however many documents share a passage: every step is a sum
by hash, summed before it is shuffled, or a join of written tables, which Spark splits if a passage
is hot. Words and texts are compared by 64-bit hashes, always of anchor and window together.

Defined results: null text has no words (empty hash text); texts below 35 words lose nothing; rows
with equal ids and texts are separate documents, hence copies of each other; repeats may overlap
and may lie in one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_shuffles, ranges, stage_table, word_hashes
from .quality import batches

WINDOW = 35
SEED_WORDS = 12
BASE = 0x9E3779B97F4A7C15
STEP = 3_000_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Texts:
    """Words of a list of texts, hashed, with sums that give the hash of any stretch of words."""

    def __init__(self, texts: list):
        self.words = [(t or "").encode("utf-8", "replace").split() for t in texts]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.first = np.cumsum(self.counts) - self.counts
        self.hash = word_hashes([w for ws in self.words for w in ws])
        n = len(self.hash)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * _powers(BASE, n + 1)[:n], dtype=np.uint64)])
        self.undo = _powers(pow(BASE, -1, 1 << 64), n + 1)

    def stretch(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.undo[start]

    def runs(self, window: int, seed: int):
        """Anchor hash, wording hash, text number, first window and number of windows of every run."""
        n = len(self.hash)
        m = n - window + 1
        none = np.zeros(0, np.int64)
        if m <= 0:
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        h = self.stretch(np.arange(n - seed + 1), seed)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        best, span, wide = np.arange(len(h)), 1, window - seed + 1
        while span < wide:  # smallest of twice as many places, the left one if equal
            shift = min(span, wide - span)
            a, b = best[:-shift], best[shift:]
            best = np.where(h[a] <= h[b], a, b)
            span += shift
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.flatnonzero(doc[:m] == doc[window - 1 :])
        anchor = best[at]
        if not len(at):
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[at[1:]] != doc[at[:-1]])]))
        count = np.diff(np.append(new, len(at)))
        start = at[new]
        return h[anchor[new]], self.stretch(start, count + window - 1), doc[start], start - self.first[doc[start]], count


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, pa.int64())


def _runs(window, seed):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = 0
            for texts in batches(part.column("text").to_pylist(), STEP):
                anchor, wording, doc, start, count = Texts(texts).runs(window, seed)
                rows = pa.array(doc + done)
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [_long(anchor), _long(wording), part.column("doc_id").take(rows), part.column("twin").take(rows),
                     pa.array(start, pa.int32()), pa.array(count, pa.int32())],
                    ["anchor", "wording", "doc_id", "twin", "start", "count"],
                )

    return run


def _flat(column: pa.ListArray, name: str) -> np.ndarray:
    return column.flatten().field(name).to_numpy(zero_copy_only=False)


def _extend(window):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = 0
            for texts in batches(part.column("text").to_pylist(), STEP):
                own = part.column("seeds").slice(done, len(texts))
                done += len(texts)
                t = Texts(texts)
                size = own.value_lengths().to_numpy()
                start = _flat(own, "start") + np.repeat(t.first, size)
                count = _flat(own, "count").astype(np.int64)
                at = ranges(start, count)
                place = at - np.repeat(start, count)
                yield pa.RecordBatch.from_arrays(
                    [_long(np.repeat(_flat(own, "anchor"), count)), _long(np.repeat(_flat(own, "wording"), count)),
                     _long(np.repeat(_flat(own, "times"), count)), pa.array(place, pa.int32()), _long(t.stretch(at, window))],
                    ["anchor", "wording", "times", "place", "window"],
                )

    return run


def _cut(window):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = part.column("found").to_pylist()
            removed, total, shas = [], [], []
            for text, own in zip(part.column("text").to_pylist(), found):
                words = (text or "").encode("utf-8", "replace").split()
                n = len(words)
                gone = 0
                if own:
                    start = np.array([f["start"] for f in own])
                    mask = np.array([f["mask"] for f in own], np.int64)
                    row, bit = np.nonzero(mask[:, None] >> np.arange(window) & 1)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, start[row] + bit, 1)
                    np.add.at(edge, start[row] + bit + window, -1)
                    free = np.cumsum(edge[:n]) == 0
                    gone = n - int(free.sum())
                    words = [words[i] for i in np.flatnonzero(free)]
                total.append(n)
                removed.append(gone)
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def dedup_substrings(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row."""
    if not 0 < window - seed + 1 <= 62:
        raise ValueError("a run's windows must fit a 62-bit mask")
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    slim = slim.withColumn("twin", F.hash("text"))  # tells rows with equal ids apart
    runs = slim.mapInArrow(
        _runs(window, seed), f"anchor long, wording long, doc_id {key}, twin int, start int, count int"
    )
    seen = runs.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("wording").alias("_low"), F.max("wording").alias("_high"))
    seen = seen.filter("_n > 1").select(F.col("anchor").alias("_a"), (F.col("_low") != F.col("_high")).alias("mixed"))
    seen = stage_table(seen, "anchors")
    hits = stage_table(runs.join(seen, F.col("anchor") == F.col("_a")).drop("_a"), "hits")
    free_shuffles(spark)

    mixed = hits.filter("mixed")
    wordings = mixed.groupBy("anchor", "wording").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "twin", "start", "count")).alias("at")
    )
    seeds = wordings.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.twin").alias("_twin")).agg(
        F.collect_list(F.struct("anchor", "wording", "times", "at.start", "at.count")).alias("seeds")
    )
    seeds = stage_table(seeds, "seeds")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_twin"))
    one = slim.join(seeds.hint("shuffle_hash"), same)
    windows = one.select("text", "seeds").mapInArrow(
        _extend(window), "anchor long, wording long, times long, place int, window long"
    )
    windows = stage_table(windows, "windows")
    free_shuffles(spark)
    repeats = windows.groupBy("anchor", "window").agg(F.sum("times").alias("_times")).filter("_times > 1")
    repeats = stage_table(repeats.select(F.col("anchor").alias("_a"), F.col("window").alias("_w")), "repeats")
    again = windows.join(repeats, (F.col("anchor") == F.col("_a")) & (F.col("window") == F.col("_w")))
    bit = F.expr("shiftleft(1L, place)")
    masks = again.groupBy("anchor", "wording").agg(F.bit_or(bit).alias("mask"))
    masks = stage_table(masks.select(F.col("anchor").alias("_a"), F.col("wording").alias("_w"), "mask"), "masks")

    whole = hits.filter("NOT mixed").select("doc_id", "twin", "start", F.expr("shiftleft(1L, count) - 1L").alias("mask"))
    part = mixed.join(masks, (F.col("anchor") == F.col("_a")) & (F.col("wording") == F.col("_w")))
    found = whole.unionByName(part.select("doc_id", "twin", "start", "mask"))
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin")).agg(
        F.collect_set(F.struct("start", "mask")).alias("found")
    )
    found = stage_table(found, "found")
    free_shuffles(spark)
    out = slim.join(found.hint("shuffle_hash"), same, "left").select("doc_id", "text", "found")
    return out.mapInArrow(_cut(window), f"doc_id {key}, n_words long, n_removed long, kept_sha256 string")
