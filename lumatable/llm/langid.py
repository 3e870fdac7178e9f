"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that
followed them. A byte costs ``-log2 P``: a context gives a byte it has seen the share
``count / (total + kinds)`` and leaves ``kinds / (total + kinds)`` to escape (method C); an escape
goes to the context shorter by one, among the bytes that the longer one has not seen, down to a
uniform distribution over byte values. Statistics are frozen after training, so every (context,
byte) has one cost and the code length of a text is a sum of table lookups, exact for whole texts.
The table has contexts x alphabet x languages entries; raise ``least`` for many languages.
The language with the shortest code wins; the score is its posterior under a uniform prior of
languages, with code lengths taken per ``UNIT`` bytes so that long texts don't all saturate.

Training uses a bounded sample: the first ``SAMPLE`` different texts per language by their hash
among those allowed, and contexts seen at least ``LEAST`` times. Byte values of the sample form a
compact alphabet; all others share one place in it and split its probability evenly.

Defined results: null text or text without a letter gives ``und`` with score 0; equal code lengths
go to the language that sorts first; with no training rows every text is ``und``; repeated rows are
judged on their own; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage_table

ORDER = 3
SAMPLE = 300
LEAST = 2
UNIT = 16.0
#: Bytes that one step of scoring looks at; bounds its memory whatever the texts' lengths.
STEP = 1_000_000


class ContextTrees:
    """Cost tables of all languages over the union of their contexts."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, least: int = LEAST):
        self.languages, self.order = sorted(samples), order
        joined = {l: np.concatenate([np.frombuffer(b"\0" * order + t, np.uint8) for t in samples[l]]) for l in self.languages}
        seen = np.unique(np.concatenate(list(joined.values())))
        self.alphabet = np.zeros(256, np.int64)  # 0: any byte value not in the sample
        self.alphabet[seen] = np.arange(1, len(seen) + 1)
        self.size = a = len(seen) + 1
        hidden = 256 - len(seen)  # byte values that share place 0
        weight = np.ones(a)
        weight[0] = hidden
        coded = {l: self.alphabet[joined.pop(l)] for l in self.languages}

        def contexts(l, k):
            """The ``k`` bytes before each byte of a language's sample, as one number."""
            c = coded[l]
            g = np.zeros(len(c) - order, np.int64)
            for j in range(order - k, order):
                g = g * a + c[j : j + len(g)]
            return g

        after = {l: c[order:] for l, c in coded.items()}
        uniform = weight / weight.sum()
        shape = (len(self.languages), 1, a)
        lower_keys, lower = np.zeros(1, np.int64), np.broadcast_to(uniform, shape).copy()
        self.keys, self.costs = [], []
        for k in range(order + 1):
            grams = {l: contexts(l, k) for l in self.languages}
            parts = [np.unique(grams[l], return_counts=True) for l in self.languages]
            keys = np.unique(np.concatenate([u[n >= least] if k else u for u, n in parts]))
            if k == 0:
                keys = np.zeros(1, np.int64)
            parent = np.searchsorted(lower_keys, keys % a ** max(k - 1, 0)) if k else np.zeros(1, np.int64)
            table = lower[:, parent].copy()
            for n, l in enumerate(self.languages):
                at = np.searchsorted(keys, grams[l])
                at[at == len(keys)] = 0
                own = keys[at] == grams[l]
                counts = np.bincount(at[own] * a + after[l][own], minlength=len(keys) * a).reshape(len(keys), a).astype(float)
                total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
                rest = np.where(counts > 0, 0, table[n])
                left = rest.sum(1, keepdims=True)
                share = np.where(left > 0, kinds / np.maximum(total + kinds, 1), 0)
                p = counts / np.maximum(total, 1) * (1 - share) + np.where(left > 0, rest / np.maximum(left, 1e-300) * share, 0)
                table[n] = np.where(total > 0, p, table[n])
            self.keys.append(keys)
            self.costs.append(table)
            lower_keys, lower = keys, table
        # one table of nodes, and for every full context the number of its longest kept suffix
        offset, rows = 0, []
        best = np.zeros(1, np.int64)
        for k in range(order + 1):
            best = np.tile(best, a) if k else best
            best[self.keys[k]] = offset + np.arange(len(self.keys[k]))
            bits = -np.log2(np.maximum(self.costs[k], 1e-300))
            if hidden:
                bits[:, :, 0] += np.log2(hidden)
            rows.append(bits)
            offset += len(self.keys[k])
        self.node = best.astype(np.int32)
        self.bits = np.concatenate(rows, axis=1).transpose(1, 2, 0).astype(np.float32).reshape(-1, len(self.languages))
        del self.keys, self.costs

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(texts), len(self.languages)))
        part, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), STEP):  # a piece brings the bytes before it along as context
                piece = t[max(0, at - self.order) : at + STEP]
                part.append((i, b"\0" * max(0, self.order - at) + piece))
                size += len(piece)
                if size >= STEP:
                    self._add(out, part)
                    part, size = [], 0
        self._add(out, part)
        return out

    def _add(self, out, part):
        if not part:
            return
        c = self.alphabet[np.frombuffer(b"".join(p for _, p in part), np.uint8)]
        size = np.array([len(p) for _, p in part])
        begin = np.cumsum(size) - size
        g = np.zeros(len(c) - self.order, np.int64)
        for j in range(self.order):
            g = g * self.size + c[j : j + len(g)]
        bits = self.bits[self.node[g] * self.size + c[self.order :]]
        real = np.ones(len(bits), bool)  # positions that would read across a border are left out
        real[(begin[1:, None] - self.order + np.arange(self.order)).ravel()] = False
        first = begin - np.arange(len(part)) * self.order
        np.add.at(out, [i for i, _ in part], np.add.reduceat(bits[real], first, axis=0, dtype=np.float64))


def fit(docs: DataFrame, sample: int = SAMPLE, text_col="text", lang_col="lang", **options) -> ContextTrees | None:
    """Train on at most ``sample`` different texts of each language in ``docs``."""
    pool = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    pool = pool.filter("lang IS NOT NULL AND text IS NOT NULL AND text != ''")
    pool = pool.withColumn("place", F.xxhash64("text"))
    slim = stage_table(pool.select("lang", "place").distinct(), "hashes")
    small = F.pmod("place", F.lit(1 << 30))
    # of n different hashes, spread evenly, about twice the sample lie in this range; few of n are all in it
    counts = slim.groupBy("lang").agg(F.count("*").alias("_n")).withColumnRenamed("lang", "_lang")
    near = slim.join(F.broadcast(counts), F.col("lang") == F.col("_lang")).filter(small < F.lit(2.0 * sample * (1 << 30)) / F.col("_n"))
    order = Window.partitionBy("lang").orderBy(small, "place")
    taken = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample)
    taken = taken.select(F.col("lang").alias("_lang"), F.col("place").alias("_place"), "rank")
    # bounded by the sample
    texts = pool.join(F.broadcast(taken), (F.col("lang") == F.col("_lang")) & (F.col("place") == F.col("_place")))
    texts = texts.groupBy("lang", "place", "rank").agg(F.min("text").alias("text"))
    samples: dict[str, list[bytes]] = {}
    for r in sorted(texts.collect(), key=lambda r: r["rank"]):
        samples.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "replace"))
    return ContextTrees(samples, **options) if samples else None


def predicted(docs: DataFrame, trees: ContextTrees | None, out: str = "language", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``out``: lang_pred, score."""
    if trees is None:
        return docs.withColumn(out, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double")
    def decide(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = np.array(model.languages, object)
        for texts in parts:
            raw = [t.encode("utf-8", "replace") for t in texts.fillna("")]
            bits = model.code_lengths(raw)
            best = bits.argmin(axis=1)
            gap = (bits - bits.min(axis=1, keepdims=True)) / (np.fromiter(map(len, raw), float, len(raw))[:, None] / UNIT + 1)
            score = 1 / np.exp2(-np.minimum(gap, 500)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": names[best], "score": score})

    letter = F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False))
    said = docs.withColumn("_lang_said", decide(docs[text_col]))
    return said.withColumn(out, F.struct(
        F.when(letter, F.col("_lang_said.lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(letter, F.col("_lang_said.score")).otherwise(0.0).alias("score"),
    )).drop("_lang_said")
