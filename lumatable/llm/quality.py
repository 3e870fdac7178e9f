"""Quality rules: counted base rules, then a linear-chain CRF that labels lines.

Each line of a text is content or boilerplate. A conditional random field with two labels scores
the line's features and the step from one label to the next; Viterbi decoding gives the best
labelling of the whole text, and the share of word characters in content lines decides whether the
text is kept.

The field is trained on a bounded sample of labelled documents (``SAMPLE`` per class, in the order
of a hash of their id): lines of good documents count as content, lines of bad ones as boilerplate.
Only line features reach the driver. The weights are drawn to ``PRIOR`` with the weight of ``PULL``
documents: without labels of both classes they are the prior, and the more labels, the less it counts.

Defined results: null or wordless text has all counts 0, fails the base rules and is not kept;
rows with equal ids are judged on their own; an empty table gives an empty result; whole texts are
read whatever their length; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import WordIds, give_back

SAMPLE = 400
#: Characters of texts judged together: the arrays of a step hold some hundred bytes for each.
STEP = 500_000
#: Weight of the prior, in documents: each labelled one counts 1 against it, at every sample size.
PULL = 1.6
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
MIN_CONTENT = 0.5
SYMBOLS = "#*$%&|<>"
WORDLESS = " \t\n\x0b\x0c\r"

#: Features of a line, in this order: see :func:`line_features`.
FEATURES = ("bias", "symbols", "upper", "digits", "marks", "sentence_end", "length", "word_length", "commas")
#: Score of "content" minus score of "boilerplate" by feature, and the gain for staying in a label.
PRIOR = (0.8, -8.0, -4.0, -4.0, -3.0, 0.5, 0.2, 0.0, 0.2)
PRIOR_STAY = 1.0
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"
)


def _class_table():
    """Per byte value: is it a symbol, upper case, a digit, a mark, a comma or full stop, a space."""
    t = np.zeros((6, 256), np.uint8)
    t[0, [ord(c) for c in SYMBOLS]] = 1
    t[1, 65:91] = 1
    t[2, 48:58] = 1
    t[3, [ord(c) for c in "!?=_/\\{}[]()~^@+"]] = 1
    t[4, [ord(c) for c in ".,;:"]] = 1
    t[5, [ord(c) for c in WORDLESS]] = 1
    return t


CLASSES = _class_table()
ENDS = np.isin(np.arange(256), [ord(c) for c in ".?!\"'"])


def line_features(texts: list[bytes]):
    """Feature rows of all non-empty lines, their text number and their word characters (bytes)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.cumsum(sizes + 1) - sizes - 1
    owner = np.searchsorted(at, starts, side="right") - 1
    sums = []
    for table in CLASSES:
        c = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        sums.append(c[ends] - c[starts])
    symbols, upper, digits, marks, stops, spaces = sums
    length = ends - starts
    solid = length - spaces
    has = np.flatnonzero(solid > 0)
    n = np.maximum(solid[has], 1)
    last = data[np.maximum(ends[has] - 1, 0)]
    x = np.empty((len(has), len(FEATURES)))
    x[:, 0] = 1
    for k, s in enumerate((symbols, upper, digits, marks), 1):
        x[:, k] = s[has] / n
    x[:, 5] = ENDS[last]
    x[:, 6] = np.minimum(np.log1p(n) / 5, 2)
    x[:, 7] = np.minimum(n / (spaces[has] + 1) / 10, 3)
    x[:, 8] = np.minimum(stops[has] / n * 20, 2)
    return x, owner[has], n


def viterbi(scores: np.ndarray, owner: np.ndarray, stay: float) -> np.ndarray:
    """Best labels (1: content) of the chains of lines given by ``owner`` (ascending).

    ``scores`` is the score of content minus that of boilerplate. All chains advance together, the
    longest first, so a step costs one array operation over the chains that still run.
    """
    labels = np.zeros(len(scores), np.int8)
    if not len(scores):
        return labels
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    length = np.diff(np.append(first, len(owner)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    best = np.zeros((len(first), 2))
    came = np.zeros((len(scores), 2), np.int8)
    best[:, 1] = scores[first]
    for t in range(1, length[0]):
        n = alive[t]
        b, at = best[:n], first[:n] + t
        to0 = b[:, 1] > b[:, 0] + stay
        to1 = b[:, 1] + stay >= b[:, 0]
        came[at, 0], came[at, 1] = to0, to1
        zero = np.where(to0, b[:, 1], b[:, 0] + stay)
        one = np.where(to1, b[:, 1] + stay, b[:, 0]) + scores[at]
        best[:n, 0], best[:n, 1] = zero, one
    labels[first + length - 1] = best[:, 1] >= best[:, 0]
    for t in range(length[0] - 1, 0, -1):
        at = first[: alive[t]] + t
        labels[at - 1] = came[at, labels[at]]
    return labels


def train(features: list[np.ndarray], good: list[bool], rounds: int = 150, rate: float = 0.2):
    """Weights and stay gain that maximise the likelihood of the labelled chains."""
    w, stay = np.array(PRIOR, float), float(PRIOR_STAY)
    if not sum(map(len, features)):
        return w, stay  # no line to learn from: the prior is the answer
    order = np.argsort([-len(f) for f in features], kind="stable")
    length = np.array([len(features[i]) for i in order])
    x = np.concatenate([features[i] for i in order])
    y = np.repeat(np.array([good[i] for i in order], float), length)
    first = np.cumsum(length) - length
    alive = [int((length > t).sum()) for t in range(length[0])]
    # both classes count as much as the smaller one: a single class says nothing about the border
    most = np.array([len(good) - sum(good), sum(good)])
    weight = most.min() / np.maximum(most, 1)[np.array(good, int)[order]]
    whole = weight.sum() + PULL
    each = np.repeat(weight / np.maximum(length, 1), length)  # a text counts once, however many lines it has
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    steps = np.maximum(length - 1, 0).sum()
    same = weight * (length - 1) / np.maximum(length, 1)
    for k in range(1, rounds + 1):
        s = x @ w
        # forward and backward log sums over both labels
        f, b = np.zeros((len(s), 2)), np.zeros((len(s), 2))
        f[first, 1] = s[first]
        for t in range(1, length[0]):
            at = first[: alive[t]] + t
            p = f[at - 1]
            f[at, 0] = np.logaddexp(p[:, 0] + stay, p[:, 1])
            f[at, 1] = np.logaddexp(p[:, 0], p[:, 1] + stay) + s[at]
        for t in range(length[0] - 1, 0, -1):
            at = first[: alive[t]] + t
            n0, n1 = b[at, 0], b[at, 1] + s[at]
            b[at - 1, 0] = np.logaddexp(n0 + stay, n1)
            b[at - 1, 1] = np.logaddexp(n0, n1 + stay)
        post = 1 / (1 + np.exp(np.clip((f[:, 0] + b[:, 0]) - (f[:, 1] + b[:, 1]), -50, 50)))
        grad = x.T @ ((y - post) * each)
        gs = 0.0
        if steps:
            prev = np.flatnonzero(np.isin(np.arange(len(s)), first, invert=True)) - 1
            z = np.logaddexp(f[prev, 0] + b[prev, 0], f[prev, 1] + b[prev, 1])
            nxt = prev + 1
            keep = np.exp(np.clip(f[prev, 0] + stay + b[nxt, 0] - z, -50, 0)) + np.exp(
                np.clip(f[prev, 1] + stay + s[nxt] + b[nxt, 1] - z, -50, 0)
            )
            gs = same.sum() - (keep * each[prev]).sum()
        g = (np.append(grad, gs) - PULL * (np.append(w, stay) - np.append(PRIOR, PRIOR_STAY))) / whole
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, stay = w + step[:-1], max(0.0, stay + step[-1])
    return w, stay


def _features(texts: pd.Series) -> pd.Series:
    out = []
    for some in batches(texts.fillna("").tolist()):
        x, owner, _ = line_features([t.encode("utf-8", "replace") for t in some])
        edge = np.searchsorted(owner, np.arange(len(some) + 1))
        out += [x[a:b].tolist() for a, b in zip(edge, edge[1:])]
    return pd.Series(out, dtype=object)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col="text"):
    """Train on at most ``sample`` labelled documents of each class."""
    labels = labels.select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("_good")).dropna()
    parts = []
    for good in (True, False):
        own = labels.filter(F.col("_good") == F.lit(good)).distinct()
        parts.append(own.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample))
    chosen = parts[0].unionByName(parts[1])  # 2 * sample rows at most, hence the broadcast
    found = docs.select(F.col("doc_id").alias("_id"), F.col(text_col).alias("_text"))
    # an id that occurs more than once gives one text, which keeps the sample bounded
    rows = found.join(F.broadcast(chosen), "_id").groupBy("_id", "_good").agg(F.max("_text").alias("_text"))
    rows = rows.select("_good", F.pandas_udf(_features, "array<array<double>>")("_text").alias("x"))
    # not filtered by x in Spark, which would move that below the join and label every document
    rows = [r for r in rows.collect() if r["x"]]
    rows.sort(key=lambda r: (r["_good"], r["x"]))
    return train([np.array(r["x"]) for r in rows], [r["_good"] for r in rows])


def repeated_words(ids: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Per text, the words in windows of ``width`` words that occur twice or more in that text."""
    n_docs, n = len(counts), len(ids)
    doc = np.repeat(np.arange(n_docs), counts)
    if n < width:
        return np.zeros(n_docs, np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    m = n - width + 1
    h = np.zeros(m, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x100000001B3) + mixed[k : k + m]
    h = (h ^ (h >> np.uint64(31))) + doc[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(doc[:m] == doc[width - 1 :])
    at = at[np.argsort(h[at], kind="stable")]
    a, b = at[:-1], at[1:]
    twin = np.flatnonzero((h[a] == h[b]) & (doc[a] == doc[b]))
    a, b = a[twin], b[twin]
    for k in range(width):  # hashes only proposed these
        same = ids[a + k] == ids[b + k]
        a, b = a[same], b[same]
    cover = np.zeros(n + 1, np.int64)
    hit = np.unique(np.concatenate([a, b]))
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    return np.bincount(doc, np.cumsum(cover[:n]) > 0, n_docs).astype(np.int64)


def judge(texts: list, w: np.ndarray, stay: float, min_content: float) -> dict:
    texts = ["" if t is None else t for t in texts]
    raw = [t.encode("utf-8", "replace") for t in texts]
    words = [t.split() for t in raw]  # bytes split at exactly the six characters of WORDLESS
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ids = WordIds().of([w for ws in words for w in ws])
    repeated = repeated_words(ids, counts, WINDOW)
    dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(WORDLESS)]
        dup.append(len(lines) - len(set(lines)))
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    chars = np.array([len(t) - sum(map(t.count, WORDLESS)) for t in texts], np.int64)
    x, owner, size = line_features(raw)
    label = viterbi(x @ w, owner, stay)
    n_lines = np.bincount(owner, minlength=len(texts))
    n_content = np.bincount(owner, label, len(texts)).astype(np.int64)
    total = np.bincount(owner, size, len(texts))
    share = np.bincount(owner, size * label, len(texts)) / np.maximum(total, 1)
    failed = (counts < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * counts)
    return {
        "n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": repeated, "base_failed": failed, "n_lines": n_lines, "n_content_lines": n_content,
        "content_share": share, "kept": ~failed & (share >= min_content),
    }


def quality_verdict(model, min_content: float = MIN_CONTENT):
    """A function of a text column giving the struct ``SCHEMA``."""
    w, stay = model

    @F.pandas_udf(SCHEMA)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        parts = []
        values = texts.where(texts.notna(), None).tolist()
        for some in batches(values, STEP):
            parts.append(pd.DataFrame(judge(some, w, stay, min_content)))
        give_back()
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(judge([], w, stay, min_content))

    return verdict


def batches(values: Iterable, limit: int = 2_000_000):
    """Cut a list of texts where ``limit`` characters are reached."""
    part, size = [], 0
    for v in values:
        part.append(v)
        size += len(v) if v else 0
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def judged(docs: DataFrame, labels: DataFrame, out: str = "quality", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the struct column ``out`` (see ``SCHEMA``)."""
    return docs.withColumn(out, quality_verdict(fit(docs, labels, text_col=text_col), **options)(F.col(text_col)))
