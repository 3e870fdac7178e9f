from collections import Counter

import numpy as np
import pytest
from fixtures import awkward_docs, sentence, shared_docs
from lumatable.llm import quality
from lumatable.llm.common import read_table

SPACES = " \t\n\x0b\x0c\r"
SF = "/root/testdata/sf0.001"


def words_of(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_counts(text):
    """The base rules, character by character and window by window."""
    text = text or ""
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed)


def plain_viterbi(scores, stay):
    """Try every labelling."""
    best = None
    for code in range(2 ** len(scores)):
        y = [code >> i & 1 for i in range(len(scores))]
        total = sum(s for s, v in zip(scores, y) if v) + stay * sum(a == b for a, b in zip(y, y[1:]))
        if best is None or total > best[0] + 1e-12:
            best = total, y
    return best[0]


@pytest.fixture(scope="module")
def labels(spark):
    return read_table(spark, SF, "labels")


def check(df, labels):
    got = quality.judged(df, labels)
    assert got.columns == [*df.columns, "quality"]
    for r in got.select("text", "quality.*").collect():
        assert tuple(r[1:7]) == plain_counts(r["text"]), r["text"][:80]
        assert not (r["base_failed"] and r["kept"])
    return got


def test_base_rules(spark, labels):
    check(shared_docs(spark), labels)
    awkward = awkward_docs(spark).selectExpr("*", "1 AS kept", "2 AS n_lines", "3 AS _text")
    assert check(awkward, labels).filter("text IS NULL AND quality.kept").count() == 0
    check(awkward_docs(spark).limit(0), labels)


def test_without_labels(spark, labels):
    out = check(shared_docs(spark, 40), labels.limit(0)).select("quality.kept").collect()
    assert any(r[0] for r in out)


def test_labelled_documents(spark, labels):
    """Good documents stay, bad ones go."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    known = read_table(spark, "/root/testdata/sf0.01", "labels")
    out = quality.judged(docs, known, out="said").join(known, "doc_id").filter("NOT said.base_failed")
    out = out.selectExpr("quality = 1 AS good", "CAST(said.kept AS INT) AS kept").groupBy("good").avg("kept")
    share = {r[0]: r[1] for r in out.collect()}
    assert share[True] > 0.98 and share[False] < 0.4


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    lengths = [1, 9, 4, 1, 7, 2]
    scores = rng.normal(size=sum(lengths)) * 2
    owner = np.repeat([0, 2, 3, 5, 8, 9], lengths)
    for stay in (0.0, 0.7, 3.0):
        got = quality.viterbi(scores, owner, stay)
        at = 0
        for n in lengths:
            s, y = scores[at : at + n], got[at : at + n]
            total = s[y == 1].sum() + stay * (y[1:] == y[:-1]).sum()
            assert total == pytest.approx(plain_viterbi(list(s), stay))
            at += n
    assert len(quality.viterbi(np.zeros(0), np.zeros(0, int), 1.0)) == 0


def test_training_separates_and_needs_both_classes():
    rng = np.random.default_rng(1)
    make = lambda good, n: np.column_stack([np.ones(n), *(rng.random(n) * (0.02 if good else 0.3) for _ in range(8))])
    good = [True] * 40 + [False] * 40
    chains = [make(g, int(rng.integers(1, 12))) for g in good]
    w, stay = quality.train(chains, good)
    right = [(quality.viterbi(c @ w, np.zeros(len(c), int), stay).mean() >= 0.5) == g for c, g in zip(chains, good)]
    assert np.mean(right) > 0.95
    assert tuple(quality.train(chains[:40], good[:40])[0]) == quality.PRIOR


@pytest.mark.parametrize("rare", [True, False])
def test_weights_leave_the_prior_by_degrees(rare):
    """One rule at every sample size: 0, 1, 3, 11, 60 and 400 documents of the rarer class."""
    rng = np.random.default_rng(2)
    make = lambda good: np.column_stack([np.ones(3), *(rng.random(3) * (0.02 if good else 0.3) for _ in range(8))])
    far = []
    for n in (0, 1, 3, 11, 60, 400):
        good = [not rare] * 400 + [rare] * n
        w, stay = quality.train([make(g) for g in good], good)
        far.append(np.abs(w - quality.PRIOR).sum() + abs(stay - quality.PRIOR_STAY))
    assert far[0] == 0 < far[1] and far == sorted(far)
    assert all(b - a < 0.75 * far[-1] for a, b in zip(far, far[1:]))
    assert tuple(quality.train([], [])[0]) == quality.PRIOR


def test_repeated_windows_across_texts_do_not_count():
    ids = np.array([*range(12), *range(12), 1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 6, 7, 8])
    assert quality.repeated_words(ids, np.array([12, 12, 16]), 8).tolist() == [0, 0, 16]
    assert quality.repeated_words(np.zeros(9, int), np.array([0, 9, 0]), 8).tolist() == [0, 9, 0]
    assert len(sentence(1, 5).split()) == 5
