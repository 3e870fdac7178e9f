import hashlib
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward_docs, rows, sentence, shared_docs
from lumatable.llm.substrings import Texts, dedup_substrings


def plain(docs, window=35):
    """Count every window of every document in one dictionary."""
    split = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def check(df):
    got = dedup_substrings(df)
    want = plain([(r["doc_id"], r["text"]) for r in df.collect()])
    assert rows(got) == want
    return want


def test_given_documents(spark):
    assert sum(r[2] for r in check(shared_docs(spark))) > 0


def test_awkward(spark):
    found = {r[0]: r for r in check(awkward_docs(spark))}
    assert found[7][2] == 85 and found[16][2] == 0 and found[17][2] == 35


def test_many_wordings_of_one_passage(spark):
    """Copies of a passage with other words around it, cut at different places."""
    p = sentence(50, 90).split()
    texts = [(i, " ".join([sentence(100 + i, 20), *p[i % 30 : 90 - i % 17], sentence(300 + i, 20)])) for i in range(60)]
    texts += [(100 + i, " ".join(p[i : i + 40])) for i in range(0, 50, 5)]
    check(spark.createDataFrame(texts, "doc_id long, text string").repartition(5))


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, anchor int, found string")
    assert dedup_substrings(df).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    check(df)
    check(awkward_docs(spark).selectExpr("doc_id", "text", "1 AS anchor", "'x' AS found", "2 AS twin", "doc_id AS start"))


@pytest.mark.parametrize("n", [0, 34, 35, 36, 100])
def test_runs_cover_every_window_once(n):
    anchor, _, doc, start, count = Texts([sentence(1, n), sentence(2, 40)]).runs(35, 12)
    covered = [(d, s + k) for d, s, c in zip(doc, start, count) for k in range(c)]
    assert sorted(covered) == [(0, i) for i in range(max(0, n - 34))] + [(1, i) for i in range(6)]
    assert np.all(count <= 24) and len(anchor) == len(doc)
