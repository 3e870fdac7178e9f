import functools
import math
from collections import defaultdict

import numpy as np
import pytest
from fixtures import awkward_docs, shared_docs
from lumatable.llm import langid
from lumatable.llm.common import read_table
from pyspark.sql import functions as F


def plain_bits(samples, text, order, least):
    """PPM with method C and exclusion, one byte at a time."""
    count = {l: defaultdict(lambda: defaultdict(int)) for l in samples}
    kept = set()
    for l, texts in samples.items():
        data = b"".join(b"\0" * order + t for t in texts)
        for i in range(order, len(data)):
            for k in range(order + 1):
                count[l][data[i - k : i]][data[i]] += 1
        kept |= {c for c, n in count[l].items() if sum(n.values()) >= least}
    kept.add(b"")
    seen = {b for texts in samples.values() for b in b"".join(b"\0" * order + t for t in texts)}

    @functools.cache
    def p(l, context, byte):
        """Distribution of the longest kept suffix."""
        while context not in kept:
            context = context[1:]
        n = count[l].get(context, {})
        lower = (lambda b: p(l, context[1:], b)) if context else (lambda b: 1 / 256)
        if not n:
            return lower(byte)
        left = sum(lower(b) for b in range(256) if b not in n)
        escape = len(n) / (sum(n.values()) + len(n)) if left > 1e-15 else 0
        return n[byte] / sum(n.values()) * (1 - escape) if byte in n else escape * lower(byte) / left

    data = b"\0" * order + text
    assert seen
    return [sum(-math.log2(p(l, data[i - order : i], data[i])) for i in range(order, len(data))) for l in sorted(samples)]


@pytest.mark.parametrize("order,least", [(1, 1), (2, 1), (2, 2)])
def test_code_lengths_are_exact(order, least):
    samples = {"a": [b"abracadabra", b"cab"], "b": [b"zebra zoo", "zäh".encode()]}
    trees = langid.ContextTrees(samples, order, least)
    texts = [b"", b"a", b"abra zoo", b"Q", "zäh?".encode(), b"abracadabra" * 3]
    want = [plain_bits(samples, t, order, least) if t else [0, 0] for t in texts]
    np.testing.assert_allclose(trees.code_lengths(texts), want, rtol=1e-5, atol=1e-4)


def test_pieces_of_a_long_text_add_up(monkeypatch):
    samples = {"a": [b"the cat sat on the mat"], "b": [b"der hund und die katze"]}
    trees = langid.ContextTrees(samples, 3, 1)
    texts = [b"the hund sat und the katze " * 9, b"x", b"die"]
    whole = trees.code_lengths(texts)
    for step in (3, 4, 7, 100):
        monkeypatch.setattr(langid, "STEP", step)
        np.testing.assert_allclose(trees.code_lengths(texts), whole, rtol=1e-6)


def test_costs_of_a_context_form_a_distribution():
    trees = langid.ContextTrees({"a": [b"abcabcabd"], "b": [b"xyz"]}, 2, 1)
    bits = trees.bits.reshape(-1, trees.size, 2).astype(float)
    p = np.exp2(-bits)
    p[:, 0] *= 256 - (trees.size - 1)
    np.testing.assert_allclose(p.sum(1), 1, rtol=1e-4)


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    trees = langid.fit(docs.filter(~held))
    out = langid.predicted(docs.filter(held), trees).selectExpr("avg(CAST(lang = language.lang_pred AS INT))", "min(language.score)", "max(language.score)").first()
    assert out[0] > 0.97 and 0 <= out[1] <= out[2] <= 1


def test_awkward(spark):
    trees = langid.fit(shared_docs(spark))
    df = awkward_docs(spark).selectExpr("*", "1 AS place", "'x' AS language")
    out = langid.predicted(df, trees)
    assert out.count() == df.count()
    und = out.filter("language.lang_pred = 'und'")
    assert {r["doc_id"] for r in und.collect()} == {1, 2, 3, 15}
    assert und.filter("language.score != 0").count() == 0
    assert langid.predicted(df.limit(0), trees).count() == 0
    assert langid.fit(df.limit(0)) is None
    assert {r[0] for r in langid.predicted(df, None).select("language.lang_pred").collect()} == {"und"}


def test_sample_holds_different_texts_however_often_copied(spark, monkeypatch):
    """By a range of hashes cut by rows, three texts in 120,000 rows were as good as never in it."""
    seen = {}
    monkeypatch.setattr(langid, "ContextTrees", lambda samples, **_: seen.update(samples))
    few = spark.range(120_000).selectExpr("concat('text ', id % 3) AS text", "'aa' AS lang")
    many = spark.range(900).selectExpr("concat('other ', id) AS text", "'bb' AS lang")
    langid.fit(few.unionByName(many).unionByName(many))
    assert sorted(seen["aa"]) == [b"text 0", b"text 1", b"text 2"]
    assert len(seen["bb"]) == len(set(seen["bb"])) == langid.SAMPLE
