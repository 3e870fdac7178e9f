import sys

import numpy as np
import pytest
from fixtures import awkward_docs, sentence, shared_docs
from lumatable.llm import pieces
from sentencepiece import SentencePieceProcessor

ODD = [
    "  a  b\n\tc ﬁ ①  x", "", " ", "\n", "\n\n", "a\n", "\na", "a \n b", "▁x ▁", "<s> x</s>", "x" * 5000, "日本語テキスト です", "   ", "a  ", "  a",
    "\n a", "a\n\nb", "\x00", "😀 a", "aaaa bbb " * 40, "\r\n a\r\nb", "é" * 300, "hello world  " * 30, "▁▁▁", "a▁▁b", "\t\tx", "the" * 200,
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pieces.model_path())


def test_ids_equal_the_library(spark, library):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int, ids string")
    df = df.select("doc_id", "text").unionByName(shared_docs(spark).select("doc_id", "text")).unionByName(awkward_docs(spark).select("doc_id", "text"))
    for r in pieces.encoded(df).collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert r["round_trip"]


def test_clashing_columns_and_empty_table(spark):
    df = awkward_docs(spark).selectExpr("1 AS ids", "*", "2 AS n_tokens", "3 AS round_trip")
    out = pieces.encoded(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids", "round_trip"]
    assert out.count() == df.count() and pieces.encoded(df.limit(0)).count() == 0


def test_decoding_gives_the_text_back(spark):
    df = awkward_docs(spark).filter("text IS NOT NULL AND doc_id != 13")
    back = pieces.decoded(pieces.encoded(df), out="back")
    assert back.filter("NOT (back <=> text)").count() == 0
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["text"] for r in pieces.decoded(nothing).collect()] == [None, ""]


def test_forgetting_units_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(pieces, "KEEP", 5)
    monkeypatch.setattr(pieces, "INDEX", 50)
    encoder = pieces.Encoder(pieces.Vocabulary(pieces.model_path()))
    for k in range(4):
        texts = [sentence(k * 10 + i, 30) for i in range(5)]
        ids, count = encoder.encode(texts)
        assert ids.tolist() == [x for t in texts for x in library.encode(t)] and len(count) == 5


def test_suffix_array_and_ranges():
    text = "abracadabra\nabra"
    codes = np.array([ord(c) for c in text])
    array = pieces.suffix_array(codes, 16)
    assert [text[i:] for i in array] == sorted(text[i:] for i in range(len(text)))
    words = ["a", "abra", "bra", "z", "ra\n", "", "cad", "abracadabra"]
    table = np.zeros((len(words), 11), int)
    for k, w in enumerate(words):
        table[k, : len(w)] = [ord(c) for c in w]
    low, high = pieces.piece_ranges(codes, array, table, np.array([len(w) for w in words]))
    for w, a, b in zip(words, low, high):
        assert sorted(array[a:b]) == [i for i in range(len(text)) if text.startswith(w, i)]


def test_ranges_of_pieces_longer_than_an_integer():
    """Many different characters leave room for few in an integer; the rest of a piece is compared inside its range."""
    rng = np.random.default_rng(5)
    text = "".join(chr(c) for c in [*range(0, 40000, 7), 0x10FFFF]) + "".join(rng.choice(list("ab\x00語"), 4000)) + "ab" * 30
    codes = np.array([ord(c) for c in text])
    words = [text[i : i + n] for i, n in zip(rng.integers(5000, len(text) - 16, 300), rng.integers(1, 17, 300))]
    words += ["ab" * 8, "b" * 16, "a語" * 8, "\x00", "\x00a", "\U0010ffff", "ab\x01", "z" * 16, ""]
    table = np.zeros((len(words), 16), int)
    for k, w in enumerate(words):
        table[k, : len(w)] = [ord(c) for c in w]
    assert pieces.packed(codes, 16, pieces.numbers(codes))[1] == 4
    low, high = pieces.piece_ranges(codes, array := pieces.suffix_array(codes, 16), table, np.array([len(w) for w in words]))
    for w, a, b in zip(words, low, high):
        assert sorted(array[a:b]) == [i for i in range(len(text)) if text.startswith(w, i)]


def test_search_takes_few_passes_over_the_vocabulary():
    """It took about two thirds of the encoder's time, one code and one halving after the other for each of 32,000 pieces."""
    vocabulary = pieces.Vocabulary(pieces.model_path())
    codes = np.array([ord(c) for i in range(60) for c in sentence(i, 60)])
    array, calls = pieces.suffix_array(codes, vocabulary.longest), []
    sys.setprofile(lambda frame, event, what: calls.append(event) if event in ("call", "c_call") else None)
    try:
        pieces.piece_ranges(codes, array, vocabulary.codes, vocabulary.lengths)
    finally:
        sys.setprofile(None)
    assert len(calls) < 250
