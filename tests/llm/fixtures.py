"""Small tables with the awkward rows every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def sentence(seed, n, vocabulary=900):
    """n words, the same for the same seed."""
    state, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        k = (state >> 8) % vocabulary
        out.append("w" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10 % 10] + "uvwxyzéüñß"[k // 100])
    return " ".join(out)


def awkward_docs(spark, extra=()):
    """Nulls in every column, empty, blank, one-word, very long and repeated rows, odd characters."""
    passage = sentence(7, 50)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", None, "a", 7), (4, "word", "de", None, 4),
        (None, "no id here. " * 3, "en", "a", None), (6, sentence(1, 4000), "en", "b", None),
        (7, f"{sentence(2, 40)}\n{passage}\n{sentence(3, 40)}", "en", "a", None),
        (8, f"{sentence(4, 30)} {passage} {sentence(5, 20)}", "en", None, None),
        (9, sentence(6, 120), "de", "b", None), (9, sentence(6, 120), "de", "b", None), (9, sentence(8, 60), "fr", "c", None),
        (10, sentence(6, 120), None, "c", None), (11, "same same " * 60, "en", "a", None),
        (12, "a b c " * 30 + sentence(9, 45), "en", "a", None), (13, "É é x ▁y <s> #2 \U0001f600 \x00 tab\tend", "fr", "é", None),
        (14, sentence(6, 118) + " other end", "de", "b", None), (15, "!" * 500, "en", "b", None),
        (16, sentence(2, 34), "en", "a", None), (17, sentence(2, 35), "en", "a", None),
        (18, "x" * 30_000, "en", "a", None),
        *extra,
    ]
    return spark.createDataFrame(rows, DOCS)


def shared_docs(spark, n=400):
    """The first documents of the smallest given table, texts whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n)


def rows(df, *columns):
    """Sorted rows, nulls first."""
    out = [tuple(r[c] for c in (columns or df.columns)) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))
