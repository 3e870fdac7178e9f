from collections import Counter

import pytest
from compare import diff, duck
from fixtures import awkward_docs
from lumatable.llm import line_dedup, queries


def plain(docs, ratio, least):
    pages, on = Counter(s for s, _ in docs), Counter()
    for s, t in docs:
        on.update((s, line) for line in set((t or "").split("\n")) if line.strip(" \t\n\x0b\x0c\r"))
    out = []
    for s, t in docs:
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (on[s, x] >= least and on[s, x] > ratio * pages[s])]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def check(df, ratio=0.1, least=3):
    got = line_dedup.dedup_lines(df, max_ratio=ratio, min_pages=least)
    assert got.columns == [*[c for c in df.columns if c != "line_dedup"], "line_dedup"]
    got = [(r["text"], *r["line_dedup"]) for r in got.collect()]
    want = plain([(r["source"], r["text"]) for r in df.collect()], ratio, least)
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_sites(spark):
    lines = ["footer", "Cookie notice", "", "  ", "a b", "shared"]
    data = [(s, "\n".join([f"own {s} {i}", *[x for j, x in enumerate(lines) if (i + j) % (j + 1) == 0], "tail", "tail"])) for s in ("x", "y", None) for i in range(12)]
    data += [("small", "footer\nfooter"), ("small", "footer"), ("z", None), ("z", ""), ("z", "\n\n"), ("z", "a\r\nfooter")]
    df = spark.createDataFrame(data, "source string, text string")
    for ratio, least in ((0.3, 3), (0.0, 1), (1.0, 1)):
        check(df, ratio, least)
    assert any(r[2] for r in check(df))


def test_awkward(spark):
    check(awkward_docs(spark).selectExpr("*", "'x' AS site", "'y' AS lines", "1 AS line_dedup", "2 AS _on"))
    check(awkward_docs(spark), 0.0, 1)
    check(awkward_docs(spark).limit(0))


def test_boilerplate_too_large_to_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(awkward_docs(spark), 0.0, 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_documents(spark, sf):
    got = queries.op1_line_dedup(spark, f"/root/testdata/{sf}").toPandas()
    assert diff(got, duck(f"/root/testdata/{sf}").sql(queries.ORACLE["op1_line_dedup"]).df()) is None
