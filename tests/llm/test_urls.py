import re

import pytest
from compare import diff, duck
from lumatable.llm import queries, urls

ODD = [
    None, "", "no scheme", "http://", "http://example.net", "http://example.net/", "HTTP://EXAMPLE.NET/En/x", "http://a.example.net/en/?q=1#f",
    "http://notexample.net/en/", "https://example.com/de/", "https://example.com/DE/", "x://y://z.net/a", "http://host.org/fr/x", "http://host.org?/fr/",
    "http://host.org#/fr/", "http://net/", "http://é.ÉX.net/ü", "http://a.com/ads/x", "http://ads.a.com/", "http://a.com/x?sid=1", "http://a.com/x.exe",
    "http://a.com/x.exe?y", "http://" + "a" * 70_000 + ".net/" + "b" * 1000, "http://h/p.net/x/.net/", "http://a.b:80/net/", "http://\x00.net/",
    "http://a.com?ref=www.b.net/x", "http://a.com?x=.org/fr/", "http://b.net?x/", "http://b.net#/", "http://?.net/",
]


def plain_match(glob, text):
    kinds = {"*": b".*", "+": b"[^/]*", "?": b"."}
    pattern = b"".join(kinds.get(c) or re.escape(c.encode()) for c in glob)
    return re.fullmatch(pattern, text, re.S) is not None


def test_automaton_against_regular_expressions():
    globs = ["*", "", "a*b", "+/x", "?b?", "*é*", "a*b*c*d", "**x", "+", "*+*", "x" * 130, "*" + "y" * 70 + "*", *urls.BLOCKED, "a+b*/c"]
    texts = [b"", b"ab", b"aXXb", b"q/x", b"q/q/x", b"abc", "née".encode(), b"abcabcdd", b"x", b"x" * 130, b"x" * 129, b"z" + b"y" * 71, b"a.b/c", b"a/b/c", "é".encode()]
    texts += [u.encode() for u in ODD if u]
    got = urls.Automaton(globs).match(texts)
    for t, row in zip(texts, got):
        for g, hit in zip(globs, row):
            assert hit == plain_match(g, t), (g, t[:60])
    assert urls.Automaton(globs).match([]).shape == (0, len(globs))


def plain(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in urls.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    query = re.match(r"[^#]*", rest[len(host) + len(path) :])[0]
    canonical = f".{host}{path}{query}".encode() if rest else b""
    bad = any(plain_match(g, canonical) for g in urls.BLOCKED)
    return host, path, best and best[0], best[1] if best else "block" if bad else "allow"


def test_awkward(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(ODD)], "page_id long, url string, verdict string")
    got = {r[0]: tuple(r[1:]) for r in urls.judge_urls(df).select("page_id", "url_filter.*").collect()}
    for i, u in enumerate(ODD):
        assert got[i] == plain(u), u
    assert urls.judge_urls(df).columns == [*df.columns, "url_filter"]
    assert urls.judge_urls(df.limit(0)).count() == 0
    assert urls.judge_urls(df, rules=(), blocked=()).filter("url_filter.verdict = 'allow'").count() == len(ODD)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_pages(spark, sf):
    got = queries.op4_url_filters(spark, f"/root/testdata/{sf}").toPandas()
    assert diff(got, duck(f"/root/testdata/{sf}").sql(queries.ORACLE["op4_url_filters"]).df()) is None
