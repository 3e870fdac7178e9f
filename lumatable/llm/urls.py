"""URL filters: glob rules run as one bit-parallel (Shift-And) automaton.

All globs are laid out one after the other as bits of a multiword mask, one bit per literal
character plus one start bit each. Reading a character moves every rule's bits at once:

    state = ((state << 1) & accepts[char]) | (state & loops[char])

``*`` is a bit that stays set on any character, ``+`` one that stays set on any but ``/``; ``?``
stands for one character. A rule matches if its last bit is set at the end. URLs advance together,
character by character, the shift carries between words, and URLs that have ended are left behind.

The canonical URL is ``.host/path?query``: no scheme, host in lower case, no fragment. The leading
dot makes ``+.net/*`` fit a host and all of its subdomains and nothing else.

Defined results: null, or no ``://``: host and path empty, canonical URL empty, no rule, allowed
unless a glob fits the empty text. The prefix rule with the longest text wins, then (without one)
any blocking glob blocks. Repeated rows are judged on their own; an empty table gives an empty
result; very long URLs are read to the end; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: (prefix, verdict): host and path in one text, as in ``example.net/en/``.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Globs over the canonical URL that block where no prefix rule decides.
BLOCKED = (
    "*.ads.*", "*.ads-*", "*.adserver.*", "*.banner.*", "*.track.*", "*.tracker.*", "*.doubleclick.*",
    "*/ads/*", "*/advert/*", "*/login*", "*/signin*", "*/cart", "*/cart/*", "*/checkout*",
    "*/wp-admin/*", "*/cgi-bin/*", "*?sessionid=*", "*&sessionid=*", "*?sid=*", "*.exe", "*.zip", "*.apk",
    "*casino*", "*porn*", "*viagra*", "*poker*", "*.xxx/*",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url):
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def canonical(url: Column) -> Column:
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(_rest(url) == "", "").otherwise(F.concat(F.lit("."), host_of(url), path_of(url), query))


class Automaton:
    """The compiled globs: masks of ``words`` 64-bit words."""

    def __init__(self, globs: list[str]):
        plan: list[tuple[str, int]] = []  # (character or kind, glob)
        self.final, start = [], []
        for number, glob in enumerate(globs):
            start.append(len(plan))
            plan.append(("start", number))
            for token in re.findall(r"[*+]+|.", glob, re.S):
                if token[0] in "*+":
                    plan[-1] = (plan[-1][0], number, *plan[-1][2:], "any" if "*" in token else "host")
                elif token == "?":
                    plan.append(("one", number))
                else:
                    # one bit per byte, so that any character can be part of a rule
                    plan += [(bytes([b]), number) for b in token.encode()]
            self.final.append(len(plan) - 1)
        self.bits = len(plan)
        self.words = max(1, -(-self.bits // 64))
        accepts = np.zeros((256, self.words * 64), bool)
        loops = np.zeros((256, self.words * 64), bool)
        for bit, (what, _, *loop) in enumerate(plan):
            if what == "one":
                accepts[:, bit] = True
            elif what != "start":
                accepts[what[0], bit] = True
            if "any" in loop:
                loops[:, bit] = True
            elif "host" in loop:
                loops[:, bit] = True
                loops[ord("/"), bit] = False
        first = np.zeros((1, self.words * 64), bool)
        first[0, start] = True
        self.accepts, self.loops, self.start = map(self._pack, (accepts, loops, first))

    def _pack(self, bits):
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T.copy()

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A boolean row per text, a column per glob."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        at = (np.cumsum(size) - size)[order]
        left = size[order]
        state = np.repeat(self.start, len(texts), axis=1)
        longest = int(left[0]) if len(left) else 0
        alive = np.searchsorted(-left, -np.arange(1, longest + 1), side="right")
        for k in range(longest):
            n = alive[k]
            c = data[at[:n] + k]
            s = state[:, :n]
            moved = s << np.uint64(1)
            moved[1:] |= s[:-1] >> np.uint64(63)
            state[:, :n] = (moved & self.accepts[:, c]) | (s & self.loops[:, c])
        out = np.empty((len(texts), len(self.final)), bool)
        for k, bit in enumerate(self.final):
            out[order, k] = (state[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, blocked=BLOCKED) -> DataFrame:
    """``pages`` with a struct ``url_filter``: host, path, rule, verdict."""
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    auto = Automaton([f"+.{prefix}*" for prefix, _ in ranked] + list(blocked))

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            data = [u.encode("utf-8", "replace") for u in urls]
            hit = auto.match(data)
            # a rule's path starts with a slash; without a path the query would be read as more of the host
            bare = np.fromiter((b"/" not in u.partition(b"?")[0] for u in data), bool, len(data))
            own = hit[:, : len(ranked)] & ~bare[:, None]
            best = np.where(own.any(axis=1), own.argmax(axis=1), -1) if len(ranked) else np.full(len(urls), -1)
            bad = hit[:, len(ranked) :].any(axis=1)
            yield pd.DataFrame({
                "rule": [ranked[b][0] if b >= 0 else None for b in best],
                "verdict": [ranked[b][1] if b >= 0 else "block" if x else "allow" for b, x in zip(best, bad)],
            })

    url = pages[url_col]
    out = pages.withColumn("_url_said", decide(canonical(url)))
    fields = F.struct(
        host_of(url).alias("host"), path_of(url).alias("path"),
        F.col("_url_said.rule").alias("rule"), F.col("_url_said.verdict").alias("verdict"),
    )
    return out.withColumn("url_filter", fields).drop("_url_said")
