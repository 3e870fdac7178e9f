"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into units no piece can cross (before a space mark that follows another
character, and around line feeds, which are in no piece); each different unit is encoded once per
task. New units are concatenated and indexed by a suffix array over as many characters as the
longest piece has. Every piece of the vocabulary is found by binary search: its range in the array
is the list of its occurrences. Occurrences are edges (place, length, rank); laid out by place they
tell in one step whether two neighbouring tokens join to a piece, and how early.

The given vocabulary is a byte-pair model, whose encoding is defined by merges and not by the best
path. So edges are relaxed in merge order: in every unit the neighbours whose edge has the best
score (the left one if equal) become one token, until no edge joins two tokens. All units take a
step at once; very long units are merged with a heap. Characters without a piece become bytes.

Defined results: null text is the empty text and gives no ids; the space mark U+2581 in a text reads
as a space after decoding, everything else comes back byte for byte; texts of any length are encoded
whole; repeated rows are encoded on their own; an empty table gives an empty result; other columns
are kept.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import give_back, ranges
from .quality import batches

MARK = "▁"
KEEP = 300_000
#: Characters of texts taken together, and of new units that are indexed at once.
STEP, INDEX = 400_000, 200_000
#: Units longer than this are merged with a heap.
LONG = 200
SAFE = re.compile(f"(?<=[^{MARK}])(?={MARK})")
FAR = np.iinfo(np.int32).max


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Vocabulary:
    """Pieces in the order of their scores, and bytes of every id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        plain.sort(key=lambda i: (-sp.get_score(i), i))
        self.ids = np.array(plain, np.int32)  # by rank
        self.texts = [sp.id_to_piece(i) for i in plain]
        self.bytes_ = np.zeros(256, np.int32)
        self.raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.bytes_[value], self.raw[i] = i, bytes([value])
        for i, text in zip(plain, self.texts):
            self.raw[i] = text.replace(MARK, " ").encode()
        self.lengths = np.array([len(t) for t in self.texts])
        self.longest = int(self.lengths.max())
        self.codes = np.zeros((len(plain), self.longest), np.int64)
        for k, text in enumerate(self.texts):
            self.codes[k, : len(text)] = [ord(c) for c in text]

    def decode(self, ids: list[int]) -> bytes:
        """The text; the space put before it when encoding is taken off."""
        text = b"".join(map(self.raw.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


def numbers(codes: np.ndarray) -> np.ndarray:
    """A table from code to its number 1, 2, ... among those in ``codes``, 0 for all others."""
    seen = np.unique(codes)
    table = np.zeros(0x110000, np.int64)
    table[seen] = np.arange(1, len(seen) + 1)
    return table


def packed(codes: np.ndarray, depth: int, table: np.ndarray) -> tuple[np.ndarray, int, int]:
    """At each place the numbers of as many codes as fit into one integer, first ones highest.

    Zeros stand for what follows the end. Also returns how many codes that are (at most ``depth``)
    and the bits of one.
    """
    bits = int(table.max()).bit_length()
    per = min(63 // bits, depth)
    padded = np.concatenate([table[codes], np.zeros(per, np.int64)])
    word = np.zeros(len(codes), np.int64)
    for k in range(per):
        word = word << bits | padded[k : k + len(codes)]
    return word, per, bits


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` codes that begin there (missing ones sort first)."""
    rank, span, _ = packed(codes, depth, numbers(codes))
    while span < depth:  # ranks of twice as many codes from pairs of ranks
        rank = np.unique(rank, return_inverse=True)[1] + 1
        after = np.zeros_like(rank)
        after[:-span] = rank[span:]
        rank = rank * (rank.max() + 1) + after
        span *= 2
    return np.argsort(rank, kind="stable")


def piece_ranges(codes: np.ndarray, array: np.ndarray, pieces: np.ndarray, lengths: np.ndarray):
    """For each piece, the first place in the array whose text is not less, and where it ends.

    Codes are compared many at once, packed into integers; both ends are equal for a piece that occurs nowhere.
    """
    table = numbers(codes)
    word, per, bits = packed(codes, pieces.shape[1], table)
    low, high = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    number = table[pieces]
    inside = np.arange(pieces.shape[1]) < lengths[:, None]
    left = np.flatnonzero(((number > 0) | ~inside).all(1))  # pieces of known codes only
    high[left] = len(array)
    word = np.concatenate([word, np.zeros(pieces.shape[1] + per, np.int64)])
    for done in range(0, pieces.shape[1], per):
        left = left[(low[left] < high[left]) & ((lengths[left] > done) | (done == 0))]
        least, most = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for k in range(done, done + per):  # any code may follow the piece
            here = inside[left, k] if k < pieces.shape[1] else np.zeros(len(left), bool)
            code = number[left, min(k, pieces.shape[1] - 1)]
            least = least << bits | np.where(here, code, 0)
            most = most << bits | np.where(here, code, (1 << bits) - 1)
        if done == 0:
            first = word[array]
            low[left], high[left] = np.searchsorted(first, least), np.searchsorted(first, most, side="right")
        else:
            bounds = low[left], high[left]
            low[left] = _bound(word, array + done, *bounds, least)
            high[left] = _bound(word, array + done, *bounds, most + 1)
    return low, high


def _bound(word, places, low, high, least):
    """The first row in each [low, high) whose word is not less than ``least``, or ``high``."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        less = word[places[mid]] < least[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
    return low


def edge_table(codes: np.ndarray, words: Vocabulary) -> np.ndarray:
    """Rank of the piece at each place by its length, ``FAR`` where there is none."""
    array = suffix_array(codes, words.longest)
    low, high = piece_ranges(codes, array, words.codes, words.lengths)
    here = np.flatnonzero(low < high)
    low, found = low[here], (high - low)[here]
    table = np.full((len(codes), words.longest + 1), FAR, np.int32)
    table[array[ranges(low, found)], np.repeat(words.lengths[here], found)] = np.repeat(here, found)
    return table


def _heap_merge(table, start: int, stop: int) -> list[int]:
    """Token starts of one unit, merged pair by pair."""
    n, width = stop - start, table.shape[1]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def rank(i):
        j = after[i]
        if j >= n:
            return FAR
        size = after[j] - i
        return int(table[start + i, size]) if size < width else FAR

    heap = [(r, i, i + 1, i + 2) for i in range(n) if (r := rank(i)) != FAR]
    heapq.heapify(heap)
    while heap:
        r, i, j, end = heapq.heappop(heap)
        if not alive[i] or after[i] != j or j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        for x in (before[i], i):
            if x >= 0 and (r := rank(x)) != FAR:
                heapq.heappush(heap, (r, x, after[x], after[after[x]]))
    return [start + i for i in range(n) if alive[i]]


def merge_units(table: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """True at every place where a token begins. Units are [start, stop), none empty."""
    begins = np.zeros(len(table) + 1, bool)
    long_ = stop - start > LONG
    for a, b in zip(start[long_].tolist(), stop[long_].tolist()):
        begins[_heap_merge(table, a, b)] = True
    start, stop = start[~long_], stop[~long_]
    token = ranges(start, stop - start)
    unit = np.repeat(np.arange(len(start)), stop - start)
    width = table.shape[1]
    while len(token):
        # a token's end is the next token's begin, or the end of its unit
        same = unit[1:] == unit[:-1]
        end = np.append(np.where(same, token[1:], stop[unit[:-1]]), stop[unit[-1]])
        pair_end = np.append(end[1:], 0)
        size = np.where(np.append(same, False), pair_end - token, width)
        rank = np.where(size < width, table[token, np.minimum(size, width - 1)], FAR)
        first = np.flatnonzero(np.append(True, ~same))
        best = np.minimum.reduceat(rank, first)
        count = np.diff(np.append(first, len(token)))
        hit = np.flatnonzero((rank == np.repeat(best, count)) & (rank != FAR))
        left = hit[np.append(True, unit[hit[1:]] != unit[hit[:-1]])] if len(hit) else hit
        over = np.repeat(best == FAR, count)
        begins[token[over]] = True
        stay = ~over
        stay[left + 1] = False
        token, unit = token[stay], unit[stay]
    return begins[:-1]


class Encoder:
    """Ids of texts; every different unit is encoded once."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.clear()

    def clear(self):
        # a unit that is looked up for the first time takes the next number
        self.known: dict = defaultdict(itertools.count().__next__)
        self.flat = np.zeros(0, np.int32)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.cumsum(size + 1) - size - 1
        table = edge_table(codes, self.words)
        begins = merge_units(table, start, start + size)
        token = np.flatnonzero(begins)
        owner = np.searchsorted(start, token, side="right") - 1
        end = np.minimum(np.append(token[1:], len(codes)), (start + size)[owner])
        rank = table[token, np.minimum(end - token, table.shape[1] - 1)]
        lost = np.flatnonzero(rank == FAR)
        ids = np.where(rank == FAR, 0, self.words.ids[np.where(rank == FAR, 0, rank)])
        count = np.ones(len(token), np.int64)
        if len(lost):  # characters without a piece: one id per byte
            raw = [joined[p].encode("utf-8", "surrogatepass") for p in token[lost].tolist()]
            count[lost] = [len(b) for b in raw]
            out = np.repeat(ids, count)
            out[ranges((np.cumsum(count) - count)[lost], count[lost])] = self.words.bytes_[np.frombuffer(b"".join(raw), np.uint8)]
            ids = out
        return ids.astype(np.int32), np.bincount(owner, count, len(texts)).astype(np.int64)

    def _learn(self) -> None:
        """Encode the units that were numbered since the last time."""
        new = list(itertools.islice(reversed(self.known), len(self.known) - len(self.start)))[::-1]
        texts = [u[0] if isinstance(u, tuple) else u if u[:1] == "\n" else MARK + u for u in new]
        parts, counts = [self.flat], [self.count]
        for some in batches(texts, INDEX):
            ids, count = self._encode(some)
            parts.append(ids)
            counts.append(count)
        self.flat, self.count = np.concatenate(parts), np.concatenate(counts)
        self.start = np.cumsum(self.count) - self.count

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if len(self.known) > KEEP:
            self.clear()
        units, size = [], []
        for t in texts:
            if not t:
                own = []
            elif "  " in t or MARK in t or t[0] == " " or t[-1] == " " or "\n " in t or " \n" in t:
                own = [(u,) for u in SAFE.split(MARK + t.replace(" ", MARK))]
            else:
                own = t.replace("\n", " \n").split(" ")
                if own[0] == "" and t[0] == "\n":
                    own[0] = (MARK,)  # the mark before the text stands alone before a line feed
            units += own
            size.append(len(own))
        which = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        self._learn()
        count = self.count[which]
        edge = np.append(0, np.cumsum(count))
        last = np.cumsum(np.array(size, np.int64)) if size else np.zeros(0, np.int64)
        total = np.diff(edge[np.append(0, last)])
        return self.flat[ranges(self.start[which], count)], total


def _encode_batches(path, text_at, round_trip):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(path)
        encoder = Encoder(words)
        for part in parts:
            done = 0
            for texts in batches((t.as_py() for t in part.column(text_at)), STEP):
                ids, count = encoder.encode(texts)
                own = part.slice(done, len(texts))
                done += len(texts)
                edge = np.append(0, np.cumsum(count))
                columns = [*own.columns, pa.array(count, pa.int64()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))]
                if round_trip:
                    same = []
                    for t, a, b in zip(texts, edge, edge[1:]):
                        same.append(words.decode(ids[a:b].tolist()) == (t or "").replace(MARK, " ").encode("utf-8", "surrogatepass"))
                    columns.append(pa.array(same, pa.bool_()))
                names = [*own.schema.names, "n_tokens", "ids", *["round_trip"] * round_trip]
                yield pa.RecordBatch.from_arrays(columns, names)
            give_back()
        del words, encoder
        give_back()

    return run


def encoded(docs: DataFrame, text_col: str = "text", model: str | None = None, round_trip: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids and (whether decoding gives the text back) round_trip."""
    new = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())} | ({"round_trip": T.BooleanType()} if round_trip else {})
    kept = docs.select(*[c for c in docs.columns if c not in new])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(k, v) for k, v in new.items()]])
    return kept.mapInArrow(_encode_batches(model or model_path(), kept.columns.index(text_col), round_trip), schema)


def decoded(tokens: DataFrame, ids_col: str = "ids", out: str = "text", model: str | None = None) -> DataFrame:
    """``tokens`` with the text of its ids; null ids give null."""
    path = model or model_path()

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Vocabulary(path)
        for ids in parts:
            yield ids.map(lambda x: None if x is None else words.decode(x.tolist()).decode("utf-8", "replace"))

    return tokens.withColumn(out, decode(ids_col))
