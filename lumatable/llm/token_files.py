"""Token ids as Arrow files of equal-length sequences, and their way back.

Documents are encoded in ascending order of id, each followed by an end id, and the stream of ids is
cut into sequences of ``LENGTH``. A file is the Arrow stream format with its footer; every record
batch but the last holds ``BATCH`` sequences in fixed-size-list columns:

    ids   fixed_size_list<uint16 or uint32>   the ids, the smallest type that holds the vocabulary
    real  fixed_size_list<bool>               False only for the padding of a shard's last sequence
    ends  fixed_size_list<bool>               True at the last id of each document

Sequence ``i`` is row ``i % BATCH`` of batch ``i // BATCH`` of its shard: a memory-mapped file gives
it, and its masks, without copying. ``docs-*.arrow`` beside it holds the shard's document ids.

Shards are ranges of ids, so no task orders more than its range; texts are encoded as they stream
through. A file gets its name when it is complete, and a repeated task writes the same again. Only
one row per shard (its counts) passes the driver.

Texts are encoded by the tokenizers library. Byte-level tokenizers split before a space between two
visible characters and around a line feed between two visible characters anyway, so texts are cut
there and each different piece is encoded once per Python worker (as long as it is among the ``KEEP``
pieces remembered), new ones many at once; texts with other white space are cut at those spaces only.
Texts for other tokenizers are encoded as they are.

Defined results: null text is the empty text and gives the end id alone; null ids come first; rows
with equal ids are ordered by text; an empty table gives no file and an empty result; other columns
are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ranges
from .quality import batches

LENGTH = 2048
BATCH = 256
END_ID = 2
KEEP = 400_000
WHITE = re.compile(r"\s")
#: New pieces that are encoded as one text.
TOGETHER = 20_000
SAFE = re.compile(r"(?<=\S)(?= \S)")
STEP = 4_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Numbers(dict):
    """Numbers of pieces, in the order in which they are first looked up."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list = []

    def __missing__(self, piece):
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Ids of texts; pieces between safe cuts are encoded once.

    New pieces go to the library in one text per ``TOGETHER`` of them, since it splits between them
    anyway; the bytes that each id stands for tell where a piece's ids end.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        steps = json.loads(self.tok.to_str())
        kind = steps["pre_tokenizer"] or {}
        self.byte_level = (
            steps["normalizer"] is None and kind.get("type") == "ByteLevel"
            and not kind["add_prefix_space"] and kind.get("use_regex", True)
        )
        vocabulary = self.tok.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():  # a character a byte
            self.width[i] = len(token)
        for added in steps["added_tokens"]:
            self.width[added["id"]] = len(added["content"].encode())
        self.clear()

    def clear(self):
        self.known = _Numbers()
        self.flat = np.zeros(0, np.int32)
        self.start, self.count, self.hits = (np.zeros(0, np.int64) for _ in range(3))

    def forget(self):
        """Keep the pieces met more than once since the last time, at most half of ``KEEP``."""
        units = list(self.known)  # in the order of their numbers
        best = np.argsort(-self.hits, kind="stable")[: KEEP // 2]
        at = best[(self.hits[best] > 1) & (self.count[best] >= 0)]
        self.known = _Numbers(zip(map(units.__getitem__, at.tolist()), range(len(at))))
        self.flat, self.count = self.flat[ranges(self.start[at], self.count[at])], self.count[at]
        self.start = np.cumsum(self.count) - self.count
        self.hits = np.zeros(len(at), np.int64)

    def _one_by_one(self, texts):
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(count.sum())), count

    def _together(self, texts):
        """Ids and counts of pieces that begin with their only white space."""
        joined = "".join(texts)
        ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        size = map(len, texts) if joined.isascii() else (len(t.encode()) for t in texts)
        edge = np.cumsum(np.fromiter(size, np.int64, len(texts)))
        reached = np.cumsum(self.width[ids])
        last = np.searchsorted(reached, edge)
        if not len(ids) or reached[-1] != edge[-1] or (reached[last] != edge).any():
            return self._one_by_one(texts)
        return ids, np.diff(last, prepend=-1)

    def _words(self, units):
        """Ids and counts of units without a space; the count is -1 for those with other white space."""
        words = [u[1:] if u[:1] == "\n" else u for u in units]
        texts = [u if u[:1] == "\n" else " " + u for u in units]
        if "".join(texts).split() == words:
            return self._together(texts)
        plain = np.array([bool(w) and not WHITE.search(w) for w in words])
        count = np.full(len(units), -1, np.int64)
        ids = np.zeros(0, np.int32)
        if plain.any():
            ids, count[plain] = self._together([texts[k] for k in np.flatnonzero(plain).tolist()])
        return ids, count

    def _learn(self, whole):
        new, self.known.new = self.known.new, []
        flat, counts = [self.flat], [self.count]
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            ids, count = self._one_by_one([u for u, in some]) if whole else self._words(some)
            flat.append(ids)
            counts.append(count)
        self.flat, self.count = np.concatenate(flat), np.concatenate(counts)
        held = np.maximum(self.count, 0)
        self.start = np.cumsum(held) - held
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])

    def _look_up(self, own, whole=False):
        units = [u for us in own for u in us]
        which = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        if self.known.new:
            self._learn(whole)
        return which

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if not self.byte_level:
            return self._one_by_one([t or "" for t in texts])
        if len(self.known) > KEEP:
            self.forget()
        # the first piece is looked up as the start of a line; the line feed's id is dropped below
        own = [("\n" + t.replace("\n", " \n")).split(" ") if t else ["\n"] for t in texts]
        skip = np.ones(len(texts), np.int64)
        which = self._look_up(own)
        size = np.fromiter(map(len, own), np.int64, len(own))
        odd = np.unique(np.repeat(np.arange(len(own)), size)[self.count[which] < 0])
        if len(odd):
            for i in odd.tolist():
                own[i] = [(u,) for u in SAFE.split(texts[i] or "")]
            skip[odd] = 0
            # all other pieces have their numbers by now, so that only whole ones are new
            which = self._look_up(own, whole=True)
            size = np.fromiter(map(len, own), np.int64, len(own))
        first = np.cumsum(size) - size
        self.hits += np.bincount(which, minlength=len(self.hits))
        start, count = self.start[which], self.count[which]
        start[first] += skip
        count[first] -= skip
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        return self.flat[ranges(start, count)], total


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The encoder of this Python worker, with what it learned in earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def open_folder(uri: str):
    """The file system and path of a folder named as Spark names it."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _schema(kind, length):
    fixed = lambda t: pa.list_(t, length)
    return pa.schema([("ids", fixed(kind)), ("real", fixed(pa.bool_())), ("ends", fixed(pa.bool_()))])


class SequenceWriter:
    """Collects ids and writes full batches of sequences."""

    def __init__(self, sink, kind, length, batch):
        self.length, self.room, self.kind = length, length * batch, kind
        self.schema = _schema(kind, length)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.ids, self.ends, self.held, self.total = [], [], 0, 0

    def add(self, ids: np.ndarray, ends: np.ndarray):
        self.ids.append(ids.astype(self.kind.to_pandas_dtype()))
        self.ends.append(ends)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.room:
            ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
            whole = len(ids) // self.room * self.room
            for at in range(0, whole, self.room):
                self._write(ids[at : at + self.room], ends[at : at + self.room])
            self.ids, self.ends, self.held = [ids[whole:].copy()], [ends[whole:].copy()], len(ids) - whole

    def _write(self, ids, ends):
        pad = -len(ids) % self.length
        real = np.ones(len(ids) + pad, bool)
        real[len(ids) :] = False
        columns = [np.pad(ids, (0, pad)), real, np.pad(ends, (0, pad))]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in columns]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self):
        if self.held:
            self._write(np.concatenate(self.ids), np.concatenate(self.ends))
        self.out.close()


def _write_shards(folder, tokenizer, end_id, length, batch):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, trial = task.partitionId(), task.taskAttemptId()
        fs, path = open_folder(folder)
        names = [f"{path}/{kind}-{shard:06d}.arrow" for kind in ("tokens", "docs")]
        encoder, writer, n_docs = None, None, 0
        for part in parts:
            if not part.num_rows:
                continue
            if writer is None:
                encoder = encoder_for(tokenizer)
                kind = pa.uint16() if max(encoder.size, end_id + 1) <= 1 << 16 else pa.uint32()
                sinks = [fs.open_output_stream(f"{n}.{trial}") for n in names]
                writer = SequenceWriter(sinks[0], kind, length, batch)
                index = pa.ipc.new_file(sinks[1], pa.schema([part.schema.field("doc_id")]))
            index.write_batch(part.select(["doc_id"]))
            n_docs += part.num_rows
            for texts in batches(part.column("text").to_pylist(), STEP):
                ids, count = encoder.encode(texts)
                last = np.cumsum(count + 1) - 1
                ids = np.insert(ids, np.cumsum(count), end_id)
                ends = np.zeros(len(ids), bool)
                ends[last] = True
                writer.add(ids, ends)
        if writer is not None:
            writer.close()
            index.close()
            for sink, name in zip(sinks, names):
                sink.close()
                fs.move(f"{name}.{trial}", name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_tokens": [writer.total]})

    return run


def write_token_files(
    docs: DataFrame, folder: str, id_col="doc_id", text_col="text", tokenizer: str | None = None,
    end_id: int = END_ID, length: int = LENGTH, batch: int = BATCH,
) -> list[tuple[int, int, int]]:
    """Write ``docs`` below ``folder`` (shared); returns (shard, documents, ids) in order of id."""
    fs, path = open_folder(folder)
    fs.create_dir(path)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    run = _write_shards(folder, tokenizer or tokenizer_path(), end_id, length, batch)
    shards = ordered.mapInArrow(run, "shard long, n_docs long, n_tokens long").collect()
    return sorted((r["shard"], r["n_docs"], r["n_tokens"]) for r in shards)


def _open(fs, name):
    return pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)


def _read_shards(folder):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for part in parts:
            for shard, start in zip(part.column("shard").to_pylist(), part.column("first").to_pylist()):
                docs = pa.ipc.open_file(_open(fs, f"{path}/docs-{shard:06d}.arrow")).read_all().column("doc_id")
                done, crc, size = 0, 0, 0
                tokens = pa.ipc.open_file(_open(fs, f"{path}/tokens-{shard:06d}.arrow"))
                for k in range(tokens.num_record_batches):
                    batch = tokens.get_batch(k)
                    ids, real, ends = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
                    ids = ids[: int(real.sum())].astype("<u4")
                    out, at = [], 0
                    for stop in (np.flatnonzero(ends) + 1).tolist():
                        crc = zlib.crc32(ids[at:stop], crc)
                        size += stop - at
                        out.append((start, size, crc))
                        start, at, crc, size = start + size, stop, 0, 0
                    crc = zlib.crc32(ids[at:], crc)
                    size += len(ids) - at
                    columns = [pa.array([o[j] for o in out], pa.int64()) for j in range(3)]
                    own = docs.slice(done, len(out)).combine_chunks()
                    own = own if isinstance(own, pa.Array) else own.chunk(0) if own.num_chunks else pa.array([], docs.type)
                    done += len(out)
                    yield pa.RecordBatch.from_arrays([own, *columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]], id_type="bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    first, rows = 0, []
    for shard, _, n in shards:
        rows.append((shard, first))
        first += n
    jobs = spark.createDataFrame(rows, "shard long, first long").repartition(max(1, len(rows)))
    return jobs.mapInArrow(_read_shards(folder), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, folder: str, id_col="doc_id", **options) -> DataFrame:
    """Write the files and read every document back from them."""
    folder = f"{folder}/tokens-{uuid.uuid4().hex}"
    shards = write_token_files(docs, folder, id_col=id_col, **options)
    return read_token_files(docs.sparkSession, folder, shards, docs.schema[id_col].dataType.simpleString())
