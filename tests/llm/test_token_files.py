import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import awkward_docs, rows, sentence, shared_docs
from lumatable.llm import token_files
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_files.tokenizer_path())


def plain(df, library):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    out, start = [], 0
    for d, t in docs:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def check(df, library, **options):
    folder = tempfile.mkdtemp(prefix="spark-")
    assert rows(token_files.encoded(df, folder, **options)) == plain(df, library)


def test_documents(spark, library):
    check(shared_docs(spark).repartition(5), library)


def test_awkward(spark, library):
    odd = ["a<|endoftext|> b", "it's we'll\n\n  x", "x  y", "a\u0085b c", "\x1c x", "a  b   c\n\n\nd ", "don't can't\nI'm", "#", "\n", " ", " a\nb", "a \nb"]
    df = awkward_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    df = df.filter("doc_id IS NULL OR doc_id NOT IN (9)")
    check(df.selectExpr("*", "1 AS start", "2 AS shard", "3 AS n_tokens"), library)
    for length, batch in ((1, 1), (7, 3), (64, 2)):
        check(df, library, length=length, batch=batch)


def test_repeated_ids_and_empty_table(spark, library):
    df = awkward_docs(spark).filter("doc_id = 9")
    check(df, library)
    folder = tempfile.mkdtemp(prefix="spark-")
    assert token_files.encoded(df.limit(0), folder).count() == 0


def test_files_hold_equal_sequences_without_copies(spark, library):
    df = spark.createDataFrame([(i, sentence(i, 50)) for i in range(40)], "doc_id long, text string")
    folder = tempfile.mkdtemp(prefix="spark-")
    shards = token_files.write_token_files(df, folder, length=64, batch=4)
    stream = []
    for shard, _, n in shards:
        source = pa.memory_map(f"{folder}/tokens-{shard:06d}.arrow")
        before = pa.total_allocated_bytes()
        file = pa.ipc.open_file(source)
        batches = [file.get_batch(k) for k in range(file.num_record_batches)]
        assert pa.total_allocated_bytes() - before < 1000  # the map itself is read
        assert all(b.num_rows == 4 for b in batches[:-1]) and batches[0].schema.field("ids").type == pa.list_(pa.uint16(), 64)
        ids, real, ends = (np.concatenate([b.column(k).flatten().to_numpy(zero_copy_only=False) for b in batches]) for k in range(3))
        assert real.sum() == n and real[:n].all() and (ids[:n][ends[:n]] == 2).all() and not ends[n:].any()
        assert batches[0].column("ids").flatten().to_numpy(zero_copy_only=True)[:5].tolist() == ids[:5].tolist()
        stream += ids[:n].tolist()
    assert stream == [x for i in range(40) for x in [*library.encode(sentence(i, 50)).ids, 2]]


def test_forgetting_pieces_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(token_files, "KEEP", 5)
    encoder = token_files.Encoder(token_files.tokenizer_path())
    for k in range(3):
        texts = [sentence(k * 10 + i, 30) for i in range(5)] + [None, ""]
        ids, count = encoder.encode(texts)
        assert ids.tolist() == [x for t in texts for x in library.encode(t or "").ids] and len(count) == 7
