"""The live view: any cut into micro-batches gives the rows of the batch form."""

import datetime as dt
import random

import pytest

from lumatable import schema as S
from lumatable.streaming import live as L

T0 = dt.datetime(2024, 3, 1, 12)
FAR = (999, 1, T0 + dt.timedelta(days=2), "undo", None, None)  # takes the watermark past all others


def edits(n, seed):
    rnd = random.Random(seed)
    out, at = [], T0
    for seq in range(n):
        at += dt.timedelta(milliseconds=rnd.choice([0, 3, 15, 31, 60, 140, 400]))
        action = rnd.choice(["commit", "drag", "reset", "undo"])
        out.append((seq % 3, seq, at, action, "exposure" if action != "undo" else None, rnd.choice([1.0, 2.0]) if action != "undo" else None))
    return out


def plain(rows, slot_ms=100, gap_ms=30):
    out = set()
    for photo in {r[0] for r in rows}:
        own = sorted({r[1]: r for r in rows if r[0] == photo}.values(), key=lambda r: (r[2], r[1]))
        us = [round((r[2] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for r in own]
        for k, r in enumerate(own):
            last = k + 1 == len(own)
            latest = last or us[k + 1] // (slot_ms * 1000) > us[k] // (slot_ms * 1000)
            settled = last or us[k + 1] - us[k] >= gap_ms * 1000
            if latest or settled:
                out.add((r[0], r[1], r[3], r[5], latest, settled))
    return out


def shown(df):
    return [(r["photo_id"], r["seq"], r["action"], r["value"], r["is_latest"], r["is_settled"]) for r in df.collect()]


@pytest.mark.parametrize("seed, files", [(1, 1), (2, 5), (3, 9)])
def test_every_cut_into_batches_gives_the_batch_rows(spark, folder, seed, files):
    rows = edits(120, seed)
    df = spark.createDataFrame(rows, S.EDIT_LOG)
    assert set(shown(L.live_view(df))) == plain(rows)
    rnd = random.Random(seed)
    cuts = sorted(rnd.sample(range(1, len(rows)), files - 1))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    # within the lateness, deliveries are out of order and repeated
    for part in parts:
        part += rnd.sample(part, len(part) // 3)
        rnd.shuffle(part)
    bad = (1, 5000, T0, "commit", "exposure", float("nan"))
    for part in ([*parts[0], bad], *parts[1:], [FAR]):
        spark.createDataFrame(part, S.EDIT_LOG).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    reader = spark.readStream.schema(S.EDIT_LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    name = f"view{seed}"
    query = (
        L.stream_live_view(reader).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = [r for r in shown(spark.table(name)) if r[0] != FAR[0]]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_empty_and_untimed_logs(spark):
    assert L.live_view(spark.createDataFrame([], S.EDIT_LOG)).count() == 0
    assert L.live_view(spark.createDataFrame([(1, 1, None, "undo", None, None)], S.EDIT_LOG)).count() == 0
