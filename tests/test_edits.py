import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumatable import schema as S
from lumatable.operators import editlog as E
from lumatable.plans.ordered import with_next, with_previous
from lumatable.streaming import edits as stream, state

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    """rows: (photo, action, key, value), numbered in order."""
    return spark.createDataFrame(
        [(p, i * 3, T0 + dt.timedelta(seconds=i), a, k, v) for i, (p, a, k, v) in enumerate(rows)], S.EDIT_LOG
    )


def witness(rows):
    out = {}
    for p, a, k, v in rows:
        cur, h, f = out.get(p, (list(S.ADJUSTMENT_DEFAULTS.values()), [], []))
        out[p] = state.apply_edit(cur, h, f, a, k, v)
    return out


def mixed(n, photos=3):
    actions = ["commit", "drag", "commit", "undo", "commit", "reset", "redo", "commit", "undo", "undo", "redo"]
    keys = ["exposure", "contrast", "temperature"]
    return [
        (1 if i % 3 == 0 else i % photos, actions[(i * 7 + i // 5) % len(actions)], keys[i % 3], float(i % 6))
        for i in range(n)
    ]


def folded(df):
    return {
        r["photo_id"]: (list(r["current"]), [list(h) for h in r["history"]], [list(f) for f in r["future"]])
        for r in df.collect()
    }


def test_commit_undo_and_reset(spark):
    s = folded(E.fold_edit_log(log(spark, [
        (1, "commit", "exposure", 1.25), (1, "undo", None, None),
        (2, "drag", "contrast", 30.0), (2, "reset", "contrast", None),
    ])))
    assert s[1][0][0] == 0.0 and s[1][1] == [] and len(s[1][2]) == 1
    assert s[2][0][1] == 0.0 and len(s[2][1]) == 1


def test_history_limit(spark):
    rows = [(1, "commit", "exposure", float(i + 1)) for i in range(250)]
    rows += [(1, "undo", None, None)] * 120 + [(1, "redo", None, None)] * 120
    s = folded(E.fold_edit_log(log(spark, rows)))[1]
    assert s == witness(rows)[1]
    assert s[0][0] == 250.0 and len(s[1]) == 100 and s[2] == []


def test_chunks_give_the_same_state(spark):
    rows = mixed(240) + [(9, "commit", "exposure", 2.0), (9, "undo", None, None)]
    df = log(spark, rows)
    assert folded(E.fold_edit_log(df, chunk=20)) == witness(rows)
    sizes = E.with_chunks(df, 20).groupBy("photo_id", "chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 20
    assert sizes.agg(F.max("chunk")).first()[0] >= 3


def test_sparse_numbers_repeats_and_broken_events(spark):
    """Snowflake-like numbers, redelivered events, clocks against numbers, unknown keys and actions."""
    rows = mixed(150)
    big = log(spark, rows).withColumn("seq", F.col("seq") * 4_000_000_007 % 1_000_000_000_039)
    order = {r["seq"]: i for i, r in enumerate(big.orderBy("ts", "seq").collect())}
    assert len(order) == len(rows)
    again = big.filter("action = 'undo'")
    broken = big.limit(4).withColumn("seq", -F.col("seq") - 1)
    bad = broken.withColumn("key", F.lit("texture")).unionByName(broken.withColumn("action", F.lit("zap")))
    bad = bad.filter("action NOT IN ('undo', 'redo')").unionByName(
        broken.filter("action = 'commit'").withColumn("value", F.expr("double('NaN')"))
    )
    df = big.unionByName(again).unionByName(bad).repartition(5)
    assert folded(E.fold_edit_log(df)) == witness(rows)
    assert folded(E.fold_edit_log(df, chunk=20)) == witness(rows)
    assert E.quarantined_events(df).count() == bad.count()
    assert {r["reason"] for r in E.quarantined_events(df).collect()} == {"unknown action", "unknown key", "no usable value"}


def test_status_of_both_folds(spark):
    rows = [(1, "adjust", "exposure", 1.0), (1, "begin", None, None), (1, "curve", None, None), (1, "undo", None, None), (1, "redo", None, None)]
    df = log(spark, rows).withColumns({
        "curve": F.expr(f"cast(array(named_struct('id','a','x',0D,'y',0.5D)) as {E.POINTS})"),
        "mask": F.expr(f"cast(null as {E.MASK})"),
    })
    r = E.edit_status(E.fold_app_log(df)).first()
    assert (r["can_undo"], r["can_redo"], r["n_edits"]) == (True, False, 2)


def test_reset_all_is_not_capped(spark):
    rows = [(1, "begin", None, None)] * 101 + [(1, "adjust", "exposure", 1.0), (1, "reset_all", None, None)]
    df = log(spark, rows).withColumns(
        {"curve": F.expr(f"cast(null as {E.POINTS})"), "mask": F.expr(f"cast(null as {E.MASK})")}
    )
    r = E.fold_app_log(df).first()
    assert len(r["history"]) == 101 and r["current"]["adjustments"][0] == 0.0


def test_neighbours_across_ranges(spark):
    rows = [(1, i * i) for i in range(40)] + [(2, 5), (2, 90)]
    df = spark.createDataFrame(rows, "k int, n long").withColumn("v", F.when(F.col("n") % 3 != 0, F.col("n")))
    got = {(r["k"], r["n"]): r for r in with_next(with_previous(df, ["k"], "n", ["v"]), ["k"], "n", ["v"]).collect()}
    shown = lambda n: n if n % 3 else None
    for i in range(40):
        r = got[(1, i * i)]
        assert r["prev_exists"] == (i > 0) and r["next_exists"] == (i < 39)
        assert r["prev_v"] == (shown((i - 1) ** 2) if i else None)
        assert r["next_v"] == (shown((i + 1) ** 2) if i < 39 else None)
    assert got[(2, 90)]["prev_v"] == 5


def replay(spark, folder, df, parts):
    src = f"{folder}/in"
    ordered = df.orderBy("seq").collect()
    step = -(-len(ordered) // parts)
    for i in range(parts):
        spark.createDataFrame(ordered[i * step : (i + 1) * step], S.EDIT_LOG).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(S.EDIT_LOG).option("maxFilesPerTrigger", 1).parquet(src)


def run(df, folder, spark, name, mode):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.table(name)


def test_stream_equals_batch(spark, folder):
    rows = mixed(120)
    live = run(state.stream_edit_state(replay(spark, folder, log(spark, rows), 3)), folder, spark, "live", "update")
    live = live.filter("status = 'state'")
    last = live.groupBy("photo_id").agg(F.max_by(F.struct("current", "n_history", "n_future"), "seq").alias("s"))
    want = witness(rows)
    got = {r["photo_id"]: (list(r["s"][0]), r["s"][1], r["s"][2]) for r in last.collect()}
    assert got == {p: (c, len(h), len(f)) for p, (c, h, f) in want.items()}


def test_stream_reports_late_and_invalid_events(spark, folder):
    """Events out of order within the lateness are put in place, older ones come out as rows."""
    rows = mixed(60, photos=2)
    df = log(spark, rows)
    src = f"{folder}/in"
    early = df.filter("seq % 9 = 3")  # arrive in the second batch, at most a minute behind
    extra = spark.createDataFrame([(1, 10_000, T0 + dt.timedelta(seconds=90), "commit", "texture", 1.0)], S.EDIT_LOG)
    tail = spark.createDataFrame([(1, 10_001, T0 - dt.timedelta(hours=1), "commit", "exposure", 9.0)], S.EDIT_LOG)
    far = spark.createDataFrame([(p, 9_000 + p, T0 + dt.timedelta(minutes=20), "undo", None, None) for p in (0, 1)], S.EDIT_LOG)
    for part in (df.filter("seq % 9 <> 3"), early.unionByName(early), far.unionByName(extra), tail):
        part.coalesce(1).write.mode("append").parquet(src)
    reader = spark.readStream.schema(S.EDIT_LOG).option("maxFilesPerTrigger", 1).parquet(src)
    live = run(state.stream_edit_state(reader), folder, spark, "outoforder", "update")
    odd = {(r["status"], r["seq"]) for r in live.filter("status <> 'state'").collect()}
    assert odd == {("invalid", 10_000), ("late", 10_001)}
    last = live.filter("status = 'state'").groupBy("photo_id").agg(F.max_by("current", "ts").alias("c"))
    want = witness(rows + [(0, "undo", None, None), (1, "undo", None, None)])
    assert {r["photo_id"]: list(r["c"]) for r in last.collect()} == {p: want[p][0] for p in (0, 1)}


def test_stream_throttled_counts_redelivery_once(spark, folder):
    rows = [(1, "commit", "exposure", float(i)) for i in range(20)]
    df = log(spark, rows)
    out = run(stream.stream_throttled(replay(spark, folder, df.unionByName(df), 2), "5 seconds", "1 second"), folder, spark, "slots", "append")
    batch = {r["seq"] for r in E.throttle_latest(df, "5 seconds").collect()}
    got = {r["seq"] for r in out.collect()}
    assert got and got <= batch


def test_stream_settled(spark, folder):
    rows = [(p, "commit", "exposure", float(i)) for i in range(30) for p in (1, 2)]
    df = log(spark, rows).withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(seq / 30 as int) * 10)"))
    batch = E.settled_edits(df, 5 * 60 * 1000)
    gap = stream.stream_settled_edits(replay(spark, folder, df, 3), "5 minutes", "1 second")
    got = {(r["photo_id"], r["seq"]) for r in run(gap, folder, spark, "settled", "append").collect()}
    want = {(r["photo_id"], r["seq"]) for r in batch.collect()}
    last = {(p, max(s for q, s in want if q == p)) for p in (1, 2)}
    assert want - last <= got <= want  # the newest burst stays open until the watermark passes it
