"""Edit-log queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable import schema as S
from lumatable.operators import editlog as E
from lumatable.streaming import live as L

from . import inputs as I

QUERIES, ORACLE = {}, {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


_NEUTRAL = "[" + ", ".join(f"{v}e0" for v in S.ADJUSTMENT_DEFAULTS.values()) + "]"
_IDX = "CASE key " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(S.KEYS)) + " END"
_SET = "list_concat(list_concat(cur[1:k-1], [value]), cur[k+1:20])"
_NUMBERED = f"""
, ev AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY ts, seq) AS n, {_IDX} AS k FROM edit_log)
, ev2 AS (SELECT * REPLACE (CASE WHEN action = 'reset' THEN ({_NEUTRAL})[k] ELSE value END AS value) FROM ev)"""
_FOLD = _NUMBERED + f"""
, st AS (
  SELECT DISTINCT photo_id, CAST(0 AS BIGINT) AS n, {_NEUTRAL} AS cur, CAST([] AS DOUBLE[][]) AS h, CAST([] AS DOUBLE[][]) AS f FROM edit_log
  UNION ALL
  SELECT s.photo_id, e.n,
    CASE WHEN action = 'undo' THEN CASE WHEN len(h) = 0 THEN cur ELSE h[len(h)] END
         WHEN action = 'redo' THEN CASE WHEN len(f) = 0 THEN cur ELSE f[1] END
         WHEN cur[k] = value THEN cur ELSE {_SET} END,
    CASE WHEN action = 'undo' THEN h[1:len(h)-1]
         WHEN action = 'redo' THEN CASE WHEN len(f) = 0 THEN h ELSE list_concat(h, [cur]) END
         WHEN cur[k] = value OR action = 'drag' THEN h
         ELSE list_concat(h, [cur])[-100:] END,
    CASE WHEN action = 'undo' THEN CASE WHEN len(h) = 0 THEN f ELSE list_concat([cur], f) END
         WHEN action = 'redo' THEN f[2:]
         WHEN cur[k] = value THEN f ELSE CAST([] AS DOUBLE[][]) END
  FROM st s JOIN ev2 e ON s.photo_id = e.photo_id AND e.n = s.n + 1)
, last AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY n DESC) = 1)"""
# every value of a stack, weighted by its place
_STACK = "coalesce(list_sum(list_transform({0}, lambda a, i: i * list_sum(list_transform(a, lambda v, j: j * v)))), 0e0)"


def _stack(name):
    inner = "aggregate(transform(a, (v, j) -> (j + 1) * v), 0D, (s, x) -> s + x)"
    return F.expr(f"aggregate(transform({name}, (a, i) -> (i + 1) * {inner}), 0D, (s, x) -> s + x)")


@register("fold_edit_log", I.with_ctes(
    ["edit_log"],
    _FOLD + " SELECT photo_id, "
    + ", ".join(f"cur[{i + 1}] AS {k}" for i, k in enumerate(S.KEYS))
    + ", CAST(len(h) AS INT) AS n_history, CAST(len(f) AS INT) AS n_future, "
    + f"{_STACK.format('h')} AS history_sum, {_STACK.format('f')} AS future_sum FROM last",
    recursive=True,
))
def fold_edit_log(spark, sf):
    state = E.fold_edit_log(I.edit_log(spark, sf))
    return E.explode_adjustments(
        state.select(
            "photo_id", "current",
            F.size("history").alias("n_history"), F.size("future").alias("n_future"),
            _stack("history").alias("history_sum"), _stack("future").alias("future_sum"),
        )
    ).select("photo_id", *S.KEYS, "n_history", "n_future", "history_sum", "future_sum")


@register("edit_status", I.with_ctes(
    ["edit_log"],
    _FOLD + f" SELECT photo_id, len(h) > 0 AS can_undo, len(f) > 0 AS can_redo, "
    f"CAST(len(list_filter(list_zip(cur, {_NEUTRAL}), lambda p: p[1] <> p[2])) AS INT) AS n_edits FROM last",
    recursive=True,
))
def edit_status(spark, sf):
    return E.edit_status(E.fold_edit_log(I.edit_log(spark, sf)))


# a log over whole snapshots, from the same events
_APP = [
    "photo_id", "seq", "ts",
    "CASE seq % 9 WHEN 0 THEN 'begin' WHEN 1 THEN 'curve' WHEN 2 THEN 'mask' WHEN 3 THEN 'undo' WHEN 4 THEN 'redo' "
    "WHEN 5 THEN CASE WHEN seq % 4 = 0 THEN 'reset_all' ELSE 'rate' END ELSE CASE WHEN action = 'reset' THEN 'reset' ELSE 'adjust' END END AS action",
    "key", "value",
]
_MOVED = [
    f"named_struct('id','{i}','x',{x}D,'y',{'value / 100D' if i == 'midtone' else str(y) + 'D'})"
    for i, x, y in S.CURVE_DEFAULT
]


def app_log(spark, sf):
    return I.edit_log(spark, sf).selectExpr(
        *_APP,
        f"array({', '.join(_MOVED)}) AS curve",
        "named_struct('x', value / 100D, 'y', 0.5D, 'width', 0.42D, 'height', 0.42D, 'rotation', 0D) AS mask",
    )


# in SQL a snapshot is a list: 20 adjustments, then the midtone y, then the mask x
_SNAP0 = _NEUTRAL[:-1] + ", 0.5e0, 0.5e0]"
_APP_FOLD = f"""
, al AS (SELECT {', '.join(_APP)} FROM edit_log)
, ev AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY ts, seq) AS n,
    CASE action WHEN 'curve' THEN 21 WHEN 'mask' THEN 22 ELSE {_IDX} END AS k FROM al)
, ev2 AS (SELECT * REPLACE (CASE action WHEN 'reset' THEN ({_NEUTRAL})[k] WHEN 'curve' THEN value/100e0 WHEN 'mask' THEN value/100e0 ELSE value END AS value) FROM ev)
, st AS (
  SELECT DISTINCT photo_id, CAST(0 AS BIGINT) AS n, {_SNAP0} AS cur, 0 AS rating, CAST([] AS DOUBLE[][]) AS h, CAST([] AS DOUBLE[][]) AS f FROM edit_log
  UNION ALL
  SELECT s.photo_id, e.n,
    CASE WHEN action = 'undo' THEN CASE WHEN len(h) = 0 THEN cur ELSE h[len(h)] END
         WHEN action = 'redo' THEN CASE WHEN len(f) = 0 THEN cur ELSE f[1] END
         WHEN action IN ('begin', 'rate') THEN cur
         WHEN action = 'reset_all' THEN {_SNAP0}
         ELSE list_concat(list_concat(cur[1:k-1], [value]), cur[k+1:22]) END,
    CASE WHEN action = 'rate' THEN CASE WHEN rating = 5 THEN 0 ELSE 5 END ELSE rating END,
    CASE WHEN action = 'undo' THEN h[1:len(h)-1]
         WHEN action = 'redo' THEN CASE WHEN len(f) = 0 THEN h ELSE list_concat(h, [cur]) END
         WHEN action = 'begin' THEN list_concat(h, [cur])[-100:]
         WHEN action IN ('curve', 'mask', 'rate') THEN h
         WHEN action = 'reset_all' THEN CASE WHEN cur[1:20] = {_NEUTRAL} AND abs(cur[21]-0.5e0) <= 1e-4 AND abs(cur[22]-0.5e0) <= 1e-4 THEN h ELSE list_concat(h, [cur]) END
         WHEN cur[k] = value THEN h ELSE list_concat(h, [cur])[-100:] END,
    CASE WHEN action = 'undo' THEN CASE WHEN len(h) = 0 THEN f ELSE list_concat([cur], f) END
         WHEN action = 'redo' THEN f[2:]
         WHEN action = 'rate' THEN f
         WHEN action = 'reset_all' AND cur[1:20] = {_NEUTRAL} AND abs(cur[21]-0.5e0) <= 1e-4 AND abs(cur[22]-0.5e0) <= 1e-4 THEN f
         WHEN action IN ('adjust', 'reset') AND cur[k] = value THEN f
         ELSE CAST([] AS DOUBLE[][]) END
  FROM st s JOIN ev2 e ON s.photo_id = e.photo_id AND e.n = s.n + 1)
, last AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY n DESC) = 1)
SELECT photo_id, cur[1] AS exposure, cur[2] AS contrast, cur[21] AS midtone, cur[22] AS mask_x, CAST(rating AS INT) AS rating,
  CAST(len(h) AS INT) AS n_history, CAST(len(f) AS INT) AS n_future,
  round({_STACK.format('h')}, 3) AS history_sum, round({_STACK.format('f')}, 3) AS future_sum FROM last"""


@register("fold_app_log", I.with_ctes(["edit_log"], _APP_FOLD, recursive=True))
def fold_app_log(spark, sf):
    s = E.fold_app_log(app_log(spark, sf))
    flat = "transform({0}, p -> concat(p.adjustments, array(p.curve[2].y, p.mask.x)))"
    s = s.withColumns({f"flat_{c}": F.expr(flat.format(c)) for c in ("history", "future")})
    return s.select(
        "photo_id",
        F.col("current.adjustments")[0].alias("exposure"),
        F.col("current.adjustments")[1].alias("contrast"),
        F.col("current.curve")[2]["y"].alias("midtone"),
        F.col("current.mask.x").alias("mask_x"),
        "rating",
        F.size("history").alias("n_history"),
        F.size("future").alias("n_future"),
        F.round(_stack("flat_history"), 3).alias("history_sum"),
        F.round(_stack("flat_future"), 3).alias("future_sum"),
    )


_ADJUSTS = f""", adj AS (SELECT * REPLACE (CASE WHEN action = 'reset' THEN ({_NEUTRAL})[{_IDX}] ELSE value END AS value)
  FROM edit_log WHERE action IN ('commit', 'drag', 'reset'))
, seen AS (SELECT *, lag(value, 1, ({_NEUTRAL})[{_IDX}]) OVER (PARTITION BY photo_id, key ORDER BY ts, seq) AS before FROM adj)"""


@register("suppress_noop", I.with_ctes(
    ["edit_log"], _ADJUSTS + " SELECT photo_id, seq, action, key, value FROM seen WHERE value IS DISTINCT FROM before"
))
def suppress_noop(spark, sf):
    return E.suppress_noop(I.edit_log(spark, sf)).select("photo_id", "seq", "action", "key", "value")


@register("param_history", I.with_ctes(
    ["edit_log"],
    _ADJUSTS + " SELECT photo_id, seq, key, before AS old_value, value AS new_value FROM seen WHERE value IS DISTINCT FROM before",
))
def param_history(spark, sf):
    return E.param_history(I.edit_log(spark, sf))


_GAP = 30 * 60 * 1000


@register("settled_edits", I.with_ctes(
    ["edit_log"],
    f""", n AS (SELECT *, lead(ts) OVER (PARTITION BY photo_id ORDER BY ts, seq) AS nxt FROM edit_log)
    SELECT photo_id, seq, action, key, value FROM n WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= {_GAP * 1000}""",
))
def settled_edits(spark, sf):
    return E.settled_edits(I.edit_log(spark, sf), _GAP).select("photo_id", "seq", "action", "key", "value")


@register("throttle_latest", I.with_ctes(
    ["edit_log"],
    " SELECT DISTINCT ON (photo_id, epoch_us(ts) // 7200000000) photo_id, seq, value FROM edit_log "
    "ORDER BY photo_id, epoch_us(ts) // 7200000000, ts DESC, seq DESC",
))
def throttle_latest(spark, sf):
    return E.throttle_latest(I.edit_log(spark, sf), "2 hours").select("photo_id", "seq", "value")


@register("bounded_history", I.with_ctes(
    ["edit_log"],
    " SELECT photo_id, seq, CAST(row_number() OVER (PARTITION BY photo_id ORDER BY seq DESC) AS INT) AS rank FROM edit_log "
    "WHERE action = 'commit' QUALIFY rank <= 5",
))
def bounded_history(spark, sf):
    return E.bounded_history(I.edit_log(spark, sf), 5).select("photo_id", "seq", "rank")


@register("live_view", I.with_ctes(
    ["edit_log"],
    """, ev AS (SELECT * FROM edit_log WHERE photo_id IS NOT NULL AND ts IS NOT NULL AND (action IN ('undo', 'redo', 'reset') OR value IS NOT NULL))
    , seen AS (SELECT *, lead(ts) OVER (PARTITION BY photo_id ORDER BY ts, seq) AS later,
        row_number() OVER (PARTITION BY photo_id, epoch_us(ts) // 21600000000 ORDER BY ts DESC, seq DESC) AS back FROM ev)
    , marked AS (SELECT *, back = 1 AS is_latest, later IS NULL OR epoch_us(later) - epoch_us(ts) >= 3600000000 AS is_settled FROM seen)
    SELECT photo_id, seq, action, key, value, is_latest, is_settled FROM marked WHERE is_latest OR is_settled""",
))
def live_view(spark, sf):
    """The last edit of every six hours, and every edit followed by an hour of silence."""
    return L.live_view(I.edit_log(spark, sf), slot_ms=6 * 3_600_000, gap_ms=3_600_000).drop("ts")
