"""Folding edit logs with undo and redo into the current state of each photo.

The log is a table ``photo_id, seq, action, key, value`` and optionally ``ts``; ``seq`` is an integer
that is distinct per photo, and gives the order after ``ts`` where there is one. A redelivered event
(same photo and ``seq``) counts once, and events with an unknown action or key, or without a value they
need, are left out; ``quarantined_events`` returns them. Folding is order dependent, so a photo's
events must meet; but the state between events is small. A photo whose log is long is therefore
folded in bounded chunks: each round folds one chunk of every photo and hands the state on. No task
ever holds more than one chunk of one photo, and ordinary logs finish in a single round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from .. import schema as S
from ..functions.numeric import is_finite
from ..functions.recipe import has_curve_edits, has_mask_edits
from ..plans.ordered import with_next, with_previous
from ..plans.session import checkpoint_dir, cut_lineage

CHUNK = 50_000

ADJ = "array<double>"
POINTS = "array<struct<id:string,x:double,y:double>>"
MASK = "struct<x:double,y:double,width:double,height:double,rotation:double>"
SNAPSHOT = f"struct<adjustments:{ADJ},curve:{POINTS},mask:{MASK}>"

_NEUTRAL = "array(" + ", ".join(f"{v}D" for v in S.ADJUSTMENT_DEFAULTS.values()) + ")"
_KEY_INDEX = (
    "map(" + ", ".join(f"'{k}', {i}" for i, k in enumerate(S.KEYS)) + ")"
)


EDIT_ACTIONS = ("commit", "drag", "reset", "undo", "redo")
APP_ACTIONS = ("adjust", "reset", "curve", "mask", "begin", "reset_all", "undo", "redo", "rate")


def _sound(actions, columns) -> "F.Column":
    """Is an event complete: known action, known key and a value where the action needs them."""
    keyed, valued = [a for a in actions if a in ("commit", "drag", "adjust", "reset")], [a for a in actions if a in ("commit", "drag", "adjust")]
    ok = F.col("photo_id").isNotNull() & F.col("seq").isNotNull() & F.col("action").isin(*actions)
    ok &= ~F.col("action").isin(*keyed) | F.col("key").isin(*S.KEYS)
    ok &= ~F.col("action").isin(*valued) | is_finite(F.col("value"))
    for extra in ("curve", "mask"):
        if extra in actions and extra in columns:
            ok &= (F.col("action") != extra) | F.col(extra).isNotNull()
    return F.coalesce(ok, F.lit(False))


def sound_events(log: DataFrame, actions=EDIT_ACTIONS) -> DataFrame:
    """Complete events, repeated deliveries included; works on streams too."""
    return log.filter(_sound(actions, log.columns))


def valid_events(log: DataFrame, actions=EDIT_ACTIONS) -> DataFrame:
    """Complete events, each (photo, seq) once: the earliest delivery by ``ts`` and content."""
    once = sound_events(log, actions)
    rest = [c for c in log.columns if c not in ("photo_id", "seq")]
    order = F.struct(*[F.col(c) for c in ("ts", *[c for c in rest if c != "ts"]) if c in rest])
    first = once.groupBy("photo_id", "seq").agg(F.min(order).alias("_e"))
    return first.select(*[F.col(c) if c in ("photo_id", "seq") else F.col(f"_e.{c}").alias(c) for c in log.columns])


def quarantined_events(log: DataFrame, actions=EDIT_ACTIONS) -> DataFrame:
    """The events that folding leaves out, with the reason."""
    reason = (
        F.when(F.col("photo_id").isNull() | F.col("seq").isNull(), "no photo or sequence")
        .when(~F.coalesce(F.col("action").isin(*actions), F.lit(False)), "unknown action")
        .when(~F.coalesce(F.col("key").isin(*S.KEYS), F.lit(False)) & ~F.col("action").isin("curve", "mask"), "unknown key")
        .otherwise("no usable value")
    )
    return log.filter(~_sound(actions, log.columns)).withColumn("reason", reason)


def with_chunks(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Number the chunks of each photo in order; every chunk but the last holds ``chunk`` events.

    Chunks are cut by rank, so it doesn't matter how sequence numbers are spaced. Ranks come from a
    range-partitioned sort: a photo of any length is many ranges, and only the counts of (range,
    photo) pairs travel between them.
    """
    order = [F.col(c) for c in ("photo_id", "ts", "seq") if c in log.columns]
    placed = cut_lineage(log.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("photo_id", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("photo_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("photo_id", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", "photo_id").orderBy(*order[1:])
    rank = F.col("_before") + F.row_number().over(inside) - 1
    ranked = placed.join(counts, ["photo_id", "_range"]).withColumn("chunk", F.floor(rank / chunk).cast("int"))
    return ranked.drop("_range", "_before")


def _fold(log: DataFrame, event: str, state: str, initial: str, step: str, chunk: int) -> DataFrame:
    """Fold every photo's events with SQL lambda ``step(s, e)``; returns photo_id and struct s."""

    def one_round(events, states):
        grouped = events.groupBy("photo_id").agg(
            F.expr(f"array_sort(collect_list({event}))").alias("es")
        )
        if states is None:
            grouped = grouped.withColumn("s0", F.expr(f"cast({initial} as {state})"))
        else:
            grouped = (
                states.withColumnRenamed("s", "s0")
                .join(grouped, "photo_id", "full")
                .withColumn("s0", F.coalesce("s0", F.expr(f"cast({initial} as {state})")))
                .withColumn("es", F.coalesce("es", F.array()))
            )
        folded = F.expr(f"aggregate(es, s0, (s, e) -> cast({step} as {state}))")
        return grouped.select("photo_id", folded.alias("s"))

    # only photos with long logs need rounds; there are at most (events / chunk) of them
    log = cut_lineage(log)
    counts = log.groupBy("photo_id").agg(F.count("*").alias("n"))
    long = counts.filter(F.col("n") > chunk).select("photo_id")
    if not long.limit(1).count():
        return one_round(log, None)
    long = cut_lineage(long)
    short_states = one_round(log.join(long, "photo_id", "left_anti"), None)
    # written by chunk, so that a round reads its own chunk only
    place = f"{checkpoint_dir(log.sparkSession)}/chunks-{uuid.uuid4().hex}"
    with_chunks(log.join(long, "photo_id", "left_semi"), chunk).write.partitionBy("chunk").parquet(place)
    chunked = log.sparkSession.read.parquet(place)
    last = chunked.agg(F.max("chunk")).first()[0]
    states = None
    for i in range(last + 1):
        states = cut_lineage(one_round(chunked.filter(F.col("chunk") == i).drop("chunk"), states))
    return short_states.unionByName(states)


# --- adjustments with undo, redo, reset -------------------------------------

_EDIT_STATE = f"struct<current:{ADJ},history:array<{ADJ}>,future:array<{ADJ}>>"
_EDIT_INITIAL = f"named_struct('current', {_NEUTRAL}, 'history', array(), 'future', array())"


def _state(**fields) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _newest(stack: str) -> str:
    """The newest snapshots of a stack, at most the history limit."""
    n = S.HISTORY_LIMIT
    return f"slice({stack}, greatest(1, size({stack}) - {n - 1}), {n})"


_WITH_VALUE = "transform(s.current, (v, i) -> CASE WHEN i = e.k THEN e.value ELSE v END)"
_EDIT_STEP = f"""CASE
  WHEN e.action = 'undo' THEN CASE WHEN size(s.history) = 0 THEN s ELSE {_state(
      current="element_at(s.history, -1)",
      history="slice(s.history, 1, size(s.history) - 1)",
      future="concat(array(s.current), s.future)")} END
  WHEN e.action = 'redo' THEN CASE WHEN size(s.future) = 0 THEN s ELSE {_state(
      current="s.future[0]",
      history="concat(s.history, array(s.current))",
      future="slice(s.future, 2, size(s.future))")} END
  WHEN s.current[e.k] = e.value THEN s
  ELSE {_state(
      current=_WITH_VALUE,
      history=f"CASE WHEN e.action = 'drag' THEN s.history ELSE {_newest('concat(s.history, array(s.current))')} END",
      future=f"cast(array() as array<{ADJ}>)")} END"""


def _value_of_event() -> str:
    """Target value of an adjust or reset event (reset goes to the neutral value)."""
    return f"CASE WHEN action = 'reset' THEN {_NEUTRAL}[{_KEY_INDEX}[key]] ELSE value END"


def _when(log: DataFrame) -> str:
    return "'ts', ts, " if "ts" in log.columns else ""


def fold_edit_log(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Current adjustments and both stacks per photo.

    Actions: ``commit`` and ``drag`` (an adjustment with and without history entry),
    ``reset``, ``undo``, ``redo``. Returns ``photo_id, current, history, future`` with
    snapshots as arrays in the order of ``schema.KEYS``.
    """
    event = (
        f"named_struct({_when(log)}'seq', seq, 'action', action, "
        f"'k', {_KEY_INDEX}[key], 'value', {_value_of_event()})"
    )
    folded = _fold(valid_events(log), event, _EDIT_STATE, _EDIT_INITIAL, _EDIT_STEP, chunk)
    return folded.select("photo_id", "s.current", "s.history", "s.future")


def explode_adjustments(state: DataFrame, column: str = "current") -> DataFrame:
    """Replace a snapshot array by the twenty named columns."""
    return state.select(
        *[c for c in state.columns if c != column],
        *[F.col(column)[i].alias(k) for i, k in enumerate(S.KEYS)],
    )


# --- whole snapshots: adjustments, curve and mask ---------------------------

_APP_STATE = (
    f"struct<current:{SNAPSHOT},rating:int,history:array<{SNAPSHOT}>,future:array<{SNAPSHOT}>>"
)


def _app_initial() -> str:
    points = ", ".join(f"named_struct('id','{i}','x',{x}D,'y',{y}D)" for i, x, y in S.CURVE_DEFAULT)
    mask = ", ".join(f"'{k}', {v}D" for k, v in S.MASK_DEFAULTS.items())
    return (
        f"named_struct('adjustments', {_NEUTRAL}, 'curve', array({points}), "
        f"'mask', named_struct({mask}))"
    )


def _app_step() -> str:
    neutral = _app_initial()
    none = f"cast(array() as array<{SNAPSHOT}>)"
    pushed = "concat(s.history, array(s.current))"
    snap = lambda **f: "named_struct(" + ", ".join(
        f"'{k}', {f.get(k, 's.current.' + k)}" for k in ("adjustments", "curve", "mask")
    ) + ")"
    state = lambda current="s.current", rating="s.rating", history="s.history", future=none: _state(
        current=current, rating=rating, history=history, future=future
    )
    off = lambda a, b: f"abs({a} - {b}) > {S.EDIT_TOLERANCE!r}D"
    curve_edited = (
        f"(size(s.current.curve) <> {len(S.CURVE_DEFAULT)} OR "
        + " OR ".join(
            off(f"get(s.current.curve, {i}).{axis}", f"{v}D")
            for i, (_, x, y) in enumerate(S.CURVE_DEFAULT)
            for axis, v in (("x", x), ("y", y))
        )
        + ")"
    )
    mask_edited = "(" + " OR ".join(off(f"s.current.mask.{k}", f"{v}D") for k, v in S.MASK_DEFAULTS.items()) + ")"
    edited = f"(s.current.adjustments <> {_NEUTRAL} OR {curve_edited} OR {mask_edited})"
    with_value = "transform(s.current.adjustments, (v, i) -> CASE WHEN i = e.k THEN e.value ELSE v END)"
    return f"""CASE e.action
      WHEN 'undo' THEN CASE WHEN size(s.history) = 0 THEN s ELSE {state(
          current="element_at(s.history, -1)", history="slice(s.history, 1, size(s.history) - 1)",
          future="concat(array(s.current), s.future)")} END
      WHEN 'redo' THEN CASE WHEN size(s.future) = 0 THEN s ELSE {state(
          current="s.future[0]", history=pushed, future="slice(s.future, 2, size(s.future))")} END
      WHEN 'rate' THEN {state(rating="CASE WHEN s.rating = 5 THEN 0 ELSE 5 END", future="s.future")}
      WHEN 'begin' THEN {state(history=_newest(pushed))}
      WHEN 'curve' THEN {state(current=snap(curve="e.curve"))}
      WHEN 'mask' THEN {state(current=snap(mask="e.mask"))}
      WHEN 'reset_all' THEN CASE WHEN NOT {edited} THEN s ELSE {state(current=neutral, history=pushed)} END
      ELSE CASE WHEN s.current.adjustments[e.k] = e.value THEN s ELSE {state(
          current=snap(adjustments=with_value), history=_newest(pushed))} END END"""


def fold_app_log(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Fold a log over whole snapshots, with ratings outside the history.

    Actions: ``adjust``, ``reset`` (one key), ``curve``, ``mask``, ``begin`` (an interactive edit
    starts), ``reset_all``, ``undo``, ``redo``, ``rate``. Needs the columns of an edit log plus
    ``curve`` and ``mask``. Every changing adjustment enters the history; curve and mask updates
    do not, the ``begin`` before them does. A reset of everything enters it without the limit.
    """
    event = (
        f"named_struct({_when(log)}'seq', seq, 'action', action, "
        f"'k', {_KEY_INDEX}[key], 'value', {_value_of_event()}, 'curve', curve, 'mask', mask)"
    )
    initial = _state(current=_app_initial(), rating="0", history="array()", future="array()")
    folded = _fold(valid_events(log, APP_ACTIONS), event, _APP_STATE, initial, _app_step(), chunk)
    return folded.select("photo_id", "s.current", "s.rating", "s.history", "s.future")


def edit_status(state: DataFrame) -> DataFrame:
    """Can the photo be undone or redone, and how many edits differ from neutral.

    Takes the states of both folds; with whole snapshots the curve and the mask count as one edit
    each.
    """
    whole = state.schema["current"].dataType.simpleString().startswith("struct")
    values = F.col("current.adjustments") if whole else F.col("current")
    changed = F.aggregate(
        F.zip_with(values, F.expr(_NEUTRAL), lambda v, d: (v != d).cast("int")),
        F.lit(0),
        lambda n, c: n + c,
    )
    if whole:
        changed += has_curve_edits(F.col("current.curve")).cast("int") + has_mask_edits(F.col("current.mask")).cast("int")
    return state.select(
        "photo_id",
        (F.size("history") > 0).alias("can_undo"),
        (F.size("future") > 0).alias("can_redo"),
        changed.alias("n_edits"),
    )


# --- neighbours in the log --------------------------------------------------


def _order(log: DataFrame) -> list[str]:
    return [c for c in ("ts", "seq") if c in log.columns]


def suppress_noop(log: DataFrame) -> DataFrame:
    """Adjust events of a log without undo that really change their key.

    Takes valid events only, as the folds do; ``quarantined_events`` returns the others.
    """
    adjusts = valid_events(log).filter(F.col("action").isin("commit", "drag", "reset")).withColumn(
        "value", F.expr(_value_of_event())
    )
    seen = with_previous(adjusts, ["photo_id", "key"], _order(log), ["value"])
    neutral = F.expr(f"{_NEUTRAL}[{_KEY_INDEX}[key]]")
    before = F.when(F.col("prev_exists"), F.col("prev_value")).otherwise(neutral)
    return seen.filter(~F.col("value").eqNullSafe(before)).select(*log.columns)


def param_history(log: DataFrame) -> DataFrame:
    """History as parameter differences: one row per change with old and new value.

    Takes valid events only, as the folds do.
    """
    adjusts = valid_events(log).filter(F.col("action").isin("commit", "drag", "reset")).withColumn(
        "value", F.expr(_value_of_event())
    )
    seen = with_previous(adjusts, ["photo_id", "key"], _order(log), ["value"])
    neutral = F.expr(f"{_NEUTRAL}[{_KEY_INDEX}[key]]")
    before = F.when(F.col("prev_exists"), F.col("prev_value")).otherwise(neutral)
    return seen.select(
        "photo_id", "seq", "key", before.alias("old_value"), F.col("value").alias("new_value")
    ).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def settled_edits(log: DataFrame, gap_ms: int = S.SETTLE_GAP_MS) -> DataFrame:
    """Edits not followed by another one of the same photo within the gap, in order of (ts, seq)."""
    ordered = with_next(log, ["photo_id"], _order(log), ["ts"])
    wait = F.unix_micros("next_ts") - F.unix_micros("ts")
    return ordered.filter(~F.col("next_exists") | (wait >= gap_ms * 1000)).select(*log.columns)


def throttle_latest(log: DataFrame, window: str = "100 milliseconds") -> DataFrame:
    """Latest edit of each photo per time slot (partial aggregation, no ordering needed)."""
    row = F.struct(*[c for c in log.columns if c != "photo_id"])
    latest = F.max_by(row, F.struct(*_order(log))).alias("e")
    return (
        log.groupBy("photo_id", F.window("ts", window).alias("w")).agg(latest).select("photo_id", "e.*")
    )


def bounded_history(log: DataFrame, limit: int = S.HISTORY_LIMIT) -> DataFrame:
    """Newest ``limit`` commits per photo; Spark cuts each partition to the limit before the shuffle."""
    newest = Window.partitionBy("photo_id").orderBy(F.col("seq").desc())
    return (
        log.filter(F.col("action") == "commit")
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= limit)
    )
