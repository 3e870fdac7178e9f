"""Live edit state per photo."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..operators.editlog import EDIT_ACTIONS

OUTPUT = (
    "photo_id bigint, status string, ts timestamp, seq bigint, action string, key string, value double, "
    "current array<double>, n_history int, n_future int"
)
_STATE = (
    "us bigint, seq bigint, newest bigint, current array<double>, history array<array<double>>, "
    "future array<array<double>>"
)
_EVENT = "us bigint, seq bigint, action string, key string, value double"
_INDEX = {k: i for i, k in enumerate(S.KEYS)}
_NEUTRAL = list(S.ADJUSTMENT_DEFAULTS.values())


def apply_edit(current, history, future, action, key, value):
    """State after one valid event; undo is bounded by the history limit, redo by what was undone."""
    if action == "undo":
        return (history[-1], history[:-1], [current] + future) if history else (current, history, future)
    if action == "redo":
        return (future[0], history + [current], future[1:]) if future else (current, history, future)
    i = _INDEX[key]
    if action == "reset":
        value = _NEUTRAL[i]
    if current[i] == value:
        return current, history, future
    if action != "drag":
        history = (history + [current])[-S.HISTORY_LIMIT :]
    return current[:i] + [value] + current[i + 1 :], history, []


def is_sound(seq, action, key, value) -> bool:
    """The rule of ``editlog.valid_events``."""
    if seq is None or seq != seq or action not in EDIT_ACTIONS:
        return False
    if action in ("undo", "redo"):
        return True
    finite = value is not None and value == value and abs(value) != float("inf")
    return key in _INDEX and (action == "reset" or finite)


class EditState(StatefulProcessor):
    """Keeps one state per photo and the events that may still be overtaken.

    Events are applied in order of (ts, seq) once the photo's newest event is ``lateness`` ahead of
    them; until then they wait in a list, each sequence number once, and only show in the reported
    state. What comes in behind the applied events is returned as a row of status ``late``, what breaks
    the rules of the log as ``invalid``: nothing is dropped.
    """

    def __init__(self, lateness_us: int):
        self._lateness = lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("edit", _STATE)
        self._waiting = handle.getListState("waiting", _EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        done, newest, cur, hist, fut = (-(2**63), -1), -(2**63), list(_NEUTRAL), [], []
        if self._state.exists():
            us, seq, newest, cur, hist, fut = self._state.get()
            done = (us, seq)
            cur, hist, fut = list(cur), [list(h) for h in hist], [list(f) for f in fut]
        waiting = {e[1]: tuple(e) for e in (self._waiting.get() if self._waiting.exists() else [])}
        out = []

        def tell(status, us, seq, action, name, value, state=(None, None, None)):
            ts = pd.NaT if us is None else pd.Timestamp(us, unit="us")
            out.append((key[0], status, ts, seq, action, name, value, *state))

        for part in rows:
            for ts, seq, action, name, value in zip(part["ts"], part["seq"], part["action"], part["key"], part["value"]):
                us = None if pd.isna(ts) else pd.Timestamp(ts).value // 1000
                seq = None if pd.isna(seq) else int(seq)
                name, value = (None if name is None or name != name else name), (None if pd.isna(value) else float(value))
                if us is None or not is_sound(seq, action, name, value):
                    tell("invalid", us, seq, action, name, value)
                elif (us, seq) <= done:
                    tell("late", us, seq, action, name, value)
                else:
                    newest = max(newest, us)
                    event = (us, seq, action, name, value)
                    waiting[seq] = min(event, waiting.get(seq, event), key=lambda e: e[0])
        held = []
        for e in sorted(waiting.values(), key=lambda e: e[:2]):
            if e[0] <= newest - self._lateness:
                cur, hist, fut = apply_edit(cur, hist, fut, *e[2:])
                done = e[:2]
            else:
                held.append(e)
        self._state.update((*done, newest, cur, hist, fut))
        self._waiting.put(held) if held else self._waiting.clear()
        for e in held:
            cur, hist, fut = apply_edit(cur, hist, fut, *e[2:])
        last = held[-1][:2] if held else done
        if last[1] >= 0:
            tell("state", last[0], last[1], None, None, None, (cur, len(hist), len(fut)))
        columns = ["photo_id", "status", "ts", "seq", "action", "key", "value", "current", "n_history", "n_future"]
        yield pd.DataFrame(out, columns=columns).astype({"seq": "Int64", "n_history": "Int32", "n_future": "Int32", "value": "float64"})

    def close(self) -> None:
        pass


def stream_edit_state(log: DataFrame, lateness_ms: int = 60_000) -> DataFrame:
    """Current state per photo, updated with every micro-batch, and rows for late or invalid events.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return log.groupBy("photo_id").transformWithStateInPandas(
        EditState(lateness_ms * 1000), OUTPUT, "Update", "None"
    )
