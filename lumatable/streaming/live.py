"""A live view of an edit log: throttled values, and the value each burst ends on."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..operators.editlog import EDIT_ACTIONS, settled_edits, sound_events, valid_events

SLOT_MS = 100
VIEW = "photo_id bigint, ts timestamp, seq bigint, action string, key string, value double, is_latest boolean, is_settled boolean"
_EVENT = "us bigint, seq bigint, action string, key string, value double"
_COLUMNS = ["photo_id", "ts", "seq", "action", "key", "value", "is_latest", "is_settled"]


def live_view(log: DataFrame, slot_ms: int = SLOT_MS, gap_ms: int = S.SETTLE_GAP_MS) -> DataFrame:
    """What a viewer is shown of a stored log, once per (photo, seq).

    An edit is shown if it is the last of its photo in its slot (``is_latest``), or if no other one of
    its photo follows within the gap (``is_settled``). Order is (ts, seq). Takes valid events with a time.
    """
    events = valid_events(log).filter(F.col("ts").isNotNull())
    slot = F.floor(F.unix_micros("ts") / (slot_ms * 1000)).alias("slot")
    latest = events.groupBy("photo_id", slot).agg(F.max(F.struct("ts", "seq")).alias("_e"))
    latest = latest.select("photo_id", F.col("_e.seq").alias("seq"), F.lit(True).alias("_latest"))
    settled = settled_edits(events, gap_ms).select("photo_id", "seq", F.lit(True).alias("_settled"))
    shown = events.join(latest.join(settled, ["photo_id", "seq"], "full"), ["photo_id", "seq"])
    return shown.select(
        *_COLUMNS[:6], F.coalesce("_latest", F.lit(False)).alias("is_latest"), F.coalesce("_settled", F.lit(False)).alias("is_settled")
    )


class LiveView(StatefulProcessor):
    """Holds a photo's edits until the watermark says what they are.

    An edit's slot and gap both have an end; once the watermark has passed the later one nothing can come
    in before it, and the edit leaves the state, as a row or, if it was overtaken in both, without one. An
    event-time timer on the earliest such end closes the edits of a photo that has fallen silent.
    """

    def __init__(self, slot_us: int, gap_us: int):
        self._slot, self._gap = slot_us, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", _EVENT)

    def _end(self, us: int) -> int:
        return max((us // self._slot + 1) * self._slot, us + self._gap)

    def _close(self, key, held: list[tuple], timer_values) -> Iterator[pd.DataFrame]:
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        held.sort(key=lambda e: e[:2])
        rest, out = [], []
        for e, after in zip(held, [*held[1:], None]):
            if self._end(e[0]) > passed:
                rest.append(e)
                continue
            latest = after is None or after[0] // self._slot > e[0] // self._slot
            settled = after is None or after[0] - e[0] >= self._gap
            if latest or settled:
                out.append((key[0], pd.Timestamp(e[0], unit="us"), *e[1:], latest, settled))
        self._held.put(rest) if rest else self._held.clear()
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if rest:
            self._handle.registerTimer(-(-min(self._end(e[0]) for e in rest) // 1000))
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"seq": "int64", "value": "float64", "is_latest": bool, "is_settled": bool})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {e[1]: tuple(e) for e in self._held.get()} if self._held.exists() else {}
        for part in rows:
            for ts, seq, action, name, value in zip(part["ts"], part["seq"], part["action"], part["key"], part["value"]):
                event = (pd.Timestamp(ts).value // 1000, int(seq), action, None if name is None or name != name else name, None if pd.isna(value) else float(value))
                held[event[1]] = min(event, held.get(event[1], event), key=lambda e: e[0])
        yield from self._close(key, list(held.values()), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._close(key, [tuple(e) for e in self._held.get()] if self._held.exists() else [], timerValues)

    def close(self) -> None:
        pass


def stream_live_view(
    log: DataFrame, slot_ms: int = SLOT_MS, gap_ms: int = S.SETTLE_GAP_MS, lateness: str = "1 minute"
) -> DataFrame:
    """``live_view`` of a stream, in one stateful operator; each row appears once, when it is certain.

    Equal to the batch form over the events that come in before the watermark, however they are cut into
    micro-batches. Events behind the watermark are dropped by Spark; redelivered ones count once. Needs
    the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    events = sound_events(log, EDIT_ACTIONS).filter(F.col("ts").isNotNull()).withWatermark("ts", lateness)
    return events.groupBy("photo_id").transformWithStateInPandas(
        LiveView(slot_ms * 1000, gap_ms * 1000), VIEW, "Append", "EventTime"
    )
