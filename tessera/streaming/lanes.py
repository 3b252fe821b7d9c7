"""Lanes (workers, users, vehicles) that fall silent: keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "lane long, since long, reason string"
#: Times that are held of one lane's batch before they are thinned out.
_HELD = 4_096


def thinned(times: Iterable[int], quiet: int) -> list[int]:
    """Times in order, without those whose neighbours are at most ``quiet`` apart: silences and their beginnings stay the same, whatever comes between."""
    out: list[int] = []
    for t in sorted(set(times)):
        while len(out) > 1 and t - out[-2] <= quiet:
            out.pop()
        out.append(t)
    return out


class Silences(StatefulProcessor):
    """A row for each activity that no other of its lane follows within ``quiet`` ms of event time.

    State of a lane, one value that is read and written once a call: the times
    that may still begin a silence (thinned out: at most two for each ``quiet`` of
    the watermark's delay), when it was started and where its timer stands. The
    one timer stands at the end of the first open time's wait. A lane that is only started, by the initial
    state, has "no_activity", any other "stale".
    """

    def __init__(self, quiet: int):
        self._quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._own = handle.getValueState("own", "started long, timer long, open array<long>")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self._settle([initialState.at], initialState.at, None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        started, timer, times = self._owned()
        for row in rows:
            times.append(row.at)
            if len(times) > _HELD:
                times = thinned(times, self._quiet)
            if row.at == started:
                started = None  # what was started then was also active
        self._settle(thinned(times, self._quiet), started, timer)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        started, _, times = self._owned()
        out = []
        while times and times[0] + self._quiet < now:
            first, *times = times
            if not times or times[0] - first > self._quiet:
                out.append(Row(lane=key[0], since=first, reason="no_activity" if first == started else "stale"))
        self._settle(times, started, None)
        return iter(out)

    def _owned(self) -> tuple[int | None, int | None, list[int]]:
        started, timer, times = self._own.get() or (None, None, ())
        return started, timer, list(times or ())

    def _settle(self, times: list[int], started: int | None, timer: int | None) -> None:
        wanted = times[0] + self._quiet + 1 if times else None  # a timer fires when the watermark has reached it
        if wanted != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            if wanted is not None:
                self._handle.registerTimer(wanted)
        self._own.update((started, wanted, times))


def silences(activity: DataFrame, lane: str, time: str, quiet_ms: int, late: str, started: DataFrame | None = None) -> DataFrame:
    """lane, since, reason of each silence of more than ``quiet_ms`` that the watermark has passed, in event time.

    ``started`` is a finished table (lane, time of the start) that becomes the
    first state. Times may come in any order within the watermark's delay; rows
    behind it are dropped, and counted as such by the query's progress. Needs the
    RocksDB state store.
    """
    millis = lambda c: F.floor(F.unix_micros(c) / 1000).cast("long")
    rows = activity.withWatermark(time, late).select(F.col(lane).cast("long").alias("lane"), F.col(time).alias("_time"), millis(time).alias("at"))
    first = None if started is None else started.select(F.col(lane).cast("long").alias("lane"), millis(time).alias("at")).groupBy("lane").agg(F.min("at").alias("at")).groupBy("lane")
    out = rows.groupBy("lane").transformWithState(Silences(quiet_ms), _OUT, "append", "EventTime", first)
    return out.select("lane", F.timestamp_millis("since").alias("since"), "reason")


class Heartbeats(StatefulProcessor):
    """Of each lane that stays silent for ``quiet`` ms of processing time one row, once; what is known of a lane goes ``forget`` ms after its last row."""

    def __init__(self, quiet: int, forget: int):
        self._quiet, self._forget = quiet, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "at long, timer long", self._forget)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        latest = max(r.at for r in rows)
        if self._last.exists():
            at, timer = self._last.get()
            latest = max(latest, at)
            if timer is not None:
                self._handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self._quiet
        self._handle.registerTimer(timer)
        self._last.update((latest, timer))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._last.exists():
            at, _ = self._last.get()
            self._last.update((at, None))
            yield Row(lane=key[0], since=at, reason="stale")


def heartbeats(activity: DataFrame, lane: str, time: str, quiet_ms: int, forget_ms: int) -> DataFrame:
    """lane, since (its last event time), reason of lanes that no row has reached for ``quiet_ms``: for services, since time runs on without rows.

    ``forget_ms`` is the time to live of a lane's state and must exceed ``quiet_ms``. Needs the RocksDB state store.
    """
    if forget_ms <= quiet_ms:
        raise ValueError("a lane would be forgotten before it is stale")
    rows = activity.select(F.col(lane).cast("long").alias("lane"), F.floor(F.unix_micros(time) / 1000).cast("long").alias("at"))
    out = rows.groupBy("lane").transformWithState(Heartbeats(quiet_ms, forget_ms), _OUT, "update", "ProcessingTime")
    return out.select("lane", F.timestamp_millis("since").alias("since"), "reason")
