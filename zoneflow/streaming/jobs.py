"""Job ledgers and active cameras, kept by a stream.

Both give out a row whenever the state of their key changes, numbered by ``change``; the row with the
largest number is the current one, for instance in a ``keyed_table`` by that order.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from zoneflow.operators.tables import TERMINAL
from zoneflow.streaming.ordered import InOrder, keyed, longs

DAY_MS = 86_400_000
CHANGES = [T.StructField("change", T.LongType())]


class _Ledger(InOrder):
    """The event of a job that counts: a terminal status wins over all others, then the later event."""

    def __init__(self, held: T.StructType, late: str | None, overdue_ms: int, keep_ms: int) -> None:
        out = T.StructType([*held.fields, T.StructField("overdue", T.BooleanType()), *CHANGES])
        super().__init__(held, "ts_ms", ["ts_ms", "seq"], out, late)
        self.status, self.seq = held.names.index("status"), held.names.index("seq")
        self.overdue_ms, self.keep_ms = overdue_ms, keep_ms

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("event", T.StructType([
            T.StructField("row", self.held), *longs("change", "latest").fields,
            T.StructField("overdue", T.BooleanType())]))

    def _rank(self, row: tuple) -> tuple:
        return row[self.status] in TERMINAL, row[self.time], row[self.seq]

    def ready(self, key, rows: list[tuple]) -> pd.DataFrame:
        best, change, latest, out = None, 0, 0, []
        if self.state.exists():
            best, change, latest, _ = self.state.get()
            best = tuple(best)
        for row in rows:
            latest = max(latest, row[self.time])
            if best is None or self._rank(row) > self._rank(best):
                best, change = row, change + 1
                out.append((*row, False, change))
        self.state.update((best, int(change), int(latest), False))
        return self.given(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if not self.state.exists():
            return
        row, change, latest, overdue = self.state.get()
        row = tuple(row)
        waited = timerValues.getCurrentWatermarkInMs() - latest
        if not overdue and row[self.status] not in TERMINAL and waited >= self.overdue_ms:
            self.state.update((row, int(change) + 1, int(latest), True))
            yield self.given([(*row, True, change + 1)])

    def forget_at(self, passed: int) -> int | None:
        if not self.state.exists():
            return None
        row, _, latest, overdue = self.state.get()
        if latest + self.keep_ms <= passed:
            self.state.clear()
            self.forgotten()
            return None
        if overdue or tuple(row)[self.status] in TERMINAL or latest + self.overdue_ms <= passed:
            return latest + self.keep_ms
        return latest + self.overdue_ms


def job_ledger_stream(
    events: DataFrame, overdue_ms: int = DAY_MS, keep_ms: int = 30 * DAY_MS, delay: str = "10 minutes",
    late: str | None = None,
) -> DataFrame:
    """``job_ledger`` on a stream: a row for each change of a job, with ``overdue`` and ``change``.

    A job that has no terminal status ``overdue_ms`` after its last event is given out once more with
    ``overdue`` true. What comes for a job after a terminal status changes nothing, but for a later
    terminal one. The state of a job is dropped ``keep_ms`` after its last event.
    """
    return keyed(events, ("job_id",), "ts_ms", delay, _Ledger(events.schema, late, overdue_ms, keep_ms))


class _Active(InOrder):
    OUT = T.StructType([
        T.StructField("camera_id", T.LongType()), T.StructField("active", T.BooleanType()),
        T.StructField("started_ms", T.LongType()), *CHANGES])

    def __init__(self, held: T.StructType, late: str | None) -> None:
        super().__init__(held, "ts_ms", ["ts_ms", "seq"], self.OUT, late)
        self.action = held.names.index("action")

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("active", longs("running", "started", "change"))

    def key_values(self, key) -> dict:
        return {"camera_id": key[0]}

    def ready(self, key, rows: list[tuple]) -> pd.DataFrame:
        running, started, change = self.state.get() if self.state.exists() else (0, None, 0)
        out = []
        for row in rows:
            starts = row[self.action] == "start"
            if starts == bool(running):
                continue  # a start of a camera that runs, or a stop of one that does not
            running, change = int(starts), change + 1
            started = row[self.time] if starts else started
            out.append((key[0], starts, started if starts else None, change))
        self.state.update((running, started, change))
        return self.given(out)


def active_streams_stream(
    events: DataFrame, actions: Sequence[str] = ("start", "stop", "delete"), delay: str = "10 minutes",
    late: str | None = None,
) -> DataFrame:
    """``active_streams`` on a stream: a row when a camera begins or ends to run."""
    switches = events.filter(events["action"].isin(*actions))
    return keyed(switches, ("camera_id",), "ts_ms", delay, _Active(switches.schema, late))
