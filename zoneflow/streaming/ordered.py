"""Keyed state that handles the rows of a key in the order of their times.

Rows are held until the watermark has passed them, so rows of one key may come in any order and in any
micro-batch within the delay. They are held in chunks: those of the last delay by short stretches of time,
older ones, which the next watermark passes together, by some hundred rows. A timer reads the chunks the
watermark has reached and no others, and a key waits for one timer, not for one per chunk. A row that comes later than the delay, or after its key has gone
past its time, is late: it changes no state, and is given out as it is if the caller names a column for
the reason.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zoneflow.session import ROCKSDB, STATE_STORE

EVENT_TIME = "_event_time"
STRETCHES = 16  # of time, in one delay
CHUNK = 512  # rows of times before the last delay that are held together, at least
LATE = "late"


def longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in names])


def _plain(value, kind: T.DataType):
    """A value of a pandas column as the state store takes it."""
    if isinstance(kind, T.ArrayType):
        return None if value is None else [_plain(v, kind.elementType) for v in value]
    if value is None or pd.isna(value):
        return None
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return int(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    if isinstance(kind, T.TimestampType):
        return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value
    return value


class InOrder(StatefulProcessor):
    """``ready`` gets the rows of a key in the order of ``order``, each once the watermark has passed it."""

    def __init__(self, held: T.StructType, time: str, order: Sequence[str], out: T.StructType,
                 late: str | None = None) -> None:
        self.held, self.time, self.out, self.late = held, held.names.index(time), out, late
        self.order = [held.names.index(c) for c in order]
        self.stretch, self.delay, self.places = 1000, 0, {c: i for i, c in enumerate(held.names)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState(
            "waiting", longs("stretch"), T.StructType([T.StructField("rows", T.ArrayType(self.held))]))
        self.passed = handle.getValueState("passed", longs("time"))
        self.start(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        passed = self.passed.get()[0] if self.passed.exists() else watermark - 1
        new, late = [], []
        for batch in rows:
            # By place: pandas gets other names for columns that begin with an underscore.
            columns = [[_plain(v, f.dataType) for v in batch.iloc[:, self.places[f.name]]] for f in self.held]
            for row in zip(*columns, strict=True):
                time = row[self.time]
                if time is None or time < watermark or time <= passed:
                    late.append(row)
                else:
                    new.append(row)
        for stretch, more in self.chunks(new):
            before = self.waiting.getValue((stretch,))[0] if self.waiting.containsKey((stretch,)) else []
            self.waiting.updateValue((stretch,), ([*map(tuple, before), *more],))
        if new:
            first = min(r[self.time] for r in new)
            begin = first // self.stretch * self.stretch
            self.handle.registerTimer(begin if begin > watermark else first)
        yield self.refused(key, late, LATE)

    def stretch_of(self, row: tuple) -> int:
        return row[self.time] // self.stretch

    def chunks(self, rows: list[tuple]) -> list[tuple[int, list[tuple]]]:
        """``rows``, sorted here by stretches, under the first stretch of each chunk; no two have the same."""
        rows.sort(key=self.stretch_of)
        old = max((r[self.time] for r in rows), default=0) - self.delay
        found, last = [], None
        for row in rows:
            stretch, recent = self.stretch_of(row), row[self.time] > old
            if last is None or stretch != last and (recent or len(found[-1][1]) >= CHUNK):
                found.append((stretch, []))
            found[-1][1].append(row)
            last = stretch
        return found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, now = timerValues.getCurrentWatermarkInMs(), []
        wanted = None
        for stretch in sorted(k[0] for k in self.waiting.keys()):
            begin = stretch * self.stretch
            if begin > watermark:
                wanted = begin if wanted is None else min(wanted, begin)
                break
            rows = [tuple(r) for r in self.waiting.getValue((stretch,))[0]]
            later = [r for r in rows if r[self.time] > watermark]
            if len(later) < len(rows):
                now += [r for r in rows if r[self.time] <= watermark]
                if later:
                    self.waiting.updateValue((stretch,), (later,))
                else:
                    self.waiting.removeKey((stretch,))
            if later:
                first = min(r[self.time] for r in later)
                wanted = first if wanted is None else min(wanted, first)
        # One timer for the earliest row or chunk that waits; the timers before are gone or as early.
        if wanted is not None:
            self.handle.registerTimer(int(wanted))
        if now:
            now.sort(key=self.stretch_of)  # chunks may overlap
            now.sort(key=lambda r: tuple((r[i] is not None, r[i]) for i in self.order))
            self.passed.update((int(watermark),))
            yield self.ready(key, now)
        else:
            yield self.given([])
        again = self.forget_at(watermark)
        if again is not None:
            self.handle.registerTimer(int(again))

    def given(self, rows: list, reason: str | None = None) -> pd.DataFrame:
        """Rows in the columns of ``out``, with the reason why they are late if there is a column for it."""
        names = self.out.names
        if self.late is not None:
            rows, names = [(*r, reason) for r in rows], [*names, self.late]
        return pd.DataFrame(rows, columns=names, dtype=object)

    def refused(self, key, rows: list[tuple], reason: str) -> pd.DataFrame:
        """Rows that are not handled, as they came; columns they do not have are null."""
        if self.late is None:
            return self.given([])
        places = [self.held.names.index(c) if c in self.held.names else None for c in self.out.names]
        own = self.key_values(key)
        return self.given([tuple(
            own.get(c) if i is None else r[i] for c, i in zip(self.out.names, places, strict=True)
        ) for r in rows], reason)

    def key_values(self, key) -> dict:
        """Columns of ``out`` that the key holds and the rows do not."""
        return {}

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Open the state of the processor."""
        raise NotImplementedError

    def ready(self, key, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def forget_at(self, passed: int) -> int | None:
        """When the state of the key may be dropped; drops it if that time has passed."""
        return None

    def forgotten(self) -> None:
        """Nothing is known of the key any more: rows before the watermark are late without this."""
        self.passed.clear()

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, keys: Sequence[str], time: str, delay: str, processor: InOrder) -> DataFrame:
    """``rows`` by ``keys`` through ``processor``, in any session and from any folder.

    Spark starts one Python worker for this on the driver, which sees neither shipped archives nor
    the path of the caller, so the processor goes by value: its code is part of the plan. Several
    states per key need RocksDB, which is set on the session. The event time is not handed on, as
    Spark would leave out late rows by it before the processor sees them.
    """
    spark = rows.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    # Some stretches to a delay, whole milliseconds each.
    processor.delay = _milliseconds(spark, delay)
    processor.stretch = max(1, min(processor.delay // STRETCHES, 3_600_000))
    processor.places = {c: i for i, c in enumerate(rows.columns)}
    marked = rows.withColumn(EVENT_TIME, F.timestamp_millis(F.coalesce(time, F.lit(0)))).withWatermark(
        EVENT_TIME, delay).select(*rows.columns)
    schema = T.StructType(list(processor.out.fields))
    if processor.late is not None:
        schema = schema.add(processor.late, T.StringType())
    package = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        return marked.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=schema, outputMode="append",
            timeMode="EventTime",
        )
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def _milliseconds(spark, delay: str) -> int:
    interval = spark.sql(f"select unix_millis(timestamp_millis(0) + interval '{delay}')")
    return int(interval.first()[0])
