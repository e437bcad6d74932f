"""Keyed stateful operators: the ordered operators of the batch side, on a stream.

State lives in RocksDB and is bounded: live tracks and their positions, the last few movements,
counts and points, and counters. A micro-batch gives a key only its new rows; ``ordered`` hands them
over in the order of their times. Each operator can give out late rows instead of dropping them:
``late`` names a column that holds the reason, and is null in all other rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from zoneflow.functions.geometry import CORNERS
from zoneflow.operators.alerts import alert_signature
from zoneflow.operators.detections import frame_signature, nms_frames
from zoneflow.operators.tracker import Live
from zoneflow.operators.tracking import _live_from, _live_rows
from zoneflow.params import DEFAULTS, Params
from zoneflow.streaming.ordered import InOrder, keyed, longs

LONGS = T.ArrayType(T.LongType())
SIGNATURE, ALERT = "zoneflow_signature", "zoneflow_alert"
REPEATED = "frame number does not rise"

COUNTERS = ("last_frame", "next_slot", "entry", "exit", "total", "last_count")
STATE = T.StructType([
    *[T.StructField(c, T.LongType()) for c in COUNTERS],
    *[T.StructField(f"live_{c}", T.ArrayType(T.DoubleType())) for c in CORNERS],
    *[T.StructField(f"live_{c}", LONGS) for c in ("hits", "misses", "slot")],
    *[T.StructField(f"seen_{c}", LONGS) for c in ("slot", "x", "y")],
    T.StructField("movements", T.ArrayType(T.DoubleType())),
    T.StructField("counts", LONGS),
    T.StructField("heat_x", LONGS),
    T.StructField("heat_y", LONGS),
])
TRACKED = ("id", "x", "y", "w", "h")
OUTPUT = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("camera_id", T.LongType()),
    *[T.StructField(c, T.LongType())
      for c in ("frame_id", "ts_ms", "width", "height", "current_count", "zone_left",
                "zone_center", "zone_right", "line_entry", "line_exit", "total_count",
                "base_count", "last_count", "density_count")],
    *[T.StructField(c, T.DoubleType())
      for c in ("bbox_density", "movement", "smoothed_movement", "predicted")],
    T.StructField("count_history", LONGS),
    *[T.StructField(f"_{c}", LONGS) for c in TRACKED],
    T.StructField("_heat_x", LONGS),
    T.StructField("_heat_y", LONGS),
])


class _Camera:
    """State of one camera between frames."""

    def __init__(self, params: Params, stored: dict | None = None) -> None:
        self.params = params
        s = stored or {}
        for name in COUNTERS:
            setattr(self, name, int(s.get(name, 0)))
        size = len(s.get("live_slot", ()))
        rows = [{c: s[f"live_{c}"][i] for c in (*CORNERS, "hits", "misses")} for i in range(size)]
        self.live: Live = _live_from(rows)
        self.live.slot = [int(v) for v in s.get("live_slot", ())]
        self.live.next_slot = self.next_slot or 1
        self.seen = {k: (x, y) for k, x, y in zip(
            s.get("seen_slot", ()), s.get("seen_x", ()), s.get("seen_y", ()))}
        self.movements = deque(s.get("movements", ()), maxlen=params.movement_history)
        self.counts = deque(s.get("counts", ()), maxlen=params.count_history)
        self.heat = deque(zip(s.get("heat_x", ()), s.get("heat_y", ())),
                          maxlen=params.heatmap_history)

    def stored(self) -> tuple:
        live = _live_rows(self.live)
        self.next_slot = self.live.next_slot
        return (
            *[int(getattr(self, c)) for c in COUNTERS],
            *[[float(t[c]) for t in live] for c in CORNERS],
            *[[int(t[c]) for t in live] for c in ("hits", "misses", "slot")],
            list(self.seen), [p[0] for p in self.seen.values()], [p[1] for p in self.seen.values()],
            list(self.movements), list(self.counts),
            [p[0] for p in self.heat], [p[1] for p in self.heat],
        )

    def _tracked(self, boxes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Confirmed tracks of the frame: id, x, y, w, h."""
        if not len(boxes):
            self.live.idle(1, self.params)
            return []
        slot, hits, box, _ = self.live.see(boxes.tolist(), self.params)
        at = np.rint(np.array(box)).astype(np.int64)
        low = np.maximum(at[:, :2], 0)
        size = np.maximum(at[:, 2:], low) - low
        ready = np.array(hits) >= self.params.track_min_hits
        return sorted(zip(np.array(slot)[ready].tolist(), low[ready, 0].tolist(), low[ready, 1].tolist(),
                          size[ready, 0].tolist(), size[ready, 1].tolist()))

    def frame(
        self, number: int, width: int, height: int, boxes: np.ndarray, density: int | None = None
    ) -> dict:
        p = self.params
        self.live.idle(number - self.last_frame - 1, p)
        tracks = self._tracked(boxes)
        line = max(height // 2, 1)
        diagonal = max(float(width * width + height * height) ** 0.5, 1.0)
        zones, steps, area = [0, 0, 0], [], 0
        for track_id, x, y, w, h in tracks:
            cx, cy = x + w // 2, y + h // 2
            zones[0 if cx < width / 3 else 1 if cx < 2 * width / 3 else 2] += 1
            area += w * h
            self.heat.append((cx, cy))
            before = self.seen.get(track_id)
            if before is None:
                self.total += 1
            else:
                steps.append(((cx - before[0]) ** 2 + (cy - before[1]) ** 2) ** 0.5 / diagonal)
                self.entry += before[1] < line <= cy
                self.exit += before[1] > line >= cy
            self.seen[track_id] = (cx, cy)
        # A track that is no longer live never returns; its position is not needed again.
        alive = set(self.live.slot)
        self.seen = {k: v for k, v in self.seen.items() if k in alive}
        movement = sum(steps) / len(steps) if steps else 0.0
        self.movements.append(movement)
        # The density model's count stands in dense frames only.
        dense = len(tracks) >= p.dense_count and density is not None
        base = max(density, 0) if dense else len(tracks)
        self.counts.append(base)
        last_count, self.last_count = self.last_count, len(tracks)
        self.last_frame = number
        return {
            "frame_id": number, "width": width, "height": height, "current_count": len(tracks),
            "zone_left": zones[0], "zone_center": zones[1], "zone_right": zones[2],
            "line_entry": self.entry, "line_exit": self.exit, "total_count": self.total,
            "base_count": base, "last_count": last_count,
            "bbox_density": min(area / max(width * height, 1), 1.0), "movement": movement,
            "smoothed_movement": sum(self.movements) / len(self.movements),
            "count_history": list(self.counts),
            **{f"_{c}": [t[i] for t in tracks] for i, c in enumerate(TRACKED)},
            "_heat_x": [q[0] for q in self.heat], "_heat_y": [q[1] for q in self.heat],
        }


# ---- frames ------------------------------------------------------------------------------


class Sampling:
    """Which frames of a live camera are handled: of those at least ``interval`` after the last one that
    was, each ``every``-th."""

    STATE = longs("last", "eligible", "kept")

    def __init__(self, interval: int, every: int, state: tuple | None = None) -> None:
        self.interval, self.every = interval, max(every, 1)
        self.last, self.eligible, self.kept = state or (None, 0, 0)

    def take(self, time: int) -> int | None:
        """The number of the frame among the handled ones, from 1; None if it is passed over."""
        if self.last is not None and time - self.last < self.interval:
            return None
        self.eligible += 1
        if self.eligible % self.every:
            return None
        self.last, self.kept = time, self.kept + 1
        return self.kept

    def state(self) -> tuple:
        return self.last, self.eligible, self.kept


class CameraProcessor(InOrder):
    """Frames of a camera in the order of their times. With ``sampling`` (interval and share) only some
    are handled, numbered anew; otherwise those whose number does not rise are given out as refused."""

    def __init__(self, held: T.StructType, params: Params, late: str | None,
                 sampling: tuple[int, int] | None = None) -> None:
        super().__init__(held, "ts_ms", ["ts_ms", "frame_id"] if sampling else ["frame_id"], OUTPUT, late)
        self.params, self.sampling = params, sampling

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("camera", STATE)
        if self.sampling:
            self.sampled = handle.getValueState("sampled", Sampling.STATE)

    def key_values(self, key) -> dict:
        return {"user_id": key[0], "camera_id": key[1]}

    def ready(self, key, rows: list[tuple]) -> pd.DataFrame:
        stored = dict(zip(STATE.names, self.state.get())) if self.state.exists() else None
        camera, out, repeated = _Camera(self.params, stored), [], []
        sampler = None
        if self.sampling:
            sampler = Sampling(*self.sampling, self.sampled.get() if self.sampled.exists() else None)
        for values in rows:
            row = dict(zip(self.held.names, values))
            number = sampler.take(row["ts_ms"]) if sampler else row["frame_id"]
            if number is None:
                continue
            if number <= camera.last_frame:
                repeated.append(values)
                continue
            boxes = np.array([row[c] for c in CORNERS], dtype=np.float32).T.reshape(-1, 4)
            result = camera.frame(number, row["width"], row["height"], boxes, row["density_count"])
            own = {c: row[c] for c in ("ts_ms", "density_count", "predicted")}
            done = {"user_id": key[0], "camera_id": key[1], **own, **result}
            out.append(tuple(done[c] for c in OUTPUT.names))
        self.state.update(camera.stored())
        if sampler:
            self.sampled.update(sampler.state())
        if self.late is None or not repeated:
            return self.given(out)
        return pd.concat([self.given(out), self.refused(key, repeated, REPEATED)], ignore_index=True)


def camera_processor(
    frames: DataFrame, params: Params = DEFAULTS, delay: str = "10 seconds", sample: bool = False,
    late: str | None = None,
) -> DataFrame:
    """Frames with raw detections in, frames with tracks and history out (see ``with_results``).

    ``frames`` is a stream in the shape of ``schemas.FRAME_STREAM``; ``ts_ms`` is its event time.
    Filtering and overlap suppression run before the only shuffle. A frame is handled once the
    watermark has passed it; a repeated frame is dropped. With ``sample`` the frames of a camera are
    thinned first, as ``sample_frames`` does, in the same state; ``frame_id`` then numbers what is left.
    ``late`` names a column: frames that came too late or whose number does not rise are then given
    out too, without results, and with the reason in it.
    """
    clean = nms_frames(frames, params)
    boxes = [F.col("detections")[c].alias(c) for c in CORNERS]
    said = [
        (F.col(c) if c in frames.columns else F.lit(None)).cast(kind).alias(c)
        for c, kind in (("density_count", "long"), ("predicted", "double"))
    ]
    given = clean.select(
        "user_id", "camera_id", "frame_id", "ts_ms", "width", "height", *boxes, *said
    )
    held = T.StructType([f for f in given.schema if f.name not in ("user_id", "camera_id")])
    paced = (params.frame_interval_ms, params.frame_skip) if sample else None
    counted = keyed(
        given, ("user_id", "camera_id"), "ts_ms", delay, CameraProcessor(held, params, late, paced))
    detections = F.transform(
        F.arrays_zip(*[f"_{c}" for c in TRACKED]),
        lambda t: F.struct(
            t["_id"].alias("id"), F.array(*[t[f"_{c}"].cast("int") for c in TRACKED[1:]]).alias("bbox")
        ),
    )
    points = F.transform(
        F.arrays_zip("_heat_x", "_heat_y"),
        lambda q: F.struct(q["_heat_x"].cast("int").alias("x"), q["_heat_y"].cast("int").alias("y")),
    )
    hidden = [f"_{c}" for c in TRACKED] + ["_heat_x", "_heat_y"]
    return counted.select(
        *[c for c in counted.columns if c not in hidden],
        F.col("_id").alias("active_track_ids"), detections.alias("detections"),
        points.alias("heatmap_points"),
    )


class _Sample(InOrder):
    """Rows left by one of the samplers, with the number of each."""

    def __init__(self, held: T.StructType, time: str, order: Sequence[str], late: str | None,
                 interval: int, every: int) -> None:
        out = T.StructType([*held.fields, T.StructField("sample_id", T.LongType())])
        super().__init__(held, time, order, out, late)
        self.interval, self.every = interval, every

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sampled", Sampling.STATE)

    def ready(self, key, rows: list[tuple]) -> pd.DataFrame:
        sampler = Sampling(self.interval, self.every, self.state.get() if self.state.exists() else None)
        kept = [(*row, number) for row in rows if (number := sampler.take(row[self.time])) is not None]
        self.state.update(sampler.state())
        return self.given(kept)


def sample_stream(
    frames: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = ("camera_id",),
    time: str = "ts_ms", tie: Sequence[str] = ("frame_id",), interval: int | None = None,
    delay: str = "10 seconds", late: str | None = None,
) -> DataFrame:
    """``sample_frames`` on a stream whose rows are at most ``delay`` late."""
    interval = params.frame_interval_ms if interval is None else interval
    return keyed(frames, keys, time, delay, _Sample(
        frames.schema, time, [time, *tie], late, interval, params.frame_skip))


class _EveryNth(_Sample):
    def ready(self, key, rows: list[tuple]) -> pd.DataFrame:
        _, seen, kept = self.state.get() if self.state.exists() else (None, 0, 0)
        out = []
        for row in rows:
            seen += 1
            if seen % self.every == 0:
                kept += 1
                out.append((*row, kept))
        self.state.update((None, seen, kept))
        return self.given(out)


def sample_every_stream(
    frames: DataFrame, every: int = DEFAULTS.frame_skip, keys: Sequence[str] = ("camera_id",),
    order: Sequence[str] = ("frame_id",), time: str = "ts_ms", delay: str = "10 seconds",
    late: str | None = None,
) -> DataFrame:
    """``sample_every`` on a stream: each ``every``-th frame, in the order of ``order`` within the delay."""
    return keyed(frames, keys, time, delay, _EveryNth(frames.schema, time, order, late, 0, max(every, 1)))


class _Fresh(InOrder):
    def __init__(self, held: T.StructType, time: str, order: Sequence[str], late: str | None) -> None:
        super().__init__(held, time, order, held, late)
        self.signed = held.names.index(SIGNATURE)

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("signature", T.StructType([T.StructField("last", T.StringType())]))

    def ready(self, key, rows: list[tuple]) -> pd.DataFrame:
        last, kept = self.state.get()[0] if self.state.exists() else None, []
        for row in rows:
            if row[self.signed] is None or row[self.signed] != last:
                kept.append(row)
            last = row[self.signed]
        self.state.update((last,))
        return self.given(kept)


def dedup_stream(
    results: DataFrame, keys: Sequence[str] = ("camera_id",), order: Sequence[str] = ("seq",),
    time: str = "ts_ms", delay: str = "10 seconds", late: str | None = None,
) -> DataFrame:
    """``dedup_consecutive`` on a stream whose rows are at most ``delay`` late."""
    signed = results.withColumn(SIGNATURE, frame_signature())
    return keyed(signed, keys, time, delay, _Fresh(signed.schema, time, order, late)).drop(SIGNATURE)


# ---- alerts ------------------------------------------------------------------------------


class _Pace(InOrder):
    """Rows at least a window after the last accepted one of their kind; a reset forgets all kinds.

    ``kind``: columns that tell the kinds of a key apart, none where the key is the kind.
    """

    def __init__(self, held: T.StructType, time: str, tie: Sequence[str], window_ms: int,
                 late: str | None, kind: Sequence[str] = (), reset: str | None = None) -> None:
        super().__init__(held, time, [time, *([reset] if reset else []), *tie], held, late)
        self.window_ms = window_ms
        self.kind = [held.names.index(c) for c in kind]
        self.reset = held.names.index(reset) if reset else None

    def start(self, handle: StatefulProcessorHandle) -> None:
        names = T.StructType([T.StructField("kind", T.StringType())])
        self.state = handle.getMapState("accepted", names, longs("last"))

    def ready(self, key, rows: list[tuple]) -> pd.DataFrame:
        last = {k[0]: v[0] for k, v in self.state.iterator()}
        kept, touched = [], set()
        for row in rows:
            if self.reset is not None and not row[self.reset]:
                last.clear()
                self.state.clear()
                touched.clear()
                continue
            kind = repr([row[i] for i in self.kind])
            if kind not in last or row[self.time] - last[kind] >= self.window_ms:
                last[kind] = row[self.time]
                touched.add(kind)
                kept.append(row)
        for kind in touched:
            self.state.updateValue((kind,), (int(last[kind]),))
        return self.given(kept)

    def forget_at(self, passed: int) -> int | None:
        # Whatever comes after the watermark is then accepted without knowing the last one.
        over = {k[0]: v[0] + self.window_ms for k, v in self.state.iterator()}
        for kind, time in over.items():
            if time <= passed:
                self.state.removeKey((kind,))
        left = [time for time in over.values() if time > passed]
        if not left and over:
            self.forgotten()
        return min(left, default=None)


def suppress_stream(
    alerts: DataFrame,
    keys: Sequence[str] = ("camera_id", "signature"),
    time: str = "created_ms",
    tie: Sequence[str] = ("alert_id",),
    window_ms: int = DEFAULTS.suppress_ms,
    delay: str = "10 minutes",
    resets: DataFrame | None = None,
    reset_keys: Sequence[str] = ("camera_id",),
    late: str | None = None,
) -> DataFrame:
    """``suppress_repeats`` on a stream whose rows are at most ``delay`` late.

    An alert is decided on once the watermark has passed it. The state of a kind is dropped when the
    watermark has passed its window. ``resets`` is a stream with ``reset_keys`` (some of ``keys``) and
    ``time``, for instance the stops of cameras: what was accepted before a reset, or at its time, does
    not hold back what comes after it. Both streams are then one, by ``reset_keys``.
    """
    columns = alerts.columns
    signed = alerts
    if "signature" in keys and "signature" not in columns:
        signed = alerts.withColumn("signature", alert_signature())
    shown = [*columns, *([late] if late else [])]
    if resets is None:
        return keyed(signed, keys, time, delay, _Pace(signed.schema, time, tie, window_ms, late)).select(*shown)
    kind = [c for c in keys if c not in reset_keys]
    stops = resets.select(*reset_keys, F.col(time).cast(signed.schema[time].dataType).alias(time))
    both = signed.withColumn(ALERT, F.lit(1)).unionByName(
        stops.withColumn(ALERT, F.lit(0)), allowMissingColumns=True)
    both = both.select(*[F.col(f"`{c}`") for c in both.columns])
    paced = keyed(both, reset_keys, time, delay, _Pace(both.schema, time, tie, window_ms, late, kind, ALERT))
    return paced.filter(F.col(ALERT) == 1).select(*shown)


def throttle_stream(
    attempts: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str] = (),
    window_ms: int = DEFAULTS.start_cooldown_ms, delay: str = "10 minutes",
    resets: DataFrame | None = None, reset_keys: Sequence[str] = ("camera_id",), late: str | None = None,
) -> DataFrame:
    """The same rule for failure logging and stream (re)start attempts."""
    return suppress_stream(attempts, keys, time, tie, window_ms, delay, resets, reset_keys, late)


# ---- counts ------------------------------------------------------------------------------


class _Arrivals(InOrder):
    def start(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("arrivals", longs("last", "total"))
        self.count = self.held.names.index("current_count")

    def ready(self, key, rows: list[tuple]) -> pd.DataFrame:
        last, total = self.state.get() if self.state.exists() else (0, 0)
        out = []
        for row in rows:
            count = max(row[self.count] or 0, 0)
            total += max(count - last, 0)
            last = count
            out.append((*row[:self.count], count, *row[self.count + 1:], total))
        self.state.update((int(last), int(total)))
        return self.given(out)


def count_stream(
    series: DataFrame, keys: Sequence[str] = ("source",), order: str = "frame_id",
    time: str = "updated_ms", delay: str = "10 seconds", late: str | None = None,
) -> DataFrame:
    """``running_arrivals`` on a stream whose rows are at most ``delay`` late by ``time``."""
    out = T.StructType([*series.schema.fields, T.StructField("total_count", T.LongType())])
    return keyed(series, keys, time, delay, _Arrivals(series.schema, time, [order], out, late))
