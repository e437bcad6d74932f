"""Alerts: derived from frame results, attributed to cameras, freed of repeats, and logged."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoneflow.functions.risk import ESCALATED, risk_by_count
from zoneflow.functions.rounding import fixed_text
from zoneflow.functions.values import filled
from zoneflow.operators.ordered import with_running
from zoneflow.operators.pacing import keep_paced
from zoneflow.params import DEFAULTS, Params


RESET_SPAN_MS = 3_600_000

# The names of the alerts and the wording of their messages, below.


def _alert(kind: str, message: Column, risk: Column, count: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), message.alias("message"), risk.alias("risk"),
        count.cast("long").alias("count"),
    )


Row = Callable[[str], Column]


def overcrowding(params: Params = DEFAULTS, row: Row = F.col) -> Column:
    n = row("current_count")
    message = F.concat(F.lit("People count reached "), n.cast("string"))
    return F.when(n >= params.overcrowd, _alert("overcrowding", message, risk_by_count(n), n))


def sudden_spike(params: Params = DEFAULTS, row: Row = F.col) -> Column:
    n, before = row("current_count"), row("last_count")
    message = F.concat(
        F.lit("People count jumped from "), before.cast("string"), F.lit(" to "), n.cast("string")
    )
    return F.when(
        n - before >= params.spike, _alert("sudden_spike", message, risk_by_count(n), n)
    )


def _score_alert(kind: str, text: str, score: Column, limit: float, row: Row) -> Column:
    message = F.concat(F.lit(text), fixed_text(score, 2))
    return F.when(score >= limit, _alert(kind, message, row("risk"), row("current_count")))


def density_hotspot(params: Params = DEFAULTS, row: Row = F.col) -> Column:
    return _score_alert("density_hotspot", "Density hotspot detected at score ",
                        row("density_score"), params.density_alert, row)


def movement_surge(params: Params = DEFAULTS, row: Row = F.col) -> Column:
    return _score_alert("movement_surge", "Movement surge detected at score ",
                        row("movement_score"), params.movement_alert, row)


def congestion_risk(params: Params = DEFAULTS, row: Row = F.col) -> Column:
    return _score_alert("congestion_risk", "Congestion risk reached ",
                        row("congestion_score"), params.congestion_alert, row)


ALERTS = "array<struct<type:string,message:string,risk:string,count:bigint>>"
RULES = (overcrowding, sudden_spike, density_hotspot, movement_surge, congestion_risk)


def frame_alerts(params: Params = DEFAULTS, row: Row = F.col) -> Column:
    """The alerts of one frame result as an array, in the order of the rules.

    Most frames raise nothing, which a few comparisons tell; only for the others is an array built.
    """
    raised = [rule(params, row) for rule in RULES]
    n = row("current_count")
    any_raised = (
        (n >= params.overcrowd) | (n - row("last_count") >= params.spike)
        | (row("density_score") >= params.density_alert)
        | (row("movement_score") >= params.movement_alert)
        | (row("congestion_score") >= params.congestion_alert)
    )
    return F.when(any_raised, F.array_compact(F.array(*raised))).otherwise(F.array().cast(ALERTS))


def fallback_alert(alerts: Column, risk: Column, count: Column, zone: Column) -> Column:
    """``alerts``, or one synthetic alert where there are none but the risk is escalated."""
    message = F.concat(zone, F.lit(" reported "), risk, F.lit(" crowd density"))
    synthetic = F.array(_alert("overcrowding", message, risk, count))
    none = F.coalesce(F.size(alerts), F.lit(0)) <= 0
    return F.when(none & risk.isin(*ESCALATED), synthetic).otherwise(alerts)


def explode_alerts(metrics: DataFrame, cameras: DataFrame) -> DataFrame:
    """One row per alert with zone and tenant of its camera.

    ``metrics`` has camera_id, frame_id, ts_ms, current_count, risk and alerts; ``cameras`` has
    one row per camera_id with user_id and zone_name. The id is a hash of camera, frame, type and
    place in the array.
    """
    places = cameras.select("camera_id", "user_id", "zone_name")
    raised = metrics.select("camera_id", "frame_id", "ts_ms", "current_count", "risk", "alerts")
    zone, live = F.col("zone_name"), F.coalesce("current_count", F.lit(0))
    alerts = fallback_alert(F.col("alerts"), F.col("risk"), live, zone)
    rows = (
        # Frames that can raise nothing do not reach the join.
        raised.filter((F.size("alerts") > 0) | F.col("risk").isin(*ESCALATED))
        .join(places, "camera_id")
        .select("camera_id", "user_id", "zone_name", "frame_id", "ts_ms", live.alias("_live"),
                F.col("risk").alias("_risk"), F.posexplode(alerts).alias("_nth", "_alert"))
    )
    level = filled(F.col("_alert.risk"), F.col("_risk"), F.lit("Medium"))
    kind = filled(F.col("_alert.type"), F.lit("overcrowding"))
    message = filled(
        F.col("_alert.message"), F.concat(zone, F.lit(" reported "), level, F.lit(" crowd density"))
    )
    identity = F.concat_ws("|", F.col("camera_id").cast("string"),
                           F.col("frame_id").cast("string"), kind, F.col("_nth").cast("string"))
    return rows.select(
        F.sha2(identity, 256).alias("alert_id"), "user_id", "camera_id", "zone_name", "frame_id",
        F.col("ts_ms").alias("created_ms"), kind.alias("type"), message.alias("message"),
        level.alias("risk"), F.coalesce("_alert.count", "_live").alias("count"),
    )


def alert_signature() -> Column:
    return F.concat_ws(":", "type", "message", "risk", F.col("count").cast("string"))


def suppress_repeats(
    alerts: DataFrame,
    keys: Sequence[str] = ("camera_id", "signature"),
    time: str = "created_ms",
    tie: Sequence[str] = ("alert_id",),
    window_ms: int = DEFAULTS.suppress_ms,
    span_ms: int | None = None,
    resets: DataFrame | None = None,
    reset_keys: Sequence[str] = ("camera_id",),
) -> DataFrame:
    """Drop an alert that repeats an accepted one of the same key less than the window ago.

    A dropped alert does not extend the window; exactly the window later passes. ``resets`` has rows
    of ``reset_keys`` and ``time``, for instance the stops of cameras: what was accepted before a
    reset, or at its time, does not hold back what comes after it.
    """
    signed, keys = alerts, list(keys)
    if "signature" in keys and "signature" not in alerts.columns:
        signed = alerts.withColumn("signature", alert_signature())
    if resets is not None:
        signed = _with_generation(signed, resets, list(reset_keys), time)
        keys.append("_generation")
    return keep_paced(signed, keys, time, tie, interval=window_ms, span=span_ms).select(
        *alerts.columns
    )


def _with_generation(
    rows: DataFrame, resets: DataFrame, keys: list[str], time: str
) -> DataFrame:
    """``_generation``: how many resets lie before a row or at its time."""
    marked = rows.withColumn("_row", F.lit(1)).unionByName(
        resets.select(*keys, F.col(time).cast(rows.schema[time].dataType).alias(time))
        .withColumn("_row", F.lit(0)), allowMissingColumns=True,
    )
    counted = with_running(
        marked, keys, [time, "_row"], sums={"_generation": 1 - F.col("_row")}, span=RESET_SPAN_MS
    )
    return counted.filter("_row = 1").drop("_row")


def throttle(
    attempts: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str] = (),
    window_ms: int = DEFAULTS.start_cooldown_ms,
    span_ms: int | None = None,
    resets: DataFrame | None = None,
    reset_keys: Sequence[str] = ("camera_id",),
) -> DataFrame:
    """The same rule for failure logging and stream (re)start attempts."""
    return suppress_repeats(attempts, keys, time, tie, window_ms, span_ms, resets, reset_keys)


def append_alerts(log: DataFrame, new: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The log with new alerts, newest first, trimmed to the retention over all tenants."""
    return (
        log.unionByName(new)
        .orderBy(F.desc("created_ms"), "alert_id")
        .limit(params.alerts_kept)
    )


def alerts_for_tenant(log: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The newest alerts of every tenant, numbered by ``recency`` from 1."""
    newest = W.partitionBy("user_id").orderBy(F.desc("created_ms"), "alert_id")
    return log.withColumn("recency", F.row_number().over(newest)).filter(
        F.col("recency") <= params.alerts_per_user
    )


def latest_incident(log: DataFrame) -> DataFrame:
    """The newest alert of every tenant; the smallest id where times are equal."""
    return alerts_for_tenant(log, Params(alerts_per_user=1)).drop("recency")
