"""Small relational layer: keyed updates, current states, job ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoneflow.functions.risk import LEVELS
from zoneflow.operators.frames import empty_metrics, latest_by
from zoneflow.operators.ordered import with_running

DAY_MS = 86_400_000
TERMINAL = ("completed", "failed")
STARTED = "processing_started"


def upsert(base: DataFrame, changes: DataFrame, key: str, *order: str) -> DataFrame:
    """``base`` with rows replaced or added by the last change of each key."""
    # One grouping over both: a change, of any age, comes after the row of the base.
    stored = base.withColumn("_age", F.lit(0)).withColumns(
        {c: F.lit(None).cast(changes.schema[c].dataType) for c in order if c not in base.columns}
    )
    new = changes.select(*base.columns, *[c for c in order if c not in base.columns])
    both = stored.unionByName(new.withColumn("_age", F.lit(1)))
    return latest_by(both, [key], "_age", *order).select(*base.columns)


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def reset_statuses(cameras: DataFrame) -> DataFrame:
    return cameras.withColumn("status", F.lit("stopped"))


def camera_state(events: DataFrame) -> DataFrame:
    """State of every camera that is not deleted, from add / start / stop / delete events.

    A start of a camera that runs already does nothing. Both a start and a stop zero the metrics, so
    only status and times survive from the events.
    Columns: camera_id, tenant_id, status, last_started_ms, last_event_ms, and the zero metrics.
    """
    last = _spans_of(events).withColumn("_started", F.greatest("_inner", F.when(
        (F.col("_first.action") == "start") & ~F.col("_before").eqNullSafe("start"), F.col("_first.at"))))
    last = last.groupBy("camera_id").agg(
        F.max_by("_last", "_last.at").alias("_end"), F.max("_started").alias("_started"),
        F.max("_deleted").alias("_deleted"),
    ).select("camera_id", F.col("_end.tenant_id").alias("tenant_id"), F.col("_end.action").alias("_action"),
             F.col("_end.at.ts_ms").alias("last_event_ms"), "_started", "_deleted")
    # A deleted camera that is added again has not been started yet.
    alive = F.col("_deleted").isNull() | (F.col("_started") > F.col("_deleted"))
    return last.filter(F.col("_action") != "delete").select(
        "camera_id", "tenant_id",
        F.when(F.col("_action") == "start", "running").otherwise("stopped").alias("status"),
        F.when(alive, F.col("_started.ts_ms")).alias("last_started_ms"),
        "last_event_ms",
        F.lit(0).cast("long").alias("current_count"),
        F.lit(0).cast("long").alias("total_count"),
        F.lit(LEVELS[0]).alias("risk"),
        F.lit("idle").alias("processing_status"),
    )


def _spans_of(events: DataFrame) -> DataFrame:
    """What the events of a camera and day come to: the first and the last one, the last delete, the last
    start that follows no start within the day (``_inner``), and the action before the first one.

    A row per camera and day is all that is ordered over a camera's life.
    """
    at = F.struct("ts_ms", "seq").alias("at")
    listed = F.sort_array(F.collect_list(F.struct(at, "action", "tenant_id")))
    day = F.floor(F.col("ts_ms") / DAY_MS)
    spans = events.groupBy("camera_id", day.alias("_day")).agg(listed.alias("_events"))
    starts = F.filter("_events", lambda e, i: (i > 0) & (e["action"] == "start") & (
        F.get("_events", i - 1)["action"] != "start"))
    deletes = F.filter("_events", lambda e: e["action"] == "delete")
    life = W.partitionBy("camera_id").orderBy("_day")
    return spans.select(
        "camera_id", "_day", F.element_at("_events", 1).alias("_first"), F.element_at("_events", -1).alias("_last"),
        F.try_element_at(starts, F.lit(-1))["at"].alias("_inner"),
        F.try_element_at(deletes, F.lit(-1))["at"].alias("_deleted"),
    ).withColumn("_before", F.lag("_last.action").over(life))


def _with_action_before(events: DataFrame) -> DataFrame:
    return with_running(
        events, ["camera_id"], ["ts_ms", "seq"], previous={"_before": F.col("action")}, span=DAY_MS
    )


def distinct_paths(df: DataFrame, column: str = "paths") -> DataFrame:
    """Non-empty distinct clean-up paths of each job, first occurrence first."""
    given = F.filter(F.coalesce(column, F.array().cast("array<string>")),
                     lambda p: F.coalesce(p, F.lit("")) != "")
    return df.withColumn(column, F.array_distinct(given))


def cameras_with_metrics(cameras: DataFrame, latest: DataFrame) -> DataFrame:
    """Every camera with its latest metrics; zeros where it has none."""
    return empty_metrics(cameras.join(latest, "camera_id", "left"))


def job_ledger(events: DataFrame) -> DataFrame:
    """Latest event of every job; a terminal status wins over a later start message."""
    ranked = events.withColumn("_terminal", F.col("status").isin(*TERMINAL))
    return latest_by(ranked, ["job_id"], "_terminal", "ts_ms", "seq").drop("_terminal")


def jobs_with_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Every job with its delivered result; without one it is still ``processing_started``."""
    delivered = results.select("job_id", F.col("status").alias("_status"),
                               *[c for c in results.columns if c not in ("job_id", "status")])
    return (
        jobs.join(delivered, "job_id", "left")
        .withColumn("status", F.coalesce("_status", F.lit(STARTED)))
        .drop("_status")
    )


def active_streams(events: DataFrame) -> DataFrame:
    """Cameras whose last start or stop event is a start, with the time they have been running since.

    A start of a camera that runs already does nothing.
    """
    switches = events.filter(F.col("action").isin("start", "stop", "delete"))
    starts = (F.col("action") == "start") & ~F.col("_before").eqNullSafe("start")
    return (
        _with_action_before(switches).groupBy("camera_id")
        .agg(F.max_by("action", F.struct("ts_ms", "seq")).alias("_action"),
             F.max(F.when(starts, F.col("ts_ms"))).alias("started_ms"))
        .filter(F.col("_action") == "start")
        .select("camera_id", "started_ms")
    )
