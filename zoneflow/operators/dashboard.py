"""Per-tenant summary, rankings and watch lists over current cameras and the alert log."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoneflow.functions.risk import ESCALATED
from zoneflow.operators.alerts import alerts_for_tenant
from zoneflow.operators.projections import for_tenant, with_live_count
from zoneflow.params import DEFAULTS, Params

RUNNING = "running"


def summary(cameras: DataFrame) -> DataFrame:
    """Zones, running zones, people now and zones at escalated risk, per tenant."""
    return with_live_count(cameras, "_live").groupBy("user_id").agg(
        F.count("*").alias("total_zones"),
        F.count_if(F.col("status") == RUNNING).alias("active_zones"),
        F.sum("_live").alias("total_count"),
        F.count_if(F.col("risk").isin(*ESCALATED)).alias("high_risk_zones"),
    )


def _best(cameras: DataFrame, score: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy(F.desc(score), "camera_id")
    return (
        cameras.filter(F.col("status") == RUNNING)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def most_crowded(cameras: DataFrame) -> DataFrame:
    """The running camera with the highest count per tenant; smallest id where equal."""
    return _best(with_live_count(cameras), "live_count")


def top_risk_zone(cameras: DataFrame, score: str = "congestion_score") -> DataFrame:
    """The running camera with the highest score per tenant; smallest id where equal."""
    scored = cameras.withColumn("_score", F.coalesce(F.col(score), F.lit(0.0)))
    return _best(scored, "_score").drop("_score")


def risk_watch(cameras: DataFrame, k: int = 4) -> DataFrame:
    """The first cameras at escalated risk per tenant, by camera id."""
    order = W.partitionBy("user_id").orderBy("camera_id")
    return (
        cameras.filter(F.col("risk").isin(*ESCALATED))
        .withColumn("watch_rank", F.row_number().over(order))
        .filter(F.col("watch_rank") <= k)
    )


class Dashboard(NamedTuple):
    summary: DataFrame
    cameras: DataFrame
    alerts: DataFrame


def dashboard(
    cameras: DataFrame, alerts: DataFrame, user_id=None, params: Params = DEFAULTS
) -> Dashboard:
    """The three tables of a dashboard, of one tenant or of all.

    They stay tables: a tenant with very many cameras is never gathered into one row.
    """
    if user_id is not None:
        cameras, alerts = for_tenant(cameras, user_id), for_tenant(alerts, user_id)
    return Dashboard(summary(cameras), cameras, alerts_for_tenant(alerts, params))
