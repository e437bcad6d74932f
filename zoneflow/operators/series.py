"""Count series of live sources: arrivals, runs of one source, current statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoneflow.functions.risk import LEVELS
from zoneflow.operators.frames import latest_by, live_smoothed
from zoneflow.operators.ordered import SPAN, SPAN_ROWS, span_of, with_recent, with_running
from zoneflow.params import DEFAULTS, Params


def running_arrivals(
    series: DataFrame,
    keys: Sequence[str] = ("source",),
    order: Sequence[str] = ("frame_id",),
    span: int = SPAN_ROWS,
) -> DataFrame:
    """``total_count``: the sum of all increases of the count, which starts from 0.

    ``current_count`` is floored at 0.
    """
    return _arrivals(series, keys, order, span, by_source=False).drop("run_id")


def _arrivals(
    series: DataFrame, keys: Sequence[str], order: Sequence[str], span: int, by_source: bool
) -> DataFrame:
    """``run_id`` and ``total_count`` in one pass: rows are shuffled once by key and span, and what a
    span needs from the spans before it comes from a table with one row per key and span.

    Inside a span all but its first row are known. The table adds the first rows: each against the
    last row of the span before. The total of a run is the sum of all rises less what that sum was
    when the run began.
    """
    keys, order = list(keys), list(order)
    source = F.col("source") if by_source else F.lit(None)
    count = F.greatest(F.coalesce("current_count", F.lit(0)), F.lit(0)).cast("long")
    rows = series.withColumn("current_count", count).withColumn(
        SPAN, span_of(F.col(order[0]), span)
    ).repartition(*keys, SPAN)
    inside = W.partitionBy(*keys, SPAN).orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.struct(F.col("current_count").alias("n"), source.alias("source"))

    def changed(row: Column, before: Column) -> Column:
        return (~row["source"].eqNullSafe(before["source"])).cast("int")

    def rise(row: Column, before: Column) -> Column:
        level = F.when(changed(row, before) == 0, F.coalesce(before["n"], F.lit(0))).otherwise(0)
        return F.greatest(row["n"] - level, F.lit(0))

    rows = rows.withColumn("_own", own).withColumn("_before", F.lag("_own").over(inside))
    known = F.col("_before").isNotNull()
    inner = rows.withColumn(
        "_rise", F.when(known, rise(F.col("_own"), F.col("_before"))).otherwise(0)
    ).withColumn("_changed", F.when(known, changed(F.col("_own"), F.col("_before"))).otherwise(0))
    inner = inner.withColumn("_so_far", F.sum("_rise").over(so_far))
    at = F.struct(*order)
    spans = inner.groupBy(*keys, SPAN).agg(
        F.min_by("_own", at).alias("first"), F.max_by("_own", at).alias("last"),
        F.sum("_rise").alias("rises"), F.sum("_changed").alias("changes"),
        F.max(F.when(F.col("_changed") == 1, F.col("_so_far") - F.col("_rise"))).alias("began"),
    )
    by_span = W.partitionBy(*keys).orderBy(SPAN)
    earlier = by_span.rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.lag("last").over(by_span))
    spans = spans.withColumn("first_rise", rise(F.col("first"), F.col("before"))).withColumn(
        "first_changed", changed(F.col("first"), F.col("before"))
    )
    spans = spans.withColumn(
        "_rises", F.coalesce(F.sum(F.col("rises") + F.col("first_rise")).over(earlier), F.lit(0))
    ).withColumn(
        "_changes", F.coalesce(F.sum(F.col("changes") + F.col("first_changed")).over(earlier), F.lit(0))
    )
    began = F.col("_rises") + F.coalesce(
        F.col("first_rise") + F.col("began"), F.when(F.col("first_changed") == 1, 0)
    )
    carry = spans.withColumn("_level", began).select(
        *keys, SPAN, "_rises", "_changes", F.col("before").alias("_carried"),
        F.coalesce(F.last("_level", ignorenulls=True).over(earlier), F.lit(0)).alias("_level"),
    )
    joined = rows.join(carry, [*keys, SPAN], "left").withColumn(
        "_before", F.coalesce("_before", "_carried")
    )
    joined = joined.withColumn("_rise", rise(F.col("_own"), F.col("_before"))).withColumn(
        "_changed", changed(F.col("_own"), F.col("_before"))
    ).withColumn("_sum", F.col("_rises") + F.sum("_rise").over(so_far))
    start = F.max(F.when(F.col("_changed") == 1, F.col("_sum") - F.col("_rise"))).over(so_far)
    return joined.select(
        *series.columns,
        (F.col("_changes") + F.sum("_changed").over(so_far)).alias("run_id"),
        (F.col("_sum") - F.coalesce(start, F.col("_level"))).alias("total_count"),
    )


def smoothed_counts(
    series: DataFrame,
    forecast: Callable[[Column], Column],
    params: Params = DEFAULTS,
    keys: Sequence[str] = ("source",),
    order: Sequence[str] = ("frame_id",),
    span: int = SPAN_ROWS,
) -> DataFrame:
    """``smoothed_count``: the count blended with a forecast from the last counts of the source."""
    count = F.greatest(F.coalesce("current_count", F.lit(0)), F.lit(0)).cast("long")
    recent = with_recent(series, keys, order, "_recent", count, params.live_length, span)
    # The forecast looks back less far than the counts are kept.
    seen = F.slice("_recent", F.greatest(F.size("_recent") - (params.forecast_length - 1), F.lit(1)),
                   params.forecast_length)
    smoothed = live_smoothed(count, forecast(seen), F.size(seen), params)
    return recent.withColumn("smoothed_count", smoothed).drop("_recent")


def with_source_runs(
    series: DataFrame,
    keys: Sequence[str] = (),
    order: Sequence[str] = ("frame_id",),
    span: int = SPAN_ROWS,
) -> DataFrame:
    """``run_id``: number of the uninterrupted run of one source within a live service.

    ``keys`` names the service; without one all rows belong to a single service.
    """
    compared = with_running(series, keys, order, previous={"_before": F.col("source")}, span=span)
    changed = (~F.col("source").eqNullSafe(F.col("_before"))).cast("int")
    return with_running(compared, keys, order, sums={"run_id": changed}, span=span).drop("_before")


def reset_on_source_change(
    series: DataFrame,
    keys: Sequence[str] = (),
    order: Sequence[str] = ("frame_id",),
    span: int = SPAN_ROWS,
) -> DataFrame:
    """Arrivals of a service whose counters restart whenever its source changes."""
    return _arrivals(series, keys, order, span, by_source=True)


def stats_by_source(
    asked: DataFrame, series: DataFrame, service: str = "service", order: Sequence[str] = ("frame_id",)
) -> DataFrame:
    """Answer to "how is this source doing": the state of its service if it is the current source,
    zeros otherwise. A null source asks for whatever is current.

    ``series`` has current_count, total_count, smoothed_count, frame_id and updated_ms;
    ``asked`` has one row per question (service, source).
    """
    state = latest_by(series, [service], *order).select(
        service, F.col("source").alias("_source"),
        F.col("current_count").alias("_current"), F.col("total_count").alias("_total"),
        F.col("smoothed_count").alias("_smoothed"), F.col("frame_id").alias("_frame"),
        F.col("updated_ms"),
    )
    here = F.coalesce(F.trim("source") == F.col("_source"), F.lit(True))

    def answer(value: Column) -> Column:
        return F.coalesce(F.when(here, value), F.lit(0)).cast("long")

    return asked.join(state, service, "left").select(
        service, F.when(here, F.coalesce("_source", F.trim("source"))).otherwise(F.trim("source"))
        .alias("source"),
        answer(F.col("_current")).alias("current_count"),
        answer(F.col("_total")).alias("total_count"),
        answer(F.col("_current")).alias("density_count"),
        answer(F.coalesce(F.nullif(F.col("_smoothed"), F.lit(0)), F.col("_current")))
        .alias("final_count"),
        F.lit(LEVELS[0]).alias("risk"),
        F.lit(0.0).alias("movement"),
        answer(F.col("_frame")).alias("frame_id"),
        "updated_ms",
    )
