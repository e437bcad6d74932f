"""One result row per camera frame: counts, zones, crossings, movement, crowd scores and risk.

Input tables
  tracks  camera_id, frame_id, track_id, x, y, w, h, cx, cy
  frames  camera_id, frame_id, ts_ms, width, height and any columns to carry along; optionally
          ``density_count`` (a model's count, used in dense frames) and ``predicted``

``frames`` is the spine: frames without a track still count. ``keys`` names the columns that
identify a source (a job instead of a camera, or tenant and camera); they are never null.

Plan. Tracks and frames are shuffled once, together, on (source, span of frames). The last
position of a track that goes on in a later span is handed over as an extra row, so that no task
holds a whole camera. The per-frame rows are then packed per span, and from the packed spans come
both the few rows each span hands to the next and the final result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoneflow.functions import risk
from zoneflow.functions.rounding import bind, exact_round
from zoneflow.operators.alerts import frame_alerts
from zoneflow.operators.density import normalize_density
from zoneflow.operators.heatmap import with_heatmap
from zoneflow.operators.ordered import SPAN, span_of
from zoneflow.params import DEFAULTS, Params

CAMERA = ("camera_id",)
BOX = ("x", "y", "w", "h", "cx", "cy")
SPINE, TRACK, HANDED_OVER = 0, 1, 2


def _handed_over(tracks: DataFrame, keys: Sequence[str], span: int) -> DataFrame:
    """Last position of every track in a span, moved to the next span that track is seen in."""
    of_track = W.partitionBy(*keys, "track_id").orderBy(SPAN)
    return (
        tracks.groupBy(*keys, "track_id", SPAN)
        .agg(F.max_by("cx", "frame_id").alias("cx"), F.max_by("cy", "frame_id").alias("cy"))
        .withColumn(SPAN, F.lead(SPAN).over(of_track))
        .filter(F.col(SPAN).isNotNull())
        .select(*keys, "track_id", SPAN, (F.col(SPAN) * span - 1).alias("frame_id"),
                "cx", "cy", F.lit(HANDED_OVER).alias("_kind"))
    )


def _present(*columns: str) -> Column:
    """All columns are set. Said early, so that later joins need no filter of their own."""
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def _add_previous(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    of_track = W.partitionBy(*keys, SPAN, "track_id").orderBy("frame_id")
    return rows.withColumn("previous_cx", F.lag("cx").over(of_track)).withColumn(
        "previous_cy", F.lag("cy").over(of_track)
    )


def with_previous_position(
    tracks: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = CAMERA
) -> DataFrame:
    """Add the last seen centre of the same track (null where a track is first seen)."""
    span = params.frames_per_span
    seen = tracks.withColumn(SPAN, span_of(F.col("frame_id"), span))
    rows = (
        seen.withColumn("_kind", F.lit(TRACK))
        .unionByName(_handed_over(seen, keys, span), allowMissingColumns=True)
        .repartition(*keys, SPAN)
    )
    steps = _add_previous(rows, keys).filter(F.col("_kind") == TRACK)
    return steps.select(*tracks.columns, "previous_cx", "previous_cy")


def frame_counts(
    tracks: DataFrame,
    frames: DataFrame,
    params: Params = DEFAULTS,
    keys: Sequence[str] = CAMERA,
    boxes: bool = True,
) -> DataFrame:
    """Everything about a frame that needs no other frame than the last one of each track.

    Adds to the columns of ``frames``: current_count, active_track_ids, detections, zone counts,
    bbox_density, movement (mean step of its tracks), and the frame's own entries, exits and
    first-seen tracks. Without ``boxes`` the two arrays are left out. Tracks in a frame that
    ``frames`` lacks count nowhere, also not as an earlier position.
    """
    span = params.frames_per_span
    box = BOX if boxes else BOX[2:]
    known = frames.select(*keys, "frame_id")
    seen = tracks.select(*keys, "frame_id", "track_id", *box).join(
        known, [*keys, "frame_id"], "left_semi"
    ).withColumn(SPAN, span_of(F.col("frame_id"), span))
    # Earlier positions are found among the rows of tracks alone; frames, often far more, join after that.
    of_track = W.partitionBy(*keys, SPAN, "track_id").orderBy("frame_id")
    moved = _add_previous(
        seen.withColumn("_kind", F.lit(TRACK)).unionByName(
            _handed_over(seen, keys, span), allowMissingColumns=True), keys
    ).withColumn(
        "_new", F.col("track_id").isNotNull() & ~F.lag("frame_id").over(of_track).eqNullSafe(F.col("frame_id"))
    ).filter(F.col("_kind") == TRACK)
    spine = frames.select(
        *keys, "frame_id", span_of(F.col("frame_id"), span).alias(SPAN), "width", "height",
        F.struct(*frames.columns).alias("_frame"), F.lit(SPINE).alias("_kind"),
    )
    rows = (
        moved.unionByName(spine, allowMissingColumns=True)
        .filter(_present(*keys, SPAN))
        .repartition(*keys, SPAN)
    )
    of_frame = W.partitionBy(*keys, SPAN, "frame_id")
    rows = rows.withColumn("_width", F.max("width").over(of_frame)).withColumn(
        "_height", F.max("height").over(of_frame)
    )

    cx, cy, before = F.col("cx"), F.col("cy"), F.col("previous_cy")
    width, height = F.col("_width"), F.col("_height")
    line = F.greatest(F.floor(height / 2), F.lit(1))
    diagonal = F.greatest(F.sqrt(width * width + height * height), F.lit(1.0))
    dx, dy = cx - F.col("previous_cx"), cy - before
    first_third, second_third = cx < width / 3, cx < 2 * width / 3
    tracked = F.col("_kind") == TRACK
    area = F.greatest(F.col("w"), F.lit(0)).cast("long") * F.greatest(F.col("h"), F.lit(0))
    arrays = []
    if boxes:
        item = F.struct(F.col("track_id").alias("id"), F.array("x", "y", "w", "h").alias("bbox"))
        ids = F.sort_array(F.collect_set(F.when(tracked, F.col("track_id"))))
        arrays = [ids.alias("active_track_ids"),
                  F.sort_array(F.collect_list(F.when(tracked, item))).alias("detections")]

    counted = rows.groupBy(*keys, SPAN, "frame_id").agg(
        F.max(F.when(F.col("_kind") == SPINE, F.col("_frame"))).alias("_frame"),
        *arrays,
        F.count_if(F.col("_new")).alias("current_count"),
        F.count_if(first_third).alias("zone_left"),
        F.count_if(~first_third & second_third).alias("zone_center"),
        F.count_if(~second_third).alias("zone_right"),
        F.coalesce(F.sum(area), F.lit(0)).alias("bbox_area"),
        F.coalesce(F.avg(F.sqrt(dx * dx + dy * dy) / diagonal), F.lit(0.0)).alias("movement"),
        F.count_if((before < line) & (line <= cy)).alias("entries"),
        F.count_if((before > line) & (line >= cy)).alias("exits"),
        F.count_if(tracked & before.isNull()).alias("first_seen"),
    )
    pixels = F.greatest(F.col("_frame.width") * F.col("_frame.height"), F.lit(1))
    # The grouping columns stay themselves, so that Spark still knows the rows are clustered on them.
    grouped = {*keys, "frame_id"}
    return counted.filter(F.col("_frame").isNotNull()).select(
        SPAN,
        *[c if c in grouped else F.col("_frame")[c].alias(c) for c in frames.columns],
        "current_count",
        *(["active_track_ids", "detections"] if boxes else []),
        "zone_left", "zone_center", "zone_right",
        F.least(F.col("bbox_area") / pixels, F.lit(1.0)).alias("bbox_density"),
        "movement", "entries", "exits", "first_seen",
    )


def base_count(current: Column, density: Column, params: Params = DEFAULTS) -> Column:
    """The tracked count in sparse frames, the density model's count in dense ones."""
    dense = F.greatest(F.coalesce(density, current), F.lit(0)).cast("long")
    return F.when(current < params.dense_count, current).otherwise(dense)


def with_history(
    counts: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = CAMERA
) -> DataFrame:
    """Add what depends on earlier frames: totals, smoothed movement, count history, last count.

    ``counts`` is the result of ``frame_counts``.
    """
    reach = max(params.movement_history, params.count_history, 2) - 1
    density = F.col("density_count") if "density_count" in counts.columns else F.lit(None)
    base = base_count(F.col("current_count"), density.cast("long"), params)
    doc_columns = [c for c in counts.columns if c != SPAN]
    row = F.struct(
        "frame_id", F.col("current_count").alias("n"), F.col("movement").alias("move"),
        base.alias("base"), "entries", "exits", "first_seen",
        F.struct(*doc_columns).alias("doc"),
    )
    # This exchange is shared by the hand-over table and the result: all that lies below runs
    # once. (With the columns in the order of the earlier exchange Spark would leave it out.)
    sums = ("entries", "exits", "first_seen")
    packed = (
        counts.groupBy(*keys, SPAN)
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
        .repartition(SPAN, *keys)
    )
    doc_type = packed.schema["rows"].dataType.elementType["doc"].dataType

    def total(field: str) -> Column:
        return F.aggregate("rows", F.lit(0).cast("long"), lambda acc, r: acc + r[field])

    def last(rows: Column) -> Column:
        return F.slice(rows, F.greatest(F.size(rows) - (reach - 1), F.lit(1)), reach)

    handed = F.transform(last(F.col("rows")), lambda r: r.withField("doc", F.lit(None).cast(doc_type)))
    of_source = W.partitionBy(*keys).orderBy(SPAN)
    earlier = of_source.rowsBetween(W.unboundedPreceding, -1)
    per_span = packed.select(
        *keys, SPAN, handed.alias("tail"), F.size("rows").alias("_n"), *[total(c).alias(c) for c in sums]
    )
    before = per_span.select(
        *keys, SPAN, F.lag("tail").over(of_source).alias("tail"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name)
          for c, name in (("_n", "_before"), *((c, f"_{c}") for c in sums))],
    )
    # Ordered by the frames before a span, a window takes in the ends of as many spans as are needed
    # for ``reach`` frames, not of ``reach`` spans.
    near = W.partitionBy(*keys).orderBy("_before").rangeBetween(1 - reach, 0)
    carry = before.select(
        *keys, SPAN, last(F.flatten(F.collect_list("tail").over(near))).alias("handed"),
        *[f"_{c}" for c in sums],
    )
    rows = packed.join(carry, [*keys, SPAN]).select(
        *keys, SPAN, "_entries", "_exits", "_first_seen",
        F.inline(F.concat("handed", "rows")),
    )

    inside = W.partitionBy(*keys, SPAN).orderBy("frame_id")
    own = F.col("doc").isNotNull()

    def running(field: str) -> Column:
        return F.col(f"_{field}") + F.sum(F.when(own, F.col(field)).otherwise(0)).over(
            inside.rowsBetween(W.unboundedPreceding, W.currentRow)
        )

    result = rows.select(
        "doc",
        F.col("base").alias("base_count"),
        running("entries").alias("line_entry"),
        running("exits").alias("line_exit"),
        running("first_seen").alias("total_count"),
        F.avg("move").over(inside.rowsBetween(1 - params.movement_history, 0))
        .alias("smoothed_movement"),
        F.collect_list("base").over(inside.rowsBetween(1 - params.count_history, 0))
        .alias("count_history"),
        F.lag("n", 1, 0).over(inside).alias("last_count"),
    )
    return result.filter(own).select("doc.*", *result.columns[1:])


def hotspot_ratio() -> Column:
    fullest = F.greatest("zone_left", "zone_center", "zone_right")
    return F.when(F.col("current_count") > 0, fullest / F.col("current_count")).otherwise(0.0)


def mean_of_history(history: Column) -> Column:
    """A stand-in forecast for users without a model: the mean of the count history."""
    return F.aggregate(history, F.lit(0.0), lambda acc, n: acc + n) / F.size(history)


def blend_forecast(
    base: Column, prediction: Column, samples: Column, params: Params = DEFAULTS
) -> Column:
    """struct(predicted_crowd, smoothed_count, final_count) from a model's prediction.

    Without a prediction, or with too short a history, all three are the base count.
    """
    floor = F.greatest(base.cast("double"), F.lit(0.0))
    usable = prediction.isNotNull() & (samples >= params.forecast_min)
    expected = F.greatest(prediction, F.lit(0.0))
    mixed = F.greatest(
        floor * (1.0 - params.forecast_blend) + expected * params.forecast_blend, F.lit(0.0)
    )
    final = F.rint(F.when(usable, mixed).otherwise(floor)).cast("long")
    return F.struct(
        exact_round(F.when(usable, expected).otherwise(floor), 2).alias("predicted_crowd"),
        final.alias("smoothed_count"),
        final.alias("final_count"),
    )


def live_smoothed(
    current: Column, prediction: Column, samples: Column, params: Params = DEFAULTS
) -> Column:
    """Whole smoothed count of the live count service, floored at 0."""
    usable = prediction.isNotNull() & (samples >= params.forecast_min)
    predicted = bind(F.greatest(prediction, F.lit(0.0)), lambda p: exact_round(p, 2))
    blended = F.rint(current * (1.0 - params.forecast_blend) + predicted * params.forecast_blend)
    return F.when(usable, F.greatest(blended.cast("long"), F.lit(0))).otherwise(current.cast("long"))


# Names of the crowd features.
FEATURES = ("density_score", "movement_score", "congestion_score", "hotspot_ratio")


def with_scores(history: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Add the crowd features (rounded to 4 decimals), risk_score, risk and alerts.

    Each step names the values of the step before several times, so each is a column of its own: they
    are then computed once, in generated code, and only where the result is asked for. A filter on the
    result stays above the rounded features, since Spark moves none below what a row gives out (outer: it
    would else ask first whether each row gives out something, and compute all of them twice).
    """
    n, move = F.col("current_count"), F.col("smoothed_movement")
    rounded = {"density_score": "_density", "movement_score": "smoothed_movement",
               "congestion_score": "_congestion", "hotspot_ratio": "_hotspot"}
    raw = history.withColumn("_hotspot", hotspot_ratio()).withColumn(
        "_density", risk.density_score(F.col("bbox_density"), F.col("_hotspot"))
    ).withColumn("_congestion", risk.congestion_score(n, F.col("_density"), move, params))
    featured = raw.select(
        *history.columns,
        F.array(F.struct(*[exact_round(F.col(rounded[f]), 4).alias(f) for f in FEATURES])).alias("_features"),
    ).select(*history.columns, F.inline_outer("_features"))
    score = risk.risk_score(
        n, F.col("density_score"), F.col("movement_score"), F.col("congestion_score"), params)
    scored = featured.withColumn("_score", score)
    judged = scored.select(
        *history.columns, *FEATURES, exact_round(F.col("_score"), 4).alias("risk_score"),
        risk.composite_risk(F.col("_score"), n).alias("risk"),
    )
    return judged.withColumn("alerts", frame_alerts(params))


def with_results(
    history: DataFrame,
    params: Params = DEFAULTS,
    forecast: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add scores, alerts and the forecast counts to frames with their history.

    Looks at one row at a time, so it also runs on the stream of a ``camera_processor``.
    """
    flat = with_scores(history, params)
    columns = [c for c in flat.columns if c not in ("density_count", "predicted")]
    if forecast is not None:
        prediction = forecast(F.col("count_history"))
    elif "predicted" in history.columns:
        prediction = F.col("predicted").cast("double")
    else:
        prediction = F.lit(None).cast("double")
    density = F.col("density_count") if "density_count" in history.columns else F.lit(None)
    # A column of its own: the blend names the prediction several times.
    asked = flat.select(
        *columns,
        # The density model is asked in dense frames only.
        base_count(F.col("current_count"), density.cast("long"), params).alias("density_count"),
        prediction.alias("_prediction"),
    )
    blend = blend_forecast(F.col("base_count"), F.col("_prediction"), F.size("count_history"), params)
    return asked.select(*columns, "density_count", blend.alias("_blend")).select("*", "_blend.*").drop("_blend")


def frame_metrics(
    tracks: DataFrame,
    frames: DataFrame,
    params: Params = DEFAULTS,
    keys: Sequence[str] = CAMERA,
    forecast: Callable[[Column], Column] | None = None,
    boxes: bool = True,
) -> DataFrame:
    """The whole result of a frame, flat. ``result_document`` nests it.

    A forecast is read from the ``predicted`` column of ``frames``, or computed by ``forecast``
    from the array of the last base counts.
    """
    counts = frame_counts(tracks, frames, params, keys, boxes)
    history = with_history(counts, params, keys)
    return with_results(history, params, forecast)


def with_pictures(
    metrics: DataFrame, tracks: DataFrame, frames: DataFrame, params: Params = DEFAULTS,
    keys: Sequence[str] = CAMERA,
) -> DataFrame:
    """Add ``heatmap_points``, the last track centres of the camera, and ``density_map``.

    The map is that of ``frames`` (rows of cells, if there is such a column) scaled to 0..1, in dense
    frames only, as the density model is not asked in others; empty elsewhere. Points are up to
    ``heatmap_history`` to a frame, so this is kept apart from ``frame_metrics``.
    """
    at = [*keys, "frame_id"]
    pictured, empty = metrics, F.array().cast("array<array<double>>")
    if "density_map" in frames.columns:
        maps = frames.select(*at, normalize_density(F.col("density_map")).alias("density_map"))
        dense = F.col("current_count") >= params.dense_count
        pictured = metrics.join(maps, at, "left").withColumn(
            "density_map", F.when(dense, F.coalesce("density_map", empty)).otherwise(empty))
    # Points come last, so that they are never shuffled frame by frame.
    pictured = with_heatmap(pictured, tracks, frames, params, keys)
    none = F.array().cast(pictured.schema["heatmap_points"].dataType)
    pictured = pictured.withColumn("heatmap_points", F.coalesce("heatmap_points", none))
    if "density_map" not in frames.columns:
        return pictured.withColumn("density_map", empty)
    return pictured.select(*metrics.columns, "heatmap_points", "density_map")


def result_document(metrics: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``frame_metrics`` as the nested document described in ``schemas.FRAME_RESULT``, with the pictures
    of ``with_pictures`` where there are some."""
    pictures = [c for c in ("heatmap_points", "density_map") if c in metrics.columns]
    return metrics.select(
        *keep, "frame_id", "current_count", "total_count", "density_count", "base_count",
        "predicted_crowd", "smoothed_count", "final_count", "active_track_ids", "detections",
        F.struct(F.col("zone_left").alias("left"), F.col("zone_center").alias("center"),
                 F.col("zone_right").alias("right")).alias("zone_counts"),
        F.struct(F.col("line_entry").alias("entry"), F.col("line_exit").alias("exit"))
        .alias("line_crossing"),
        F.struct("density_score", "movement_score", "congestion_score", "hotspot_ratio")
        .alias("crowd_features"),
        "risk", "risk_score", "alerts", *pictures,
    )


def latest_by(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of every key; partial aggregation keeps one row per key and task."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select("_row.*")


def latest_per_camera(metrics: DataFrame, keys: Sequence[str] = CAMERA) -> DataFrame:
    return latest_by(metrics, keys, "frame_id")


def latest_metrics(
    tracks: DataFrame, frames: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = CAMERA,
    forecast: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The last result of every camera: ``latest_per_camera`` of ``frame_metrics`` without the boxes.

    Nothing is built for frames before the last few: a span gives its sums, its last frame and the
    numbers of its last few, and a camera puts the last of its spans together.
    """
    counts = frame_counts(tracks, frames, params, keys, boxes=False)
    reach = max(params.movement_history, params.count_history, 2)
    density = F.col("density_count") if "density_count" in counts.columns else F.lit(None)
    base = base_count(F.col("current_count"), density.cast("long"), params)
    said = F.struct("frame_id", F.col("current_count").alias("n"), F.col("movement").alias("move"), base.alias("base"))
    sums = ("entries", "exits", "first_seen")

    def last(rows: Column, n: int) -> Column:
        return F.slice(rows, F.greatest(F.size(rows) - (n - 1), F.lit(1)), n)

    spans = counts.groupBy(*keys, SPAN).agg(
        last(F.sort_array(F.collect_list(said)), reach).alias("rows"),
        F.max_by(F.struct(*[c for c in counts.columns if c != SPAN]), "frame_id").alias("doc"),
        *[F.sum(c).alias(f"_{c}") for c in sums],
    )
    # Every span has a frame, so as many spans hold the last frames.
    newest = W.partitionBy(*keys).orderBy(F.desc(SPAN))
    whole = W.partitionBy(*keys)
    near = spans.select(
        *keys, SPAN, "rows", "doc", F.row_number().over(newest).alias("_nth"),
        *[F.sum(f"_{c}").over(whole).alias(f"_{c}") for c in sums],
    ).filter(F.col("_nth") <= reach)
    ends = near.groupBy(*keys).agg(
        last(F.sort_array(F.flatten(F.collect_list("rows"))), reach).alias("rows"),
        F.max_by("doc", SPAN).alias("doc"), *[F.first(f"_{c}").alias(f"_{c}") for c in sums],
    )
    moves = last(F.col("rows.move"), params.movement_history)
    history = ends.select(
        "doc.*", F.element_at("rows", -1)["base"].alias("base_count"),
        F.col("_entries").alias("line_entry"), F.col("_exits").alias("line_exit"),
        F.col("_first_seen").alias("total_count"),
        (F.aggregate(moves, F.lit(0.0), lambda total, m: total + m) / F.size(moves)).alias("smoothed_movement"),
        last(F.col("rows.base"), params.count_history).alias("count_history"),
        F.coalesce(F.try_element_at("rows", F.lit(-2))["n"], F.lit(0).cast("long")).alias("last_count"),
    )
    return with_results(history, params, forecast)


def last_result(
    metrics: DataFrame, sources: DataFrame, keys: Sequence[str] = ("job_id",)
) -> DataFrame:
    """Last frame result per source; sources without a frame get the all-zero result."""
    return empty_metrics(sources.join(latest_by(metrics, keys, "frame_id"), list(keys), "left"))


# Result fields of a source without frames.
ZERO_FIELDS = (
    "current_count", "total_count", "density_count", "base_count", "smoothed_count", "final_count",
    "zone_left", "zone_center", "zone_right", "line_entry", "line_exit", "predicted_crowd",
    "density_score", "movement_score", "congestion_score", "hotspot_ratio", "risk_score",
)
ARRAY_FIELDS = ("active_track_ids", "detections", "heatmap_points", "alerts", "count_history")


def empty_metrics(df: DataFrame) -> DataFrame:
    """Fill null result fields with those of the empty frame result."""
    fills = {}
    for field in df.schema:
        if field.name in ZERO_FIELDS:
            fills[field.name] = F.coalesce(field.name, F.lit(0).cast(field.dataType))
        elif field.name in ARRAY_FIELDS:
            fills[field.name] = F.coalesce(field.name, F.array().cast(field.dataType))
        elif field.name == "risk":
            fills["risk"] = F.coalesce("risk", F.lit("Low"))
    return df.withColumns(fills) if fills else df
