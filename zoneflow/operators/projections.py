"""Row-wise rules on cameras, predictions and upload manifests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.functions.risk import LEVELS, risk_by_count
from zoneflow.functions.text import camera_source_type
from zoneflow.functions.values import filled, finite, live_count, normalized_count
from zoneflow.params import DEFAULTS, Params

# Numeric fields of a camera's metrics, and those a reset sets to zero.
NUMBERS = (
    "current_count", "count", "people_count", "total_count", "density_count", "base_count",
    "predicted_crowd", "smoothed_count", "final_count", "risk_score",
)
RESET_NUMBERS = ("count", "current_count", "total_count", "people_count", "risk_score")
ZONES = ("zone_left", "zone_center", "zone_right")
LINES = ("line_entry", "line_exit")
FEATURES = ("density_score", "movement_score", "congestion_score", "hotspot_ratio")
ARRAYS = ("active_track_ids", "detections", "heatmap_points", "alerts")
VIDEO_TYPES = ("video/mp4", "video/quicktime", "video/x-matroska", "video/webm")


def for_tenant(df: DataFrame, user_id) -> DataFrame:
    """Rows of one tenant; prunes folders where the table is stored by ``user_id``."""
    return df.filter(F.col("user_id") == F.lit(user_id))


def lookup(df: DataFrame, key: str, value, user_id=None) -> DataFrame:
    """The row with the given key, if it belongs to the tenant."""
    found = df.filter(F.col(key) == F.lit(value))
    return (found if user_id is None else for_tenant(found, user_id)).limit(1)


def _fields(df: DataFrame) -> Mapping[str, Column]:
    """Columns by name; null for a field the table does not have."""
    present = set(df.columns)

    class Fields(dict):
        def __missing__(self, name: str) -> Column:
            return F.col(name) if name in present else F.lit(None).cast("double")

    return Fields()


def _zeroed(df: DataFrame, names) -> dict[str, Column]:
    types = {f.name: f.dataType for f in df.schema}
    out = {}
    for name in names:
        if name in types:
            empty = F.array() if name in ARRAYS else F.lit(0)
            out[name] = empty.cast(types[name])
    return out


def validate_cameras(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new cameras, rejected requests). A camera needs a name, a zone and a stream address."""
    required = ("name", "zone_name", "stream_url")
    given = [F.coalesce(F.col(c), F.lit("")) != "" for c in required]
    complete = given[0] & given[1] & given[2]
    location = F.col("location") if "location" in requests.columns else F.lit(None).cast("string")
    others = [c for c in requests.columns if c != "location"]
    valid = requests.filter(complete).select(
        *others,
        filled(location, F.lit("Unknown")).alias("location"),
        camera_source_type(F.col("stream_url")).alias("source_type"),
        F.lit("stopped").alias("status"),
        *[F.lit(0).cast("long").alias(c)
          for c in ("count", "current_count", "total_count", "people_count", *ZONES, *LINES)],
        *[F.lit(0.0).alias(c) for c in FEATURES],
        F.lit("Low").alias("risk"),
    )
    missing = F.array_compact(F.array(*[F.when(~ok, c) for ok, c in zip(given, required)]))
    rejected = requests.filter(~complete).select(
        "*", F.concat_ws(",", missing).alias("missing")
    )
    return valid, rejected


def with_live_count(df: DataFrame, name: str = "live_count") -> DataFrame:
    return df.withColumn(name, live_count(_fields(df)))


def normalize_predictions(df: DataFrame) -> DataFrame:
    """Every field of an incoming prediction, with the default where it is missing.

    The three count aliases become one number; a missing risk follows from the count.
    """
    fields = _fields(df)
    count = normalized_count(fields)
    present = set(df.columns)
    aliases = ("current_count", "people_count", "count")
    numbers = [c for c in NUMBERS if c not in aliases]
    defaulted = {c: F.coalesce(finite(fields[c]), F.lit(0.0)) for c in numbers}
    defaulted |= {c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
                  for c in ARRAYS if c in present}
    defaulted |= {c: F.coalesce(F.col(c), F.lit(0)) for c in (*ZONES, *LINES, *FEATURES)
                  if c in present}
    risk = F.col("risk") if "risk" in present else F.lit(None).cast("string")
    rest = [c for c in df.columns if c not in defaulted and c not in (*aliases, "risk")]
    return df.withColumn("_count", count).select(
        *rest,
        *[F.col("_count").alias(c) for c in aliases],
        *[c.alias(n) for n, c in defaulted.items()],
        filled(risk, risk_by_count(F.col("_count"))).alias("risk"),
    )


def merge_metrics(previous: DataFrame, new: DataFrame, key: str = "camera_id") -> DataFrame:
    """The new prediction of a camera over its previous metrics, field by field.

    ``new`` has at most one row per camera. A camera without one keeps its metrics. A total that
    is not a finite number keeps the previous total; a missing risk becomes Low.
    """
    joined = previous.alias("p").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "left")
    fields = {c: F.col(f"n.{c}") if c in new.columns else F.lit(None).cast(kind)
              for c, kind in (("current_count", "long"), ("count", "long"), ("people_count", "long"),
                              ("total_count", "double"), ("risk", "string"))}
    arrived = F.col("n._new").isNotNull()
    count = live_count({c: fields[c] for c in ("current_count", "count", "people_count")})
    out = []
    for name in dict.fromkeys([*previous.columns, *new.columns]):
        if name == key:
            out.append(F.col(key))
            continue
        old = F.col(f"p.{name}") if name in previous.columns else F.lit(None)
        if name in ("count", "current_count"):
            fresh = count
        elif name == "total_count":
            fresh = F.coalesce(finite(fields["total_count"]), old, F.lit(0))
        elif name == "risk":
            fresh = filled(fields["risk"], F.lit(LEVELS[0]))
        elif name not in new.columns:
            fresh = old
        else:
            fresh = F.coalesce(F.col(f"n.{name}"), old)
        out.append(F.when(arrived, fresh).otherwise(old).alias(name))
    return joined.select(*out)


# Fields a live service reports, with what stands in when nobody reports one.
LIVE_FIELDS = {
    "current_count": 0, "total_count": 0, "density_count": 0, "final_count": 0,
    "risk": "Low", "frame_id": None,
}


def merge_live_stats(cameras: DataFrame, live: DataFrame) -> DataFrame:
    """Live statistics over stored camera metrics, matched by stream address.

    ``live`` has one row per ``source``. ``count`` follows the live current count.
    """
    joined = cameras.alias("c").join(
        live.alias("l"), F.col("c.stream_url") == F.col("l.source"), "left"
    )
    merged = {
        name: F.coalesce(F.col(f"l.{name}"), F.col(f"c.{name}"), F.lit(default))
        for name, default in LIVE_FIELDS.items()
    }
    merged["count"] = F.coalesce(F.col("l.current_count"), F.col("c.count"), F.lit(0))
    times = [c for c in ("updated_ms", "last_frame_ms", "last_started_ms") if c in cameras.columns]
    merged["updated_ms"] = F.coalesce(F.col("l.updated_ms"), *[F.col(f"c.{c}") for c in times])
    others = [F.col(f"c.{c}") for c in cameras.columns if c not in merged]
    return joined.select(*others, *[c.alias(n) for n, c in merged.items()])


def reset_metrics(df: DataFrame) -> DataFrame:
    """Zero the live fields and keep all others (as at start and stop of a camera)."""
    names = (*RESET_NUMBERS, *ZONES, *LINES, *FEATURES, *ARRAYS)
    return df.withColumns({
        **_zeroed(df, names), "risk": F.lit(LEVELS[0]), "processing_status": F.lit("idle"),
    })


def mark_stale(
    df: DataFrame, as_of_ms: Column, params: Params = DEFAULTS, time: str = "processed_ms"
) -> DataFrame:
    """Zero results older than the limit; totals, line crossings and frame number stay.

    A result without a time is not stale.
    """
    stale = F.coalesce(as_of_ms - F.col(time) > params.stale_after_ms, F.lit(False))
    kept = ("total_count", *LINES)
    names = [c for c in (*NUMBERS, *ZONES, *FEATURES, *ARRAYS) if c not in kept]
    zeroed = {n: F.when(stale, zero).otherwise(F.col(n)) for n, zero in _zeroed(df, names).items()}
    status = F.col("processing_status") if "processing_status" in df.columns else F.lit(None)
    zeroed["processing_status"] = F.when(stale, "stale").otherwise(status.cast("string"))
    if "risk" in df.columns:
        zeroed["risk"] = F.when(stale, LEVELS[0]).otherwise(F.col("risk"))
    return df.withColumn("_stale", stale).withColumns(zeroed).drop("_stale")


def drop_unfresh(
    df: DataFrame, as_of_ms: Column, params: Params = DEFAULTS, time: str = "updated_ms"
) -> DataFrame:
    """Replace results older than the freshness limit by the warming-up defaults.

    Totals are reset too. A result without a time counts as fresh.
    """
    old = F.coalesce(as_of_ms - F.col(time) > params.fresh_ms, F.lit(False))
    names = (*NUMBERS, *ZONES, *LINES, *FEATURES, *ARRAYS)
    changes = {n: F.when(old, zero).otherwise(F.col(n)) for n, zero in _zeroed(df, names).items()}
    if "risk" in df.columns:
        changes["risk"] = F.when(old, LEVELS[0]).otherwise(F.col("risk"))
    changes["processing_status"] = F.when(old, "warming_up").otherwise("live")
    return df.withColumns(changes)


def stream_status(
    as_of_ms: Column, params: Params = DEFAULTS, row=F.col
) -> Column:
    """idle / reconnecting / live / connecting, from status, errored, loaded and three times."""
    seen = F.coalesce(row("updated_ms"), row("last_frame_ms"), row("last_started_ms"))
    return (
        F.when(~row("status").eqNullSafe(F.lit("running")), "idle")
        .when(row("errored") | (as_of_ms - seen > params.fresh_ms), "reconnecting")
        .when(row("loaded"), "live")
        .otherwise("connecting")
    )


def display_metrics(df: DataFrame) -> DataFrame:
    """Add what the panel shows: fallbacks between the counts and the width of the bar."""
    f = _fields(df)
    current = F.coalesce(f["current_count"], f["count"], f["people_count"], F.lit(0))
    shown = {
        "shown_current": current,
        "shown_total": F.coalesce(f["total_count"], current),
        "shown_density": F.coalesce(f["density_count"], current),
        "shown_final": F.coalesce(f["final_count"], f["smoothed_count"], current),
        "shown_risk": filled(
            F.col("risk") if "risk" in df.columns else F.lit(None).cast("string"), F.lit(LEVELS[0])
        ),
        "bar_percent": F.least(
            F.lit(100.0),
            F.greatest(F.lit(6.0), F.coalesce(f["congestion_score"], F.lit(0.0)) * 100.0),
        ),
    }
    return df.withColumns(shown)


def valid_uploads(
    manifest: DataFrame, params: Params = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): video files of at most 250 MiB."""
    reason = F.when(
        ~F.coalesce(F.col("mime").isin(*VIDEO_TYPES), F.lit(False)),
        "not a video",
    ).when(F.col("size_bytes") > params.max_upload_bytes, "larger than allowed")
    judged = manifest.withColumn("reason", reason)
    return (
        judged.filter(F.col("reason").isNull()).drop("reason"),
        judged.filter(F.col("reason").isNotNull()),
    )
