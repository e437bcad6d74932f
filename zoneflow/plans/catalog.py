"""The registered queries: every operator over the derived tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.functions import risk, text
from zoneflow.functions.geometry import CORNERS, box_geometry
from zoneflow.functions.rounding import exact_round
from zoneflow.functions.values import live_count, normalized_count
from zoneflow.operators import alerts as al
from zoneflow.operators import dashboard as dash
from zoneflow.operators import density, detections, frames, heatmap, matching, projections
from zoneflow.operators import series, tables, tracking
from zoneflow.params import Params
from zoneflow.plans.derived import Derived
from zoneflow.plans.oracle import NMS_SQL, rounded, with_steps

Query = Callable[[Derived], DataFrame]

# Short spans, so that the hand-over between spans is part of every check.
SHORT = Params(frames_per_span=16)
LONG = Params(frames_per_span=64)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = with_steps(sql)
        return function

    return register


def _counts(d: Derived) -> DataFrame:
    return frames.frame_counts(d.tracks(), d.frames(), SHORT)


def _history(d: Derived) -> DataFrame:
    return frames.with_history(
        frames.frame_counts(d.tracks(), d.frames(), SHORT, boxes=False), SHORT
    )


def _metrics(d: Derived) -> DataFrame:
    return frames.frame_metrics(d.tracks(), d.frames(), SHORT, boxes=False)


def _current_cameras(d: Derived) -> DataFrame:
    latest = frames.latest_metrics(d.tracks(), d.frames(), SHORT).select(
        "camera_id", "frame_id", "current_count", "total_count", "congestion_score", "risk_score",
        "risk",
    )
    return tables.cameras_with_metrics(d.cameras(), latest)


LATEST_SQL = """(select c.*, coalesce(m.n, 0) current_count, coalesce(m.total_count, 0) total_count,
    coalesce(m.congestion_score, 0.0e0) congestion_score, coalesce(m.risk_score, 0.0e0) risk_score,
    coalesce(m.risk, 'Low') risk, m.frame_id
  from cameras c left join (select * from metrics
    qualify row_number() over (partition by camera_id order by frame_id desc) = 1) m
  on m.camera_id = c.camera_id)"""


# ---- frame level -------------------------------------------------------------------------


@query("select camera_id, frame_id, n as current_count from counted")
def people_count(d):
    return _counts(d).select("camera_id", "frame_id", "current_count")


@query("""select f.camera_id, f.frame_id,
      coalesce(string_agg(cast(t.track_id as varchar), ',' order by t.track_id), '') ids
    from frames f left join tracks t on t.camera_id = f.camera_id and t.frame_id = f.frame_id
    group by 1, 2""")
def active_track_ids(d):
    ids = F.array_join(F.col("active_track_ids").cast("array<string>"), ",")
    return _counts(d).select("camera_id", "frame_id", ids.alias("ids"))


@query("select camera_id, frame_id, zl zone_left, zc zone_center, zr zone_right from counted")
def zone_counts(d):
    return _counts(d).select("camera_id", "frame_id", "zone_left", "zone_center", "zone_right")


@query("select camera_id, frame_id, bbox bbox_density from counted")
def bbox_density(d):
    return _counts(d).select("camera_id", "frame_id", "bbox_density")


@query(f"""select camera_id, frame_id, {rounded('hotspot', 6)} hotspot_ratio,
      {rounded('density', 6)} density_score from featured""")
def hotspot_density_score(d):
    score = risk.density_score(F.col("bbox_density"), frames.hotspot_ratio())
    return _counts(d).select(
        "camera_id", "frame_id", exact_round(frames.hotspot_ratio(), 6).alias("hotspot_ratio"),
        exact_round(score, 6).alias("density_score"),
    )


@query(f"select camera_id, frame_id, {rounded('movement', 6)} movement from counted")
def movement_raw(d):
    return _counts(d).select(
        "camera_id", "frame_id", exact_round(F.col("movement"), 6).alias("movement")
    )


@query("""select t.camera_id, t.frame_id, track_id id, x, y, w, h from tracks t
    join frames f on t.camera_id = f.camera_id and t.frame_id = f.frame_id""")
def detections_array(d):
    box = F.col("t.bbox")
    return _counts(d).select("camera_id", "frame_id", F.explode("detections").alias("t")).select(
        "camera_id", "frame_id", "t.id", *[box[i].alias(c) for i, c in enumerate("xywh")]
    )


@query("""select camera_id, frame_id, track_id, lag(cx) over w previous_cx,
      lag(cy) over w previous_cy
    from tracks window w as (partition by camera_id, track_id order by frame_id)""")
def previous_position(d):
    return frames.with_previous_position(d.tracks(), SHORT).select(
        "camera_id", "frame_id", "track_id", "previous_cx", "previous_cy"
    )


@query(f"select camera_id, frame_id, {rounded('smoothed', 6)} smoothed_movement from history")
def smoothed_movement(d):
    return _history(d).select(
        "camera_id", "frame_id", exact_round(F.col("smoothed_movement"), 6).alias("smoothed_movement")
    )


@query("select camera_id, frame_id, line_entry, line_exit from history")
def line_crossing(d):
    return _history(d).select("camera_id", "frame_id", "line_entry", "line_exit")


@query("select camera_id, frame_id, total_count from history")
def total_count(d):
    return _history(d).select("camera_id", "frame_id", "total_count")


@query("select camera_id, frame_id, array_to_string(recent, ',') recent from history")
def count_history(d):
    recent = F.array_join(F.col("count_history").cast("array<string>"), ",")
    return _history(d).select("camera_id", "frame_id", recent.alias("recent"))


@query("select camera_id, frame_id, n - last_count delta from history")
def count_delta(d):
    delta = F.col("current_count") - F.col("last_count")
    return _history(d).select("camera_id", "frame_id", delta.alias("delta"))


@query("""select u.camera_id, u.frame_id, cast(count(p.pn) as bigint) points,
      coalesce(string_agg(p.cx || ':' || p.cy, ' ' order by p.pn), '') path
    from (select camera_id, frame_id, sum(n) over (partition by camera_id order by frame_id
        rows between unbounded preceding and current row) upto from counted) u
    left join (select camera_id, cx, cy, row_number() over (partition by camera_id
        order by frame_id, track_id) pn from tracks) p
      on p.camera_id = u.camera_id and p.pn <= u.upto and p.pn > u.upto - 250
    group by 1, 2""")
def heatmap_history(d):
    points = F.col("heatmap_points")
    text = F.transform(points, lambda p: F.concat_ws(":", p["x"], p["y"]))
    return heatmap.heatmap_history(d.tracks(), d.frames(), SHORT).select(
        "camera_id", "frame_id", F.size(points).cast("long").alias("points"),
        F.array_join(text, " ").alias("path"),
    )


@query("""select u.camera_id, u.frame_id, u.n, cast(least(u.upto, 250) as bigint) points,
      cast(case when u.n >= 15 then 2 else 0 end as bigint) map_rows,
      case when u.n >= 15 and u.frame_id % 5 > 0 then 1.0e0 else 0.0e0 end top
    from (select camera_id, frame_id, n, sum(n) over (partition by camera_id order by frame_id
        rows between unbounded preceding and current row) upto from counted) u""")
def frame_pictures(d):
    """Frame results with their points and, in dense frames, the scaled map."""
    number = F.col("frame_id") % 5
    maps = F.array(F.array(F.lit(-1.0), number.cast("double")), F.array(F.lit(0.0), F.lit(0.0)))
    spine = d.frames().withColumn("density_map", maps)
    metrics = frames.frame_metrics(d.tracks(), spine.drop("density_map"), SHORT, boxes=False)
    document = frames.result_document(
        frames.with_pictures(metrics, d.tracks(), spine, SHORT).withColumns({
            c: F.lit(None) for c in ("active_track_ids", "detections")}), keep=["camera_id"])
    cells = F.flatten("density_map")
    return document.select(
        "camera_id", "frame_id", F.col("current_count").cast("long").alias("n"),
        F.size("heatmap_points").cast("long").alias("points"), F.size("density_map").cast("long").alias("map_rows"),
        F.coalesce(F.array_max(cells), F.lit(0.0)).alias("top"))


LAST_POINTS_SQL = """(select camera_id, cx x, cy y, row_number() over (partition by camera_id
      order by frame_id, track_id) as position from
    (select * from tracks qualify row_number() over (partition by camera_id
      order by frame_id desc, track_id desc) <= 250))"""


@query(f"select * from {LAST_POINTS_SQL}")
def latest_heatmap(d):
    return heatmap.latest_heatmap(d.tracks()).select(
        "camera_id", F.col("x"), F.col("y"), F.col("position").cast("long").alias("position")
    )


@query(f"""select camera_id, k - 1 as position, x, y, {rounded('k / cast(n as double)', 9)} recency
    from (select *, row_number() over (partition by camera_id order by position) k,
        count(*) over (partition by camera_id) n
      from (select * from {LAST_POINTS_SQL}
        qualify row_number() over (partition by camera_id order by position desc) <= 220))""")
def heat_recency(d):
    latest = frames.latest_by(
        heatmap.heatmap_history(d.tracks(), d.frames(), SHORT), ["camera_id"], "frame_id"
    )
    return heatmap.heat_recency(latest).select(
        "camera_id", F.col("position").cast("long").alias("position"), "x", "y",
        exact_round(F.col("recency"), 9).alias("recency"),
    )


@query("""select camera_id, frame_id, base_count, base_count density_count from (
      select *, case when n < 15 then n
      else greatest(case when frame_id % 4 <> 0 then (frame_id * 7) % 60 else n end, 0) end
      base_count from counted)""")
def base_count(d):
    model = F.when(F.col("frame_id") % 4 != 0, (F.col("frame_id") * 7) % 60)
    spine = d.frames().withColumn("density_count", model)
    return frames.frame_metrics(d.tracks(), spine, SHORT).select(
        "camera_id", "frame_id", "base_count", "density_count"
    )


@query("""select camera_id, frame_id, density_score, movement_score, congestion_score,
      hotspot_ratio from metrics""")
def crowd_features(d):
    return _metrics(d).select("camera_id", "frame_id", *projections.FEATURES)


@query("select camera_id, frame_id, risk_score from metrics")
def risk_score(d):
    return _metrics(d).select("camera_id", "frame_id", "risk_score")


@query("select camera_id, frame_id, risk from metrics")
def composite_risk(d):
    return _metrics(d).select("camera_id", "frame_id", "risk")


FLAT = ("camera_id", "frame_id", "current_count", "zone_left", "zone_center", "zone_right",
        "line_entry", "line_exit", "total_count", "last_count", "density_score", "movement_score",
        "congestion_score", "hotspot_ratio", "risk_score", "risk")


@query("""select camera_id, frame_id, n current_count, zl zone_left, zc zone_center,
      zr zone_right, line_entry, line_exit, total_count, last_count, density_score, movement_score,
      congestion_score, hotspot_ratio, risk_score, risk from metrics_big""")
def frame_metrics_flat(d):
    return frames.frame_metrics(d.tracks_big(), d.frames_big(), LONG, boxes=False).select(*FLAT)


@query(f"""select camera_id, frame_id, {rounded('predicted', 2)} predicted_crowd,
      cast(round_even(final, 0) as bigint) final_count
    from (select camera_id, frame_id, case when len(recent) >= 5 then mean else n end predicted,
        case when len(recent) >= 5 then n * 0.7e0 + mean * 0.3e0 else n end final
      from (select *, list_sum(recent) / cast(len(recent) as double) mean from history))""")
def blend_forecast(d):
    return frames.frame_metrics(
        d.tracks(), d.frames(), SHORT, forecast=frames.mean_of_history
    ).select("camera_id", "frame_id", "predicted_crowd", "final_count")


@query(f"""select source, frame_id, case when k >= 5 then
        greatest(cast(round_even(n * 0.7e0 + {rounded('mean', 2)} * 0.3e0, 0) as bigint), 0)
        else n end smoothed_count
    from (select source, frame_id, greatest(current_count, 0) n,
        row_number() over (partition by source order by frame_id) k,
        avg(greatest(current_count, 0)) over (partition by source order by frame_id
          rows between 7 preceding and current row) mean from count_series)""")
def live_smoothed(d):
    return series.smoothed_counts(d.count_series(), frames.mean_of_history, span=1000).select(
        "source", "frame_id", "smoothed_count"
    )


@query("""select camera_id, frame_id, n current_count, total_count, risk from metrics
    qualify row_number() over (partition by camera_id order by frame_id desc) = 1""")
def latest_per_camera(d):
    return frames.latest_per_camera(_metrics(d)).select(
        "camera_id", "frame_id", "current_count", "total_count", "risk"
    )


@query("""select j.camera_id, coalesce(m.n, 0) current_count, coalesce(m.total_count, 0) total_count,
      coalesce(m.risk_score, 0.0e0) risk_score, coalesce(m.risk, 'Low') risk
    from cameras j left join (select * from metrics qualify row_number() over
      (partition by camera_id order by frame_id desc) = 1) m on m.camera_id = j.camera_id""")
def last_result(d):
    results = _metrics(d).select(
        "camera_id", "frame_id", "current_count", "total_count", "risk_score", "risk"
    )
    jobs = d.cameras().select("camera_id")
    return frames.last_result(results, jobs, ["camera_id"]).drop("frame_id")


# ---- density -----------------------------------------------------------------------------


@query("""select map_id, cast(round_even(sum(v), 0) as bigint) density_count from cells
    group by map_id""")
def density_count(d):
    return d.density_maps().select(
        "map_id", density.density_count(F.col("density_map")).alias("density_count")
    )


@query("""select m.map_id, cast(case when m.map_id % 3 = 0 then greatest(round_even((m.map_id % 40 - 5) / 2.0e0, 0), 0)
      when m.map_id % 3 = 1 then m.map_id % 50 else round_even(s, 0) end as bigint) people
    from (select map_id, sum(v) s from cells group by 1) m""")
def model_count(d):
    """The model's count, else its current count, else the sum of its map."""
    key = F.col("map_id")
    people = density.model_count(
        F.col("density_map"), F.when(key % 3 == 0, (key % 40 - 5) / 2), F.when(key % 3 < 2, key % 50))
    return d.density_maps().select("map_id", people.alias("people"))


@query(f"""select map_id, gy, cast(gx as bigint) gx, case when hi > lo
        then {rounded('(v - lo) / (hi - lo)', 4)} else 0.0e0 end v
    from (select *, min(v) over (partition by map_id) lo, max(v) over (partition by map_id) hi
      from cells)""")
def normalize_density(d):
    scaled = density.normalize_density(F.col("density_map"))
    rows = d.density_maps().select("map_id", F.posexplode(scaled).alias("gy", "row"))
    return rows.select(
        "map_id", F.col("gy").cast("long").alias("gy"), F.posexplode("row").alias("gx", "v")
    ).select("map_id", "gy", F.col("gx").cast("long").alias("gx"), "v")


@query(f"""select camera_id, gx, gy, visits, case when hi > lo
        then {rounded('(visits - lo) / cast(hi - lo as double)', 4)} else 0.0e0 end heat
    from (select *, case when count(*) over w = 3072 then min(visits) over w else 0 end lo,
        max(visits) over w hi
      from (select camera_id, cast(least(greatest(cx * 64 // 1280, 0), 63) as int) gx,
          cast(least(greatest(cy * 48 // 720, 0), 47) as int) gy, count(*) visits
        from tracks_big group by 1, 2, 3) window w as (partition by camera_id))""")
def heat_grid(d):
    return density.heat_grid(d.tracks_big(), F.lit(1280), F.lit(720))


# ---- detections and matching -------------------------------------------------------------


@query("select camera_id, frame_id, det_idx, confidence from persons")
def filter_detections(d):
    return detections.filter_detections(d.detections()).select(
        "camera_id", "frame_id", "det_idx", "confidence"
    )


@query(NMS_SQL)
def nms(d):
    return detections.nms(detections.filter_detections(d.detections())).select(
        "camera_id", "frame_id", "det_idx"
    )


@query(NMS_SQL)
def nms_frames(d):
    rows = detections.nms_frames(detections.frame_rows(d.detections().drop("who")))
    return rows.select("camera_id", "frame_id", F.explode("detections.det_idx").alias("det_idx"))


@query("""select camera_id, frame_id, det_idx, cast(l as int) x, cast(t as int) y,
      cast(r - l as int) w, cast(b - t as int) h,
      cast((l + r) // 2 as int) cx, cast((t + b) // 2 as int) cy
    from (select *, greatest(cast(round_even(x2 * 1.37e0 - 0.25e0, 0) as bigint), l) r,
        greatest(cast(round_even(y2 * 1.37e0 - 0.25e0, 0) as bigint), t) b
      from (select *, greatest(cast(round_even(x1 * 1.37e0 - 50.5e0, 0) as bigint), 0) l,
          greatest(cast(round_even(y1 * 1.37e0 - 50.5e0, 0) as bigint), 0) t from detections))""",
       name="box_geometry")
def box_geometry_query(d):
    corners = [F.col(c) * 1.37 - (50.5 if c in ("x1", "y1") else 0.25) for c in CORNERS]
    return d.detections().select(
        "camera_id", "frame_id", "det_idx", box_geometry(*corners).alias("_b")
    ).select("camera_id", "frame_id", "det_idx", "_b.*")


CANDIDATES_SQL = f"""
    (select a.camera_id, a.frame_id + 1 frame_id, a.det_idx track_idx, b.det_idx,
      greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)
        * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)
      / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
        - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)
        * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) iou
    from persons a join persons b on b.camera_id = a.camera_id and b.frame_id = a.frame_id + 1)"""


def _candidates(d: Derived) -> DataFrame:
    persons = detections.filter_detections(d.detections())
    before = persons.withColumn("frame_id", F.col("frame_id") + 1).withColumnRenamed(
        "det_idx", "track_idx"
    )
    return matching.iou_candidates(before, persons)


@query(f"""select camera_id, frame_id, track_idx, det_idx, {rounded('iou', 9)} iou
    from {CANDIDATES_SQL} where iou >= 0.3e0""")
def iou_candidates(d):
    return _candidates(d).withColumn("iou", exact_round(F.col("iou"), 9))


@query(f"""with recursive ranked as (
      select *, row_number() over (partition by camera_id, frame_id
        order by iou desc, track_idx, det_idx) rn from {CANDIDATES_SQL} where iou >= 0.3e0),
    walk as (
      select camera_id, frame_id, track_idx, det_idx, rn, true ok, [track_idx] ts, [det_idx] ds
      from ranked where rn = 1
      union all
      select camera_id, frame_id, track_idx, det_idx, rn, free,
        case when free then list_append(ts, track_idx) else ts end,
        case when free then list_append(ds, det_idx) else ds end
      from (select b.*, w.ts, w.ds, not list_contains(w.ts, b.track_idx)
          and not list_contains(w.ds, b.det_idx) free
        from walk w join ranked b on b.camera_id = w.camera_id and b.frame_id = w.frame_id
          and b.rn = w.rn + 1))
    select camera_id, frame_id, track_idx, det_idx from walk where ok""")
def greedy_match(d):
    return matching.greedy_match(_candidates(d)).drop("iou")


@query("""select camera_id, frame_id, p // 4 sample_id from (select *, row_number() over
      (partition by camera_id order by frame_id) p from frames_big) where p % 4 = 0""")
def sample_every(d):
    return detections.sample_every(d.frames_big(), span=50).select(
        "camera_id", "frame_id", "sample_id"
    )


@query("""with recursive keyed as (
      select *, camera_id || '/' || "type" || ':' || message || ':' || risk || '#' || sum(case
        when "type" = 'click' then 1 else 0 end) over (partition by camera_id order by created_ms) k
      from alert_log),
    walk as (
      select k, min(created_ms) t from keyed group by k
      union all
      select w.k, (select min(a.created_ms) from keyed a where a.k = w.k
        and a.created_ms >= w.t + 15000) t
      from walk w where w.t is not null)
    select a.alert_id from keyed a join walk w on w.k = a.k and w.t = a.created_ms""")
def suppress_with_resets(d):
    """Each click of the log stands for a stop of its camera."""
    log = d.alert_log()
    stops = log.filter(F.col("type") == "click").select("camera_id", "created_ms")
    return al.suppress_repeats(log, span_ms=400_000, resets=stops).select("alert_id")


@query("""with recursive ordered as (
      select user_id % 25 camera_id, event_id, row_number() over (partition by user_id % 25
        order by event_id) rn from events),
    walk as (
      select camera_id, event_id, rn, cast(null as bigint) last, cast(1 as bigint) seen,
        false kept from ordered where rn = 1
      union all
      select camera_id, event_id, rn, case when keep then event_id else last end,
        seen + cast(eligible as bigint), keep
      from (select o.*, w.last, w.seen, w.last is null or o.event_id - w.last >= 60 eligible,
          (w.last is null or o.event_id - w.last >= 60) and (w.seen + 1) % 4 = 0 keep
        from walk w join ordered o on o.camera_id = w.camera_id and o.rn = w.rn + 1))
    select camera_id, event_id, row_number() over (partition by camera_id order by event_id)
      sample_id from walk where kept""")
def sample_frames(d):
    seen = d.table("events").select((F.col("user_id") % 25).alias("camera_id"), "event_id")
    return detections.sample_frames(
        seen, time="event_id", tie=(), interval=60, span=1000
    )


@query("""select event_id from (select *, lag(s) over (partition by camera_id order by event_id) l
      from (select user_id % 7 camera_id, event_id,
          case when user_id % 5 = 0 then null else (event_id // 100) || ':u' || (user_id % 3) end s
        from events)) where s is null or s is distinct from l""")
def dedup_consecutive(d):
    user, event = F.col("user_id"), F.col("event_id")
    unsigned = user % 5 == 0
    results = d.table("events").select(
        (user % 7).alias("camera_id"), event.alias("seq"),
        F.when(~unsigned, F.floor(event / 100) + 1).alias("frame_id"),
        F.when(~unsigned, F.concat(F.lit("u"), (user % 3).cast("string"))).alias("updated_at"),
    )
    return detections.dedup_consecutive(results, span=1000).select(F.col("seq").alias("event_id"))


@query("""select camera_id, frame_id, track_id, hits, confidence, x, y, w, h, cx, cy from tracks_seen""")
def confirmed_tracks(d):
    clean = detections.nms(detections.filter_detections(d.detections()))
    return tracking.confirmed_tracks(tracking.track(clean, LONG, warm_up=32))


@query("""with recursive keyed as (
      select r.*, r.camera_id || '/' || r."type" || ':' || r.message || ':' || r.risk || ':' || r."count" k
      from raised_seen r join cameras c on c.camera_id = r.camera_id),
    walk as (
      select k, min(ts_ms) t from keyed group by k
      union all
      select w.k, (select min(a.ts_ms) from keyed a where a.k = w.k and a.ts_ms >= w.t + 15000) t
      from walk w where w.t is not null)
    select a.camera_id, a.frame_id, a."type", a.message, a.risk
    from keyed a join walk w on w.k = a.k and w.t = a.ts_ms""")
def end_to_end(d):
    """From raw detections to the alerts that are left: filter, overlap suppression, tracks, frame
    metrics, alerts, repeats."""
    clean = detections.nms(detections.filter_detections(d.detections()))
    tracks = tracking.confirmed_tracks(tracking.track(clean, LONG, warm_up=32))
    metrics = frames.frame_metrics(tracks, d.frames(), LONG, boxes=False)
    raised = al.explode_alerts(metrics, d.cameras())
    return al.suppress_repeats(raised).select("camera_id", "frame_id", "type", "message", "risk")


# ---- alerts ------------------------------------------------------------------------------


@query('select camera_id, frame_id, "type", message, risk, "count" from raised')
def alerts_each(d):
    return _metrics(d).select("camera_id", "frame_id", F.explode("alerts").alias("a")).select(
        "camera_id", "frame_id", "a.*"
    )


@query("""select sha256(r.camera_id || '|' || r.frame_id || '|' || r.type || '|' ||
        (row_number() over (partition by r.camera_id, r.frame_id order by case r.type
          when 'overcrowding' then 0 when 'sudden_spike' then 1 when 'density_hotspot' then 2
          when 'movement_surge' then 3 else 4 end) - 1)) alert_id, c.user_id,
      r.camera_id, c.zone_name, r.frame_id, r.ts_ms created_ms, r."type", r.message, r.risk,
      r."count"
    from raised r join cameras c on c.camera_id = r.camera_id""")
def explode_alerts(d):
    return al.explode_alerts(_metrics(d), d.cameras())


@query("""select m.camera_id, m.frame_id, c.zone_name || ' reported ' || m.risk || ' crowd density'
      message, m.risk, m.n as "count"
    from metrics m join cameras c on c.camera_id = m.camera_id
    where m.risk in ('High', 'Critical')""")
def fallback_alert(d):
    silent = _metrics(d).withColumn("alerts", F.filter("alerts", lambda a: F.lit(False)))
    return al.explode_alerts(silent, d.cameras()).select(
        "camera_id", "frame_id", "message", "risk", "count"
    )


SUPPRESS_SQL = """with recursive keyed as (
      select *, camera_id || '/' || "type" || ':' || message || ':' || risk k from alert_log),
    walk as (
      select k, min(created_ms) t from keyed group by k
      union all
      select w.k, (select min(a.created_ms) from keyed a where a.k = w.k
        and a.created_ms >= w.t + {window}) t
      from walk w where w.t is not null)
    select a.alert_id from keyed a join walk w on w.k = a.k and w.t = a.created_ms"""


@query(SUPPRESS_SQL.format(window=15000))
def suppress_repeats(d):
    return al.suppress_repeats(d.alert_log(), span_ms=400_000).select("alert_id")


@query("""with recursive ordered as (
      select camera_id, alert_id, created_ms, row_number() over (partition by camera_id
        order by created_ms) rn from alert_log),
    walk as (
      select *, created_ms last, true ok from ordered where rn = 1
      union all
      select o.*, case when o.created_ms - w.last >= 10000 then o.created_ms else w.last end,
        o.created_ms - w.last >= 10000
      from walk w join ordered o on o.camera_id = w.camera_id and o.rn = w.rn + 1)
    select alert_id from walk where ok""")
def throttle(d):
    return al.throttle(
        d.alert_log(), ["camera_id"], "created_ms", ["alert_id"], span_ms=400_000
    ).select("alert_id")


@query("""select alert_id, created_ms from alert_log order by created_ms desc, alert_id limit 800""")
def append_alerts(d):
    log = d.alert_log()
    old, new = F.col("created_ms") % 300 < 200, F.col("created_ms") % 300 >= 200
    return al.append_alerts(log.filter(old), log.filter(new)).select("alert_id", "created_ms")


@query("""select user_id, alert_id, recency from (select *, row_number() over (partition by user_id
      order by created_ms desc, alert_id) recency from alert_log) where recency <= 40""")
def alerts_for_tenant(d):
    return al.alerts_for_tenant(d.alert_log()).select(
        "user_id", "alert_id", F.col("recency").cast("long").alias("recency")
    )


@query("""select user_id, alert_id, "type", message from alert_log
    qualify row_number() over (partition by user_id order by created_ms desc, alert_id) = 1""")
def latest_incident(d):
    return al.latest_incident(d.alert_log()).select("user_id", "alert_id", "type", "message")


# ---- series ------------------------------------------------------------------------------


ARRIVALS_SQL = """select source, frame_id, n current_count, cast(sum(greatest(n - before, 0)) over
      (partition by source order by frame_id) as bigint) total_count
    from (select *, lag(n, 1, 0) over (partition by source order by frame_id) before
      from (select source, frame_id, greatest(current_count, 0) n from count_series))"""


@query(ARRIVALS_SQL)
def running_arrivals(d):
    return series.running_arrivals(d.count_series(), span=1000)


@query("""select service, frame_id, run_id, cast(sum(greatest(n - before, 0)) over
      (partition by service, run_id order by frame_id) as bigint) total_count
    from (select *, lag(n, 1, 0) over (partition by service, run_id order by frame_id) before
      from (select *, greatest(current_count, 0) n, cast(sum(changed) over
            (partition by service order by frame_id) as bigint) run_id
        from (select *, cast(source is distinct from lag(source) over
          (partition by service order by frame_id) as int) changed from live_service)))""")
def reset_on_source_change(d):
    return series.reset_on_source_change(d.live_service(), ["service"], span=1000).select(
        "service", "frame_id", "run_id", "total_count"
    )


@query("""select a.service, coalesce(a.source, s.source) source,
      case when coalesce(a.source, s.source) = s.source then n else 0 end current_count,
      case when coalesce(a.source, s.source) = s.source
        then coalesce(nullif(s.smoothed_count, 0), n) else 0 end final_count,
      case when coalesce(a.source, s.source) = s.source then s.frame_id else 0 end frame_id,
      s.updated_ms
    from (select distinct service, case when frame_id % 2 = 0 then source end source
      from live_service) a
    join (select *, greatest(current_count, 0) n from live_service
      qualify row_number() over (partition by service order by frame_id desc) = 1) s
      on s.service = a.service""")
def stats_by_source(d):
    totals = series.reset_on_source_change(d.live_service(), ["service"], span=1000)
    named = F.when(F.col("frame_id") % 2 == 0, F.col("source")).alias("source")
    asked = d.live_service().select("service", named).distinct()
    return series.stats_by_source(asked, totals).select(
        "service", "source", "current_count", "final_count", "frame_id", "updated_ms"
    )


# ---- tables, jobs, dashboards ------------------------------------------------------------


@query("""select camera_id, name from (
      select camera_id, 'new-' || camera_id || '-' || seq as name from (select * from camera_events
        qualify row_number() over (partition by camera_id order by ts_ms desc, seq desc) = 1)
      union all
      select camera_id, name from cameras
        where camera_id not in (select camera_id from camera_events))""")
def upsert(d):
    camera = F.col("camera_id")
    changes = d.camera_events().select(
        "camera_id", "ts_ms", "seq",
        F.concat(F.lit("new-"), camera.cast("string"), F.lit("-"), F.col("seq").cast("string"))
        .alias("name"),
    )
    base = d.cameras().select("camera_id", "name")
    return tables.upsert(base, changes, "camera_id", "ts_ms", "seq")


@query("""select camera_id, name from cameras where camera_id not in
    (select camera_id from camera_events where "action" = 'delete')""")
def delete_keys(d):
    gone = d.camera_events().filter(F.col("action") == "delete")
    return tables.delete_keys(d.cameras(), gone, "camera_id").select("camera_id", "name")


@query("select camera_id, 'stopped' status from cameras")
def reset_statuses(d):
    return tables.reset_statuses(d.cameras()).select("camera_id", "status")


@query("""select camera_id, tenant_id, case when "action" = 'start' then 'running' else 'stopped' end
      status, last_started_ms, ts_ms last_event_ms
    from (select *, (select max(s.ts_ms) from (select *, lag("action") over
          (partition by camera_id order by ts_ms, seq) before from camera_events) s
        where s.camera_id = e.camera_id and s."action" = 'start'
        and s.before is distinct from 'start' and not exists (select 1 from camera_events x
          where x.camera_id = s.camera_id and x."action" = 'delete'
          and (x.ts_ms, x.seq) > (s.ts_ms, s.seq))) last_started_ms
      from camera_events e
      qualify row_number() over (partition by camera_id order by ts_ms desc, seq desc) = 1)
    where "action" <> 'delete'""")
def camera_state(d):
    return tables.camera_state(d.camera_events()).select(
        "camera_id", "tenant_id", "status", "last_started_ms", "last_event_ms"
    )


LEDGER_SQL = """(select * from job_events qualify row_number() over (partition by job_id
    order by status in ('completed', 'failed') desc, ts_ms desc, seq desc) = 1)"""


@query(f"select job_id, user_id, status, ts_ms, seq from {LEDGER_SQL}")
def job_ledger(d):
    return tables.job_ledger(d.job_events()).select("job_id", "user_id", "status", "ts_ms", "seq")


@query(f"""select j.job_id, coalesce(r.status, 'processing_started') status, r.seq
    from (select distinct job_id from job_events) j left join (select * from {LEDGER_SQL}
      where status <> 'processing_started') r on r.job_id = j.job_id""")
def jobs_with_results(d):
    done = tables.job_ledger(d.job_events()).filter(F.col("status") != tables.STARTED)
    jobs = d.job_events().select("job_id").distinct()
    return tables.jobs_with_results(jobs, done.select("job_id", "status", "seq")).select(
        "job_id", "status", "seq"
    )


@query("""select camera_id, started_ms from (select camera_id, "action", max(case when "action" = 'start'
        and before is distinct from 'start' then ts_ms end) over (partition by camera_id) started_ms,
      row_number() over (partition by camera_id order by ts_ms desc, seq desc) rn
      from (select *, lag("action") over (partition by camera_id order by ts_ms, seq) before
        from camera_events where "action" in ('start', 'stop', 'delete')))
    where rn = 1 and "action" = 'start'""")
def active_streams(d):
    return tables.active_streams(d.camera_events())


@query("""select job_id, array_to_string(list(path order by first), '|') paths
    from (select job_id, path, min(seq) first from (select o_orderkey // 8 job_id, o_orderkey seq,
        case when o_custkey % 4 = 0 then '' else '/tmp/' || o_custkey % 7 end path from orders)
      where path <> '' group by 1, 2) group by 1""")
def distinct_paths(d):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    path = F.when(customer % 4 == 0, "").otherwise(
        F.concat(F.lit("/tmp/"), (customer % 7).cast("string"))
    )
    jobs = d.table("orders").groupBy(F.floor(order / 8).alias("job_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order.alias("seq"), path.alias("p")))),
                    lambda s: s["p"]).alias("paths")
    )
    paths = tables.distinct_paths(jobs).filter(F.size("paths") > 0)
    return paths.select("job_id", F.array_join("paths", "|").alias("paths"))


@query(f"select camera_id, user_id, status, current_count, total_count, risk from {LATEST_SQL}")
def cameras_with_metrics(d):
    return _current_cameras(d).select(
        "camera_id", "user_id", "status", "current_count", "total_count", "risk"
    )


@query(f"""select user_id, count(*) total_zones, count(*) filter (where status = 'running') active_zones,
      cast(sum(current_count) as bigint) total_count,
      count(*) filter (where risk in ('High', 'Critical')) high_risk_zones
    from {LATEST_SQL} group by 1""")
def summary(d):
    return dash.summary(_current_cameras(d)).withColumn(
        "total_count", F.col("total_count").cast("long")
    )


@query(f"""select user_id, camera_id, current_count live_count from {LATEST_SQL}
    where status = 'running' qualify row_number() over (partition by user_id
      order by current_count desc, camera_id) = 1""")
def most_crowded(d):
    best = dash.most_crowded(_current_cameras(d))
    return best.select("user_id", "camera_id", F.col("live_count").cast("long").alias("live_count"))


@query(f"""select user_id, camera_id, congestion_score from {LATEST_SQL} where status = 'running'
    qualify row_number() over (partition by user_id order by congestion_score desc, camera_id) = 1""")
def top_risk_zone(d):
    return dash.top_risk_zone(_current_cameras(d)).select(
        "user_id", "camera_id", "congestion_score"
    )


@query("""select user_id, camera_id, risk, watch_rank from (select *, row_number() over
      (partition by user_id order by camera_id) watch_rank from stored_cameras
      where risk in ('High', 'Critical')) where watch_rank <= 4""")
def risk_watch(d):
    return dash.risk_watch(d.stored_cameras()).select(
        "user_id", "camera_id", "risk", F.col("watch_rank").cast("long").alias("watch_rank")
    )


@query("""select user_id, 'summary' as section, cast(count(*) as varchar) item from stored_cameras
      where user_id = 3 group by 1
    union all select user_id, 'camera', cast(camera_id as varchar) from stored_cameras
      where user_id = 3
    union all select user_id, 'alert', alert_id from (select * from alert_log where user_id = 3
      order by created_ms desc, alert_id limit 40)""")
def dashboard(d):
    board = dash.dashboard(d.stored_cameras(), d.alert_log(), user_id=3)

    def section(df: DataFrame, name: str, item: Column) -> DataFrame:
        return df.select(F.col("user_id").cast("long").alias("user_id"),
                         F.lit(name).alias("section"), item.cast("string").alias("item"))

    return (
        section(board.summary, "summary", F.col("total_zones"))
        .unionByName(section(board.cameras, "camera", F.col("camera_id")))
        .unionByName(section(board.alerts, "alert", F.col("alert_id")))
    )


# ---- row-wise rules ----------------------------------------------------------------------


@query("select camera_id, name from cameras where user_id = 4")
def for_tenant(d):
    return projections.for_tenant(d.cameras(), 4).select("camera_id", "name")


@query("select alert_id, created_ms from alert_log where alert_id = 'a-123'")
def lookup(d):
    return projections.lookup(d.alert_log(), "alert_id", "a-123").select("alert_id", "created_ms")


ADDRESSES_SQL = """(select 'p' || page_id id, case page_id % 3 when 0 then upper(url)
      when 1 then '  ' || url else url end url from pages
    union all select 'c' || camera_id, stream_url from cameras
    union all select 'z' || camera_id, case camera_id % 3 when 0 then ' 0 ' when 1 then '' end
      from cameras)"""


def _addresses(d: Derived) -> DataFrame:
    page, camera, url = F.col("page_id"), F.col("camera_id"), F.col("url")
    pages = d.table("pages").select(
        F.concat(F.lit("p"), page.cast("string")).alias("id"),
        F.when(page % 3 == 0, F.upper(url)).when(page % 3 == 1, F.concat(F.lit("  "), url))
        .otherwise(url).alias("url"),
    )
    cameras = d.cameras().select(
        F.concat(F.lit("c"), camera.cast("string")).alias("id"), F.col("stream_url").alias("url")
    )
    others = d.cameras().select(
        F.concat(F.lit("z"), camera.cast("string")).alias("id"),
        F.when(camera % 3 == 0, " 0 ").when(camera % 3 == 1, "").alias("url"),
    )
    return pages.unionByName(cameras).unionByName(others)


@query(f"""select id, case when regexp_matches(url, '^(?i)https?://') then 'http' else 'rtsp' end kind
    from {ADDRESSES_SQL}""")
def camera_source_type(d):
    return _addresses(d).select("id", text.camera_source_type(F.col("url")).alias("kind"))


@query(f"""select id, case when lower(trim(url)) like 'rtsp://%' then 'rtsp'
      when lower(trim(url)) like 'http://%' or lower(trim(url)) like 'https://%' then 'http' end kind
    from {ADDRESSES_SQL}""")
def stream_type(d):
    return _addresses(d).select("id", text.stream_type(F.col("url")).alias("kind"))


@query(f"""select id, not (a in ('', '0') or a like 'rtsp://%' or a like 'http://%'
      or a like 'https://%') replayable
    from (select id, lower(trim(coalesce(url, ''))) a from {ADDRESSES_SQL})""")
def is_replayable_file(d):
    return _addresses(d).select("id", text.is_replayable_file(F.col("url")).alias("replayable"))


@query("""select camera_id, true valid, coalesce(nullif(place, ''), 'Unknown') as "location",
      case when stream_url ilike 'http%' then 'http' else 'rtsp' end source_type, '' missing
    from (select *, case when camera_id % 4 = 0 then '' when camera_id % 4 = 1 then 'Hall' end place
      from cameras) where camera_id % 5 <> 0 and camera_id % 11 <> 0
    union all
    select camera_id, false, '', '', case when camera_id % 5 = 0 and camera_id % 11 = 0
      then 'name,stream_url' when camera_id % 5 = 0 then 'name' else 'stream_url' end
    from cameras where camera_id % 5 = 0 or camera_id % 11 = 0""")
def validate_cameras(d):
    camera = F.col("camera_id")
    requests = d.cameras().select(
        "camera_id", "zone_name",
        F.when(camera % 5 != 0, F.col("name")).alias("name"),
        F.when(camera % 11 != 0, F.col("stream_url")).otherwise("").alias("stream_url"),
        F.when(camera % 4 == 0, "").when(camera % 4 == 1, "Hall").alias("location"),
    )
    valid, rejected = projections.validate_cameras(requests)
    good = valid.select("camera_id", F.lit(True).alias("valid"), "location", "source_type",
                        F.lit("").alias("missing"))
    bad = rejected.select("camera_id", F.lit(False).alias("valid"), F.lit("").alias("location"),
                          F.lit("").alias("source_type"), "missing")
    return good.unionByName(bad)


@query("""select l_orderkey, l_linenumber, coalesce(current_count, cnt, people_count, 0) worker,
      coalesce(current_count, people_count, cnt, 0) ingest from predictions""",
       name="live_count")
def live_count_query(d):
    row = {c: F.col(c) for c in ("current_count", "count", "people_count")}
    return d.predictions().select(
        "l_orderkey", "l_linenumber", live_count(row).alias("worker"),
        normalized_count(row).alias("ingest"),
    )


@query("""select l_orderkey, l_linenumber, n current_count, n people_count,
      coalesce(total_count, 0.0e0) total_count,
      coalesce(nullif(risk, ''), case when n >= 180 then 'Critical' when n >= 130 then 'High'
        when n >= 75 then 'Medium' else 'Low' end) risk
    from (select *, coalesce(current_count, people_count, cnt, 0.0e0) n from predictions)""")
def normalize_predictions(d):
    return projections.normalize_predictions(d.predictions()).select(
        "l_orderkey", "l_linenumber", "current_count", "people_count", "total_count", "risk"
    )


@query("""select c.camera_id, case when n.camera_id is null then c.current_count
        else coalesce(n.current_count, n.cnt, n.people_count, 0) end current_count,
      case when n.camera_id is null then c.total_count
        else coalesce(n.total_count, c.total_count, 0) end total_count,
      case when n.camera_id is null then c.risk else coalesce(nullif(n.risk, ''), 'Low') end risk
    from stored_cameras c left join (select * from predictions
      qualify row_number() over (partition by camera_id order by l_orderkey desc,
        l_linenumber desc, coalesce(current_count, 0) desc, coalesce(total_count, 0) desc,
        coalesce(risk, '')) = 1) n on n.camera_id = c.camera_id""")
def merge_metrics(d):
    zero = F.lit(0)
    newest = d.predictions().select(
        "*", F.coalesce("current_count", zero).alias("_c"), F.coalesce("total_count", zero).alias("_t"),
        F.coalesce("risk", F.lit("")).alias("_r"),
    )
    from pyspark.sql import Window as W

    order = W.partitionBy("camera_id").orderBy(
        F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("_c"), F.desc("_t"), "_r"
    )
    newest = newest.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(
        "camera_id", "current_count", "count", "people_count", "total_count", "risk"
    )
    merged = projections.merge_metrics(
        d.stored_cameras().select("camera_id", "current_count", "count", "total_count", "risk"),
        newest,
    )
    return merged.select("camera_id", F.col("current_count").cast("double").alias("current_count"),
                         F.col("total_count").cast("double").alias("total_count"), "risk")


@query("""select camera_id, case when n.camera_id is null then c.current_count else n.m end current_count,
      case when n.camera_id is null then c.risk else 'Low' end risk,
      case when n.camera_id is null then c.total_count else coalesce(c.total_count, 0) end total_count
    from stored_cameras c left join (select camera_id, cast(max(people_count) as bigint) m
      from predictions group by 1) n using (camera_id)""")
def merge_partial(d):
    """A prediction without a total, a risk or the first of the counts."""
    newest = d.predictions().groupBy("camera_id").agg(
        F.max("people_count").cast("long").alias("people_count")
    )
    merged = projections.merge_metrics(
        d.stored_cameras().select("camera_id", "current_count", "total_count", "risk"), newest
    )
    return merged.select("camera_id", "current_count", "risk", F.col("total_count").cast("long"))


@query("""select camera_id, coalesce(l.current_count, c.current_count, 0) current_count,
      coalesce(l.current_count, c.cnt, 0) live, coalesce(l.total_count, c.total_count, 0) total_count,
      coalesce(l.density_count, c.density_count, 0) density_count,
      coalesce(l.risk, c.risk, 'Low') risk, coalesce(l.frame_id, c.frame_id) frame_id,
      coalesce(l.updated_ms, c.updated_ms, last_frame_ms, last_started_ms) updated_ms
    from stored_cameras c left join live_stats l on l.source = c.stream_url""")
def merge_live_stats(d):
    merged = projections.merge_live_stats(d.stored_cameras(), d.live_stats())
    return merged.select("camera_id", "current_count", F.col("count").alias("live"), "total_count",
                         "density_count", "risk", "frame_id", "updated_ms")


@query("""select camera_id, 0 as current_count, 0 as total_count, density_count, 'Low' risk,
      0.0e0 congestion_score, 'idle' processing_status from stored_cameras""")
def reset_metrics(d):
    reset = projections.reset_metrics(d.stored_cameras())
    return reset.select(
        "camera_id", F.col("current_count").cast("int").alias("current_count"),
        F.col("total_count").cast("int").alias("total_count"), "density_count", "risk",
        "congestion_score", "processing_status",
    )


@query("""select camera_id, case when old then 0 else current_count end current_count, total_count,
      case when old then 0.0e0 else congestion_score end congestion_score,
      case when old then 'Low' else risk end risk, frame_id,
      case when old then 'stale' end processing_status
    from (select *, coalesce(50000 - updated_ms > 1000, false) old from stored_cameras)""")
def mark_stale(d):
    marked = projections.mark_stale(d.stored_cameras(), F.lit(50_000), time="updated_ms")
    return marked.select("camera_id", "current_count", "total_count", "congestion_score", "risk",
                         "frame_id", "processing_status")


@query("""select camera_id, case when old then 0 else current_count end current_count,
      case when old then 0 else total_count end total_count,
      case when old then 'Low' else risk end risk,
      case when old then 'warming_up' else 'live' end processing_status
    from (select *, coalesce(50000 - updated_ms > 12000, false) old from stored_cameras)""")
def drop_unfresh(d):
    fresh = projections.drop_unfresh(d.stored_cameras(), F.lit(50_000))
    return fresh.select("camera_id", "current_count", "total_count", "risk", "processing_status")


@query("""select camera_id, case when status <> 'running' then 'idle'
      when camera_id % 13 = 0 or 50000 - coalesce(updated_ms, last_frame_ms, last_started_ms) > 12000
        then 'reconnecting'
      when camera_id % 2 = 0 then 'live' else 'connecting' end state from stored_cameras""")
def stream_status(d):
    cameras = d.stored_cameras().select(
        "*", (F.col("camera_id") % 13 == 0).alias("errored"),
        (F.col("camera_id") % 2 == 0).alias("loaded"),
    )
    return cameras.select("camera_id", projections.stream_status(F.lit(50_000)).alias("state"))


@query("""select camera_id, n shown_current, coalesce(total_count, n) shown_total,
      coalesce(density_count, n) shown_density, coalesce(final_count, n) shown_final,
      coalesce(risk, 'Low') shown_risk, least(100.0e0, greatest(6.0e0, congestion_score * 100.0e0))
      bar_percent
    from (select *, coalesce(current_count, cnt, 0) n from stored_cameras)""")
def display_metrics(d):
    shown = projections.display_metrics(d.stored_cameras())
    whole = ("shown_current", "shown_total", "shown_density", "shown_final")
    return shown.select("camera_id", *[F.col(c).cast("long").alias(c) for c in whole],
                        "shown_risk", "bar_percent")


@query("""select upload_id, case when mime not like 'video/%' then 'not a video'
      when size_bytes > 250 * 1024 * 1024 then 'larger than allowed' else '' end reason from uploads""")
def valid_uploads(d):
    accepted, rejected = projections.valid_uploads(d.uploads())
    good = accepted.select("upload_id", F.lit("").alias("reason"))
    return good.unionByName(rejected.select("upload_id", "reason"))


@query("""select upload_id, (1000 + upload_id) || '-' || lower(regexp_replace(left(original_name,
      length(original_name) - 4), '\\s+', '-', 'g')) || right(original_name, 4) stored_name
    from uploads""")
def stored_name(d):
    name = text.stored_name(F.col("original_name"), F.lit(1000) + F.col("upload_id"))
    return d.uploads().select("upload_id", name.alias("stored_name"))


@query("""select l_orderkey, l_linenumber, case when n >= 180 then 'Critical' when n >= 130 then 'High'
      when n >= 75 then 'Medium' else 'Low' end risk,
      case when n >= 180 then 3 when n >= 130 then 2 when n >= 75 then 1 else 0 end level
    from (select *, l_quantity * 4 n from lineitem)""")
def risk_by_count(d):
    level = risk.risk_by_count(F.col("l_quantity") * 4)
    return d.table("lineitem").select("l_orderkey", "l_linenumber", level.alias("risk")).select(
        "*", risk.risk_ordinal(F.col("risk")).cast("int").alias("level")
    )
