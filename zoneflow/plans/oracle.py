"""The derived tables, and shared steps of the checks, as SQL for the side-by-side check."""

from __future__ import annotations

import re

DERIVED_SQL = {
    "cameras": """
        select c_custkey camera_id, c_nationkey user_id, 'cam-' || c_custkey as name,
          c_name zone_name, case when c_custkey % 7 = 0 then 'stopped' else 'running' end status,
          case c_custkey % 3 when 0 then 'rtsp://h/' when 1 then 'HTTP://h/' else 'file-' end
            || c_name as stream_url
        from customer""",
    "in_view": "select greatest(25, count(*) // 600) cameras from customer",
    "frames": """
        select cast(c.camera_id as bigint) camera_id, s.f + 1 frame_id, (s.f + 1) * 5000 ts_ms,
          1280 width, 720 height
        from (select distinct event_id // 500 f from events) s,
          (select unnest(range(cameras)) camera_id from in_view) c""",
    "people": """
        select (event_id * event_id) % (select cameras from in_view) camera_id,
          event_id // 500 + 1 frame_id, user_id track_id, max(event_id) e
        from events group by 1, 2, 3""",
    "tracks": """
        select camera_id, frame_id, track_id, cast((track_id * 41 + e * 13) % 1280 as int) cx,
          cast((track_id * 29 + e * 7) % 720 as int) cy, cast(40 + e % 80 as int) w,
          cast(80 + e % 120 as int) h, cast(cx - w // 2 as int) x, cast(cy - h // 2 as int) y
        from people""",
    "people_big": """
        select l_suppkey % (select cameras from in_view) camera_id, l_orderkey // 50 + 1 frame_id,
          l_partkey track_id, max(l_orderkey * 7 + l_linenumber) e
        from lineitem group by 1, 2, 3""",
    "tracks_big": """
        select camera_id, frame_id, track_id, cast((track_id * 41 + e * 13) % 1280 as int) cx,
          cast((track_id * 29 + e * 7) % 720 as int) cy, cast(40 + e % 80 as int) w,
          cast(80 + e % 120 as int) h, cast(cx - w // 2 as int) x, cast(cy - h // 2 as int) y
        from people_big""",
    "frames_big": """
        select cast(c.camera_id as bigint) camera_id, s.f + 1 frame_id, (s.f + 1) * 250 ts_ms,
          1280 width, 720 height
        from (select distinct l_orderkey // 50 f from lineitem) s,
          (select unnest(range(cameras)) camera_id from in_view) c""",
    "boxes": """
        select camera_id, frame_id, track_id who, e, 40 + track_id % 30 bw, 90 + track_id % 50 bh,
          (track_id * 97 + frame_id * (2 + track_id % 5)) % 1180 bx,
          (track_id * 53 + frame_id * (1 + track_id % 4)) % 560 y0
        from people""",
    "detections": """
        select camera_id, frame_id,
          row_number() over (partition by camera_id, frame_id order by e, k.k) - 1 det_idx,
          case when e % 17 = 0 then 1 else 0 end class_id,
          cast(bx + k.k * 3 as double) x1, cast(y0 + k.k * 2 as double) y1,
          cast(bx + bw + k.k * 3 as double) x2, cast(y0 + bh + k.k * 2 as double) y2,
          cast(30 + (e * 7) % 69 - k.k * 5 as double) / 100.0 confidence, who
        from boxes join (select 0 k union all select 1) k on k.k = 0 or e % 3 = 0""",
    "persons": "select * from detections where class_id = 0 and confidence > 0.4",
    "calm_people": """
        select distinct event_id // 25000 * 5 + user_id % 5 camera_id,
          event_id % 25000 // 20 + 1 frame_id, user_id // 5 % 12 place from events""",
    "job_events": """
        select o_orderkey seq, o_orderkey % 500 job_id, o_custkey % 25 user_id,
          case o_orderstatus when 'P' then 'processing_started' when 'F' then 'completed'
            else 'failed' end status, epoch_us(o_orderdate) // 1000 ts_ms
        from orders""",
    "camera_events": """
        select event_id seq, user_id camera_id, user_id % 5 tenant_id,
          case event_type when 'signup' then 'add' when 'error' then 'delete'
            when 'click' then 'stop' else 'start' end as "action", epoch_us(ts) // 1000 ts_ms
        from events""",
    "predictions": """
        select l_orderkey, l_linenumber, l_suppkey % 25 camera_id,
          case when l_linenumber % 2 = 0 then l_quantity end current_count,
          case when l_linenumber % 3 = 0 then l_quantity + 1 end people_count,
          case when l_linenumber % 5 <> 0 then l_quantity + 2 end cnt,
          case when l_linenumber % 4 <> 0 then l_quantity * 3 end total_count,
          case l_returnflag when 'A' then 'High' when 'R' then '' end risk
        from lineitem""",
    "uploads": """
        select p_partkey upload_id, p_name || '  X.MP4' original_name,
          p_partkey * 200000 size_bytes,
          case p_size % 5 when 0 then 'video/mp4' when 1 then 'video/quicktime'
            when 2 then 'video/x-matroska' when 3 then 'video/webm' else 'image/png' end mime
        from part""",
    "count_series": """
        select 'src-' || (user_id % 20) as source, event_id frame_id,
          cast(floor(value / 4) - 2 as bigint) current_count from events""",
    "live_service": """
        select event_id % 4 service, 'src-' || ((event_id // 400) % 3) as source, event_id frame_id,
          cast(floor(value / 4) - 2 as bigint) current_count, user_id % 9 smoothed_count,
          event_id * 40 updated_ms from events""",
    "alert_log": """
        select 'a-' || event_id alert_id, user_id % 5 user_id, user_id % 25 camera_id,
          event_id * 100 created_ms, event_type as "type", 'seen by ' || (user_id % 2) message,
          case when event_id % 1000 < 500 then 'High' else 'Low' end risk, cast(1 as bigint) "count"
        from events""",
    "stored_cameras": """
        select *, case when camera_id % 4 <> 0 then camera_id % 40 end current_count,
          case when camera_id % 5 <> 0 then camera_id % 41 end cnt,
          case when camera_id % 3 <> 0 then camera_id % 300 end total_count,
          case when camera_id % 6 <> 0 then camera_id % 30 end density_count,
          case when camera_id % 7 <> 0 then camera_id % 45 end final_count,
          case camera_id % 4 when 0 then 'Critical' when 1 then 'High' when 2 then 'Low' end risk,
          case when camera_id % 8 <> 0 then camera_id % 90 end frame_id,
          (camera_id % 21) / 20.0e0 congestion_score,
          case when camera_id % 3 <> 1 then camera_id * 100 end updated_ms,
          case when camera_id % 5 <> 1 then camera_id * 90 end last_frame_ms,
          camera_id * 80 last_started_ms
        from cameras""",
    "live_stats": """
        select stream_url as source, case when camera_id % 8 <> 0 then camera_id % 50 end current_count,
          camera_id % 500 total_count,
          case when camera_id % 10 <> 0 then camera_id % 35 end density_count,
          camera_id % 55 final_count, 'Low' risk, camera_id % 1000 frame_id,
          case when camera_id % 4 = 0 then camera_id * 110 end updated_ms
        from cameras where camera_id in (select user_id from events)""",
    "cells": """
        select l_orderkey map_id, row_number() over
            (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) - 1 gy, 0 gx,
          greatest(l_quantity - 20.0e0, 0) v from lineitem
        union all
        select l_orderkey, row_number() over
            (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) - 1, 1,
          greatest(round_even(l_discount * 100.0e0, 0) / 4, 0) from lineitem
        union all
        select l_orderkey, row_number() over
            (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) - 1, 2,
          greatest(round_even(l_tax * 100.0e0, 0) / 2 - 1.0e0, 0) from lineitem""",
}


NMS_SQL = """with recursive ranked as (
      select camera_id, frame_id, det_idx, confidence, cast(round_even(x1, 0) as int) ax,
        cast(round_even(y1, 0) as int) ay,
        cast(round_even(x1, 0) + greatest(round_even(x2 - x1, 0), 1) as int) bx,
        cast(round_even(y1, 0) + greatest(round_even(y2 - y1, 0), 1) as int) by2,
        row_number() over (partition by camera_id, frame_id order by confidence desc, det_idx) rn
      from persons),
    walk as (
      select camera_id, frame_id, det_idx, rn, true ok,
        [{'ax': ax, 'ay': ay, 'bx': bx, 'by2': by2}] kept from ranked where rn = 1
      union all
      select camera_id, frame_id, det_idx, rn, free,
        case when free then list_append(kept, {'ax': ax, 'ay': ay, 'bx': bx, 'by2': by2})
          else kept end
      from (select b.*, w.kept, len(list_filter(w.kept, lambda k:
          greatest(least(k.bx, b.bx) - greatest(k.ax, b.ax), 0)
            * greatest(least(k.by2, b.by2) - greatest(k.ay, b.ay), 0)
          / cast((k.bx - k.ax) * (k.by2 - k.ay) + (b.bx - b.ax) * (b.by2 - b.ay)
            - greatest(least(k.bx, b.bx) - greatest(k.ax, b.ax), 0)
            * greatest(least(k.by2, b.by2) - greatest(k.ay, b.ay), 0) as double) > 0.45e0)) = 0 free
        from walk w join ranked b on b.camera_id = w.camera_id and b.frame_id = w.frame_id
          and b.rn = w.rn + 1))
    select camera_id, frame_id, det_idx from walk where ok"""


def _overlap(a: str, b: str) -> str:
    """IoU of two boxes of single-precision corners: sides are single, products double."""
    def area(c: str) -> str:
        return (f"greatest(cast({c}.x2 - {c}.x1 as double), 0) * greatest(cast({c}.y2 - {c}.y1 as double), 0)")

    shared = " * ".join(
        f"greatest(least(cast({a}.{q}2 as double), cast({b}.{q}2 as double))"
        f" - greatest(cast({a}.{q}1 as double), cast({b}.{q}1 as double)), 0)" for q in "xy")
    union = f"({area(a)} + {area(b)} - {shared})"
    return f"case when {shared} > 0 and {union} > 0 then {shared} / {union} else 0.0e0 end"


def _box(values: str, others: str) -> str:
    return "{" + ", ".join(f"'{c}': {values.format(c=c)}" for c in ("x1", "y1", "x2", "y2")) + f", {others}" + "}"


TRACK = ("struct(x1 float, y1 float, x2 float, y2 float, confidence double, id bigint, hits bigint, "
         "misses bigint)[]")
SMOOTHED = "cast(0.35 as float) * p.t.{c} + cast(0.65 as float) * d[p.m[1].j].{c}"
# The live tracks of a camera as a list: each step takes one frame, pairs tracks and boxes greedily by
# falling overlap (ties by the order of tracks, then of boxes), and smooths, ages, drops and begins tracks.
TRACKER_SQL = f"""with recursive walk as (
      select camera_id, cast(0 as bigint) rn, cast(0 as bigint) frame_id, cast([] as {TRACK}) live,
        cast(0 as bigint) born, cast([] as {TRACK}) seen
      from (select distinct camera_id from tracker_frames)
      union all
      select camera_id, rn, frame_id, list_filter(live, lambda t: t.misses <= 12), born,
        list_filter(live, lambda t: t.misses = 0)
      from (select camera_id, rn, frame_id, born + len(fresh) born, cast(list_concat(
          list_transform(paired, lambda p: case when len(p.m) = 0 then
            {_box("p.t.{c}", "'confidence': p.t.confidence, 'id': p.t.id, 'hits': p.t.hits, 'misses': p.t.misses + 1")}
            else {_box(SMOOTHED, "'confidence': d[p.m[1].j].confidence, 'id': p.t.id, 'hits': p.t.hits + 1, 'misses': cast(0 as bigint)")} end),
          list_transform(range(1, len(fresh) + 1), lambda k:
            {_box("d[fresh[k]].{c}", "'confidence': d[fresh[k]].confidence, 'id': born + k, 'hits': cast(1 as bigint), 'misses': cast(0 as bigint)")}))
          as {TRACK}) live
        from (select *, list_transform(range(1, len(live) + 1), lambda i:
              {{'t': live[i], 'm': list_filter(picks, lambda q: q.i = i)}}) paired,
            list_filter(range(1, len(d) + 1), lambda j: len(list_filter(picks, lambda q: q.j = j)) = 0) fresh
          from (select *, case when len(found) = 0 then [] else list_reduce(
                list_transform(found, lambda c: {{'p': [{{'i': c.i, 'j': c.j}}]}}), lambda a, b: {{'p': case when
                  len(list_filter(a.p, lambda q: q.i = b.p[1].i or q.j = b.p[1].j)) > 0 then a.p
                  else list_append(a.p, b.p[1]) end}}).p end picks
            from (select *, list_sort(list_filter(flatten(list_transform(range(1, len(live) + 1), lambda i:
                list_transform(range(1, len(d) + 1), lambda j:
                  {{'v': -({_overlap("live[i]", "d[j]")}), 'i': i, 'j': j}}))), lambda c: c.v <= -0.3e0)) found
              from (select n.camera_id, n.rn, n.frame_id, n.d, w.born, list_filter(list_transform(w.live, lambda t:
                  {_box("t.{c}", "'confidence': t.confidence, 'id': t.id, 'hits': t.hits, 'misses': t.misses + n.frame_id - w.frame_id - 1")}),
                  lambda t: t.misses <= 12) live
                from walk w join tracker_frames n on n.camera_id = w.camera_id and n.rn = w.rn + 1))))))
    select camera_id, frame_id, unnest(seen) t from walk"""

DERIVED_SQL |= {
    "unsuppressed": NMS_SQL,
    "tracker_frames": """
        select camera_id, frame_id, d, row_number() over (partition by camera_id order by frame_id) rn
        from (select p.camera_id, p.frame_id, list({'x1': cast(x1 as float), 'y1': cast(y1 as float),
            'x2': cast(x2 as float), 'y2': cast(y2 as float), 'confidence': confidence} order by p.det_idx) d
          from persons p join unsuppressed u on u.camera_id = p.camera_id and u.frame_id = p.frame_id
            and u.det_idx = p.det_idx group by 1, 2)""",
    "tracker_steps": TRACKER_SQL,
    "tracks_seen": """
        select camera_id, frame_id, track_id, hits, confidence, x, y, cast(x2 - x as int) w,
          cast(y2 - y as int) h, (x + x2) // 2 cx, (y + y2) // 2 cy
        from (select *, greatest(x2r, x) x2, greatest(y2r, y) y2 from (select camera_id, frame_id, t.id track_id,
            t.hits hits, t.confidence confidence,
            cast(greatest(round_even(cast(t.x1 as double), 0), 0) as int) x,
            cast(greatest(round_even(cast(t.y1 as double), 0), 0) as int) y,
            cast(round_even(cast(t.x2 as double), 0) as int) x2r,
            cast(round_even(cast(t.y2 as double), 0) as int) y2r
          from tracker_steps where t.hits >= 3))""",
    "frames_seen": "select * from frames",
}


def _risk_by_count(n: str) -> str:
    return (f"case when {n} >= 180 then 'Critical' when {n} >= 130 then 'High' "
            f"when {n} >= 75 then 'Medium' else 'Low' end")


def rounded(x: str, digits: int) -> str:
    """Correctly rounded decimal of a double."""
    return f"cast(printf('%.{digits}f', {x}) as double)"


def frame_steps(suffix: str = "") -> dict[str, str]:
    """SQL of the frame metrics, step by step, over ``tracks`` and ``frames`` (or the big ones)."""
    tracks, frames = f"tracks{suffix}", f"frames{suffix}"
    hotspot = "case when n > 0 then greatest(zl, zc, zr) / cast(n as double) else 0.0e0 end"
    return {
        f"steps{suffix}": f"""
            select *, lag(cx) over w px, lag(cy) over w py from {tracks}
            window w as (partition by camera_id, track_id order by frame_id)""",
        f"counted{suffix}": f"""
            select f.camera_id, f.frame_id, f.ts_ms, f.width, f.height,
              count(distinct s.track_id) n,
              count(*) filter (where s.cx < f.width / 3) zl,
              count(*) filter (where s.cx >= f.width / 3 and s.cx < 2 * f.width / 3) zc,
              count(*) filter (where s.cx >= 2 * f.width / 3) zr,
              least(coalesce(sum(greatest(s.w, 0) * greatest(s.h, 0)), 0)
                / cast(greatest(f.width * f.height, 1) as double), 1.0e0) bbox,
              coalesce(avg(case when s.px is not null then
                sqrt((s.cx - s.px) * (s.cx - s.px) + (s.cy - s.py) * (s.cy - s.py))
                / greatest(sqrt(f.width * f.width + f.height * f.height), 1) end), 0.0e0) movement,
              count(*) filter (where s.py < greatest(f.height // 2, 1)
                and s.cy >= greatest(f.height // 2, 1)) entries,
              count(*) filter (where s.py > greatest(f.height // 2, 1)
                and s.cy <= greatest(f.height // 2, 1)) exits,
              count(*) filter (where s.track_id is not null and s.px is null) first_seen
            from {frames} f left join steps{suffix} s
              on s.camera_id = f.camera_id and s.frame_id = f.frame_id
            group by f.camera_id, f.frame_id, f.ts_ms, f.width, f.height""",
        f"history{suffix}": f"""
            select *, cast(sum(entries) over r as bigint) line_entry,
              cast(sum(exits) over r as bigint) line_exit,
              cast(sum(first_seen) over r as bigint) total_count,
              avg(movement) over (partition by camera_id order by frame_id
                rows between 23 preceding and current row) smoothed,
              lag(n, 1, 0) over (partition by camera_id order by frame_id) last_count,
              list(n) over (partition by camera_id order by frame_id
                rows between 7 preceding and current row) recent,
              {hotspot} hotspot
            from counted{suffix}
            window r as (partition by camera_id order by frame_id
              rows between unbounded preceding and current row)""",
        f"featured{suffix}": f"""
            select *, least(greatest(bbox * 2.4e0, hotspot * 0.75e0), 1.0e0) density
            from history{suffix}""",
        f"scored{suffix}": f"""
            select *, {rounded('density', 4)} density_score,
              {rounded('smoothed', 4)} movement_score,
              {rounded('least(1.0e0, n / 25.0e0 * 0.45e0 + density * 0.35e0 '
                       '+ smoothed * 1.2e0 * 0.20e0)', 4)} congestion_score,
              {rounded('hotspot', 4)} hotspot_ratio
            from featured{suffix}""",
        f"judged{suffix}": f"""
            select *, least(1.0e0, least(n / 37.5e0, 1.0e0) * 0.45e0 + density_score * 0.30e0
              + movement_score * 0.10e0 + congestion_score * 0.15e0) score
            from scored{suffix}""",
        f"metrics{suffix}": f"""
            select *, {rounded('score', 4)} risk_score,
              case when score >= 0.82e0 then 'Critical' when score >= 0.62e0 then 'High'
                when score >= 0.34e0 then 'Medium' else {_risk_by_count('n')} end risk
            from judged{suffix}""",
        f"raised{suffix}": f"""
            select camera_id, frame_id, ts_ms, 'overcrowding' as "type",
              'People count reached ' || n message, {_risk_by_count('n')} risk, n as "count"
            from metrics{suffix} where n >= 25
            union all
            select camera_id, frame_id, ts_ms, 'sudden_spike',
              'People count jumped from ' || last_count || ' to ' || n, {_risk_by_count('n')}, n
            from metrics{suffix} where n - last_count >= 8
            union all
            select camera_id, frame_id, ts_ms, 'density_hotspot',
              'Density hotspot detected at score ' || printf('%.2f', density_score), risk, n
            from metrics{suffix} where density_score >= 0.32e0
            union all
            select camera_id, frame_id, ts_ms, 'movement_surge',
              'Movement surge detected at score ' || printf('%.2f', movement_score), risk, n
            from metrics{suffix} where movement_score >= 0.12e0
            union all
            select camera_id, frame_id, ts_ms, 'congestion_risk',
              'Congestion risk reached ' || printf('%.2f', congestion_score), risk, n
            from metrics{suffix} where congestion_score >= 0.55e0""",
    }


STEPS = {**DERIVED_SQL, **frame_steps(), **frame_steps("_big"), **frame_steps("_seen")}


def with_steps(sql: str) -> str:
    """``sql`` preceded by the definitions of all steps it names, directly or not."""
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"(?:from|join)\s+([a-z_]+)", text):
            if name in STEPS and name not in needed:
                visit(STEPS[name])
                needed[name] = STEPS[name]

    visit(sql)
    body = sql.strip()
    recursive = body.lower().startswith("with recursive")
    own = not recursive and body.lower().startswith("with ")
    steps = ",\n".join(f"{name} as ({text.strip()})" for name, text in needed.items())
    if recursive:
        rest = body[len("with recursive"):]
        return f"with recursive {steps}{',' if steps else ''}\n{rest}"
    if own and steps:
        return f"with {steps},\n{body[len('with'):]}"
    return f"with {steps}\n{body}" if steps else body
