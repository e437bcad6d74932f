import random

from pyspark.sql import functions as F

import naive
from zoneflow.operators import alerts, frames, heatmap
from zoneflow.params import Params
from zoneflow.schemas import FRAME_RESULT

TRACKS = ("camera_id long, frame_id long, track_id long, x int, y int, w int, h int, cx int, cy int")
FRAMES = "camera_id long, frame_id long, ts_ms long, width int, height int"


def tracks_df(spark, rows):
    """rows: (camera, frame, track, cx, cy[, w, h])"""
    full = []
    for camera, frame, track, cx, cy, *size in rows:
        w, h = size or (4, 4)
        full.append((camera, frame, track, cx - w // 2, cy - h // 2, w, h, cx, cy))
    return spark.createDataFrame(full, TRACKS)


def frames_df(spark, camera, numbers, width=900, height=720):
    rows = [(camera, n, n * 1000, width, height) for n in numbers]
    return spark.createDataFrame(rows, FRAMES)


def ordered(df, *columns):
    return [tuple(r[c] for c in columns) for r in sorted(df.collect(), key=lambda r: r.frame_id)]


def test_everything_equals_the_plain_engine(spark):
    rng = random.Random(2)
    numbers = sorted(rng.sample(range(1, 140), 110))  # with gaps
    rows, expected = [], {}
    for camera in (1, 2):
        by_frame = {}
        for n in numbers:
            people = rng.sample(range(1, 80), rng.choice([0, 0, 3, 12, 30, 45]))
            for t in people:
                cx, cy, w, h = (rng.randrange(900), rng.choice([100, 359, 360, 361, 700]),
                                rng.randrange(1, 90), rng.randrange(1, 200))
                rows.append((camera, n, t, cx, cy, w, h))
                by_frame.setdefault(n, []).append((t, 0, 0, w, h, cx, cy))
        expected[camera] = naive.crowd(by_frame, [(n, 900, 720) for n in numbers])
    tracks = tracks_df(spark, rows)
    spine = frames_df(spark, 1, numbers).unionByName(frames_df(spark, 2, numbers))
    for span in (5, 40, 512):
        got = frames.frame_metrics(tracks, spine, Params(frames_per_span=span)).collect()
        assert len(got) == 2 * len(numbers)
        for camera in (1, 2):
            mine = sorted((r for r in got if r.camera_id == camera), key=lambda r: r.frame_id)
            for r, e in zip(mine, expected[camera]):
                assert (r.frame_id, r.current_count, r.total_count, r.last_count) == (
                    e["frame_id"], e["current_count"], e["total_count"], e["last_count"])
                assert (r.zone_left, r.zone_center, r.zone_right) == e["zones"]
                assert (r.line_entry, r.line_exit) == e["line"]
                assert r.count_history == e["count_history"]
                for c in ("density_score", "movement_score", "congestion_score", "risk_score"):
                    assert abs(r[c] - e[c]) < 1.5e-4 and 0 <= r[c] <= 1


def test_line_and_zones(spark):
    ys = {1: (359, 360), 2: (361, 360), 3: (360, 400), 4: (360, 300)}
    rows = [(1, f + 1, t, 10, y) for t, pair in ys.items() for f, y in enumerate(pair)]
    got = frames.frame_metrics(tracks_df(spark, rows), frames_df(spark, 1, [1, 2]))
    assert ordered(got, "line_entry", "line_exit") == [(0, 0), (1, 1)]
    rows = [(1, 1, i, cx, 10) for i, cx in enumerate((299, 300, 599, 600))]
    got = frames.frame_counts(tracks_df(spark, rows), frames_df(spark, 1, [1]))
    assert ordered(got, "zone_left", "zone_center", "zone_right") == [(1, 2, 1)]


def people(spark, counts):
    rows = [(1, i + 1, t, 10 + t, 10) for i, n in enumerate(counts) for t in range(n)]
    return frames.frame_metrics(tracks_df(spark, rows), frames_df(spark, 1, range(1, len(counts) + 1)))


def kinds(df):
    return [{a.type for a in r.alerts} for r in sorted(df.collect(), key=lambda r: r.frame_id)]


def test_alert_boundaries(spark):
    got = kinds(people(spark, [24, 25]))
    assert "overcrowding" not in got[0] and "overcrowding" in got[1]
    assert "sudden_spike" not in kinds(people(spark, [7]))[0]
    assert "sudden_spike" in kinds(people(spark, [8]))[0]


def test_one_person_is_a_hotspot(spark):
    row = people(spark, [1]).first()
    assert (row.hotspot_ratio, row.density_score) == (1.0, 0.75)
    alert = [a for a in row.alerts if a.type == "density_hotspot"][0]
    assert alert.message == "Density hotspot detected at score 0.75"


def test_overcrowding_reports_count_risk(spark):
    alert = [a for a in people(spark, [25]).first().alerts if a.type == "overcrowding"][0]
    assert (alert.risk, alert["count"], alert.message) == ("Low", 25, "People count reached 25")


def test_dense_frames_take_the_model_count(spark):
    tracks = tracks_df(spark, [(1, f, t, 10, 10) for f, n in ((1, 14), (2, 15)) for t in range(n)])
    spine = frames_df(spark, 1, [1, 2]).withColumn("density_count", F.lit(40))
    got = frames.frame_metrics(tracks, spine)
    assert ordered(got, "base_count", "final_count") == [(14, 14), (40, 40)]


def test_forecast_blend_needs_five_samples(spark):
    rows = [(20, 30.0, 5), (20, 30.0, 4), (20, None, 8), (20, -5.0, 5)]
    df = spark.createDataFrame(rows, "base long, p double, n int")
    blend = frames.blend_forecast(F.col("base"), F.col("p"), F.col("n"))
    got = [(r.b.predicted_crowd, r.b.final_count) for r in df.select(blend.alias("b")).collect()]
    assert got == [(30.0, 23), (20.0, 20), (20.0, 20), (0.0, 14)]


def test_document_has_the_declared_schema(spark):
    doc = frames.result_document(people(spark, [3]))
    assert [(f.name, f.dataType.simpleString()) for f in doc.schema] == [
        (f.name, f.dataType.simpleString()) for f in FRAME_RESULT
    ]


def test_sources_without_frames_get_the_empty_result(spark):
    results = people(spark, [3, 4]).withColumnRenamed("camera_id", "job_id")
    jobs = spark.createDataFrame([(1,), (2,)], "job_id long")
    got = {r.job_id: r for r in frames.last_result(results, jobs).collect()}
    assert (got[1].current_count, got[1].frame_id) == (4, 2)
    assert (got[2].current_count, got[2].risk, got[2].alerts, got[2].frame_id) == (0, "Low", [], None)


def test_heatmap_keeps_points_over_empty_frames_and_spans(spark):
    rng = random.Random(6)
    rows = [(1, f, t, rng.randrange(900), rng.randrange(700))
            for f in range(1, 60) for t in range(rng.choice([0, 0, 1, 4]))]
    params = Params(frames_per_span=7, heatmap_history=9)
    got = heatmap.heatmap_history(tracks_df(spark, rows), frames_df(spark, 1, range(1, 61)), params)
    points = {r.frame_id: [(p.x, p.y) for p in r.heatmap_points] for r in got.collect()}
    for frame in range(1, 61):
        assert points[frame] == [r[3:5] for r in rows if r[1] <= frame][-9:]
    latest = heatmap.latest_heatmap(tracks_df(spark, rows), params).orderBy("position").collect()
    assert [(r.x, r.y) for r in latest] == points[60]


def test_histories_are_not_sorted_to_find_the_last_one(spark):
    """A history is up to 250 points to a frame: an aggregate over cameras takes them as they come."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = heatmap.heatmap_history(
            tracks_df(spark, [(1, 2, 1, 10, 20), (1, 9, 1, 30, 40)]), frames_df(spark, 1, range(1, 11)),
            Params(frames_per_span=4))
        last = frames.latest_by(points, ["camera_id"], "frame_id")
        lines = plan(last).splitlines()
        first = next(i for i, line in enumerate(lines) if "partial_max_by" in line)
        below = "\n".join(lines[first:]).split("SortMergeJoin")[0]
        assert "Sort [" not in below and "SortMergeJoin" in plan(last)
        row = last.first()
        assert row.frame_id == 10 and [(p.x, p.y) for p in row.heatmap_points] == [(10, 20), (30, 40)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_points_of_frames_without_spine_and_repeated_frames(spark):
    rows = [(1, 1, 1, 10, 20), (1, 2, 1, 11, 21), (1, 5, 2, 12, 22), (1, 5, 1, 13, 23)]
    spine = frames_df(spark, 1, [1, 5, 6]).unionByName(frames_df(spark, 1, [5]))
    got = heatmap.heatmap_history(tracks_df(spark, rows), spine, Params(frames_per_span=4)).collect()
    assert sorted((r.frame_id, [(p.x, p.y) for p in r.heatmap_points]) for r in got) == [
        (1, [(10, 20)]), (5, [(10, 20), (13, 23), (12, 22)]), (6, [(10, 20), (13, 23), (12, 22)])]


def test_fallback_alert_needs_escalated_risk(spark):
    rows = [(1, 1, 1000, 5, "High"), (1, 2, 2000, 6, "Medium")]
    metrics = spark.createDataFrame(
        rows, "camera_id long, frame_id long, ts_ms long, current_count long, risk string"
    ).withColumn("alerts", F.array().cast(FRAME_RESULT["alerts"].dataType))
    cameras = spark.createDataFrame([(1, 9, "Gate")], "camera_id long, user_id long, zone_name string")
    got = alerts.explode_alerts(metrics, cameras).collect()
    assert [(r.frame_id, r.type, r.message, r["count"]) for r in got] == [
        (1, "overcrowding", "Gate reported High crowd density", 5)
    ]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shares_one_pass_and_never_crosses(spark):
    rows = [(1, f, t, f + t, f) for f in range(1, 40) for t in range(3)]
    metrics = frames.frame_metrics(
        tracks_df(spark, rows), frames_df(spark, 1, range(1, 40)), Params(frames_per_span=8)
    )
    metrics.collect()
    final = plan(metrics).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    for text in (final, plan(metrics)):
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_tracks_of_missing_frames_count_nowhere(spark):
    tracks = tracks_df(spark, [(1, 1, 5, 100, 100), (1, 2, 5, 100, 400), (1, 3, 5, 100, 420), (1, 2, 9, 50, 50)])
    got = frames.frame_metrics(tracks, frames_df(spark, 1, [1, 3]), Params(frames_per_span=2))
    assert ordered(got, "frame_id", "total_count", "line_entry") == [(1, 1, 0), (3, 1, 1)]


def test_density_is_the_track_count_in_sparse_frames(spark):
    spine = frames_df(spark, 1, [1]).withColumn("density_count", F.lit(40))
    row = frames.frame_metrics(tracks_df(spark, [(1, 1, 1, 10, 10)]), spine).first()
    assert (row.density_count, row.base_count) == (1, 1)


def test_latest_metrics_are_those_of_the_last_frames(spark):
    """The short way to current results gives what the whole way does, whatever the spans."""
    rows, spine = [], []
    for camera in (1, 2, 3):
        for f in range(1, 90):
            if camera == 3 and f > 5 or f % 11 == 0:
                continue
            spine.append((camera, f, f * 100, 1280, 720, (f * 7) % 40 if f % 3 else None))
            for t in range((f * camera) % 19):
                x, y = (t * 97 + f * 13) % 1200, (t * 53 + f * (t % 5)) % 640
                rows.append((camera, f, t, x, y, 40, 80, x + 20, y + 40))
    tracks = spark.createDataFrame(
        rows, "camera_id long, frame_id long, track_id long, x int, y int, w int, h int, cx int, cy int")
    frame_table = spark.createDataFrame(
        spine, "camera_id long, frame_id long, ts_ms long, width int, height int, density_count long")
    for span in (16, 40, 512):
        params = Params(frames_per_span=span)
        whole = frames.latest_per_camera(frames.frame_metrics(tracks, frame_table, params, boxes=False))
        short = frames.latest_metrics(tracks, frame_table, params)
        assert sorted(short.columns) == sorted(whole.columns)
        columns = [c for c in whole.columns if c != "smoothed_movement"]
        got = {r["camera_id"]: r for r in short.collect()}
        for r in whole.collect():
            assert [got[r["camera_id"]][c] for c in columns] == [r[c] for c in columns]
            assert abs(got[r["camera_id"]]["smoothed_movement"] - r["smoothed_movement"]) < 1e-12


def test_scores_are_built_only_where_they_are_asked_for(spark):
    """What a query does not name is left out, and a filter copies no features below their columns."""
    counts = frames.frame_counts(tracks_df(spark, [(1, 1, 1, 5, 5)]), frames_df(spark, 1, [1, 2]), boxes=False)
    scored = frames.with_scores(frames.with_history(counts))
    risks = scored.select("risk")._jdf.queryExecution().optimizedPlan().toString()
    assert "People count reached" not in risks
    alerting = scored.filter(F.size("alerts") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert alerting.count("2.4") == 1
    assert [r.risk for r in scored.collect()] == ["Low", "Low"]


def test_frames_without_alerts_have_empty_ones(spark):
    got = sorted(people(spark, [1, 30, 30]).collect(), key=lambda r: r.frame_id)
    assert [[a.type for a in r.alerts][:2] for r in got][0] == ["density_hotspot"]
    quiet = frames.frame_metrics(tracks_df(spark, []), frames_df(spark, 1, [1, 2])).collect()
    assert [r.alerts for r in quiet] == [[], []]


def test_pictures_shuffle_no_points(spark):
    """A frame's points are up to ``heatmap_history`` times its row, so they are built after the last shuffle."""
    tracks, spine = tracks_df(spark, [(1, n, t, 10 * n, t) for n in (1, 2, 4) for t in (1, 2)]), frames_df(
        spark, 1, [1, 2, 3, 4, 40])
    maps = spine.withColumn("density_map", F.array(F.array(F.lit(0.0), F.lit(2.0))))
    metrics = frames.frame_metrics(tracks, spine, Params(frames_per_span=2))
    unknown = metrics.unionByName(metrics.filter("frame_id = 4").withColumn("frame_id", F.lit(9).cast("long")))
    pictured = frames.with_pictures(unknown, tracks, maps, Params(frames_per_span=2, heatmap_history=3))
    plan = pictured.select("frame_id", "heatmap_points")._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("arrays_zip")]
    assert "Exchange" not in above
    got = {r.frame_id: [(p.x, p.y) for p in r.heatmap_points] for r in pictured.collect()}
    assert got == {1: [(10, 1), (10, 2)], 2: [(10, 2), (20, 1), (20, 2)], 3: [(10, 2), (20, 1), (20, 2)],
                   4: [(20, 2), (40, 1), (40, 2)], 40: [(20, 2), (40, 1), (40, 2)], 9: []}


def test_a_track_twice_in_a_frame_counts_once(spark):
    """Frames reach the rows of tracks after earlier positions are found, so no frame is sorted by track."""
    rows = [(1, 1, 7, 5, 5), (1, 1, 7, 5, 5), (1, 1, 8, 6, 6), (1, 2, 7, 9, 9), (1, 50, 7, 9, 9), (1, 3, 7, 9, 9)]
    for boxes in (True, False):
        counts = frames.frame_counts(
            tracks_df(spark, rows), frames_df(spark, 1, [1, 2, 4, 50]), Params(frames_per_span=8), boxes=boxes)
        got = sorted(counts.collect(), key=lambda r: r.frame_id)
        assert [(r.frame_id, r.current_count, r.first_seen) for r in got][1:] == [(2, 1, 0), (4, 0, 0), (50, 1, 0)]
        assert got[0].current_count == 2
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    windows = [line for line in plan.splitlines() if "Window" in line and "track_id" in line]
    assert windows and all("_frame" not in line.split("],")[0] for line in windows)
