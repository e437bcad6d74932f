import json

from pyspark.sql import functions as F

from zoneflow.operators import alerts, dashboard, density, projections, series, tables
from zoneflow.params import Params
from zoneflow.sources import readers, sinks

CAMERA = {
    "id": "c-1", "userId": "u-1", "name": "Door", "zoneName": "Hall", "location": "North",
    "streamUrl": "http://192.0.2.1/video", "sourceType": "http", "status": "stopped",
    "createdAt": "2031-02-03T04:05:06.789Z", "lastFrameAt": "2031-02-03T05:00:00.250Z",
    "metrics": {
        "count": 2, "current_count": 2, "active_track_ids": [4, 5], "detections": [],
        "zone_counts": {"left": 1, "center": 1, "right": 0}, "line_crossing": {"entry": 3, "exit": 1},
        "crowd_features": {"density_score": 0.5, "movement_score": 0, "congestion_score": 0.25,
                           "hotspot_ratio": 0.5},
        "risk": "Low", "updated_at": "2031-02-03T04:10:00.125500+00:00", "unknown": {"x": 1},
    },
}


def test_camera_documents(spark, tmp_path):
    path = tmp_path / "cameras.json"
    assert readers.read_cameras(spark, str(path)).count() == 0
    path.write_text(json.dumps([CAMERA, {**CAMERA, "id": "c-2", "metrics": None}], indent=2))
    rows = {r.camera_id: r for r in readers.read_cameras(spark, str(path)).collect()}
    one = rows["c-1"]
    assert (one.zone_left, one.line_entry, one.congestion_score) == (1, 3, 0.25)
    assert one.created_ms == 1927857906789 and one.updated_ms == 1927858200125
    assert one.last_started_ms is None and rows["c-2"].current_count is None
    path.write_text("[{ not json")
    assert readers.read_cameras(spark, str(path)).count() == 0


def test_alert_and_job_documents(spark, tmp_path):
    alerts_path, jobs_path = tmp_path / "alerts.json", tmp_path / "jobs"
    alerts_path.write_text(json.dumps([{
        "id": "a", "userId": "u", "cameraId": "c", "zoneName": "z", "message": "m", "risk": "High",
        "count": 7, "type": "overcrowding", "createdAt": "2031-02-03T00:00:00.000Z"}]))
    assert readers.read_alerts(spark, str(alerts_path)).first()["count"] == 7
    jobs_path.mkdir()
    (jobs_path / "1.json").write_text("\n".join(json.dumps(e) for e in [
        {"job_id": "j", "status": "processing_started", "created_at": "2031-02-03T00:00:00Z"},
        {"job_id": "j", "status": "completed", "completed_at": "2031-02-03T00:01:00+00:00",
         "result": {"current_count": 3}}]))
    ledger = tables.job_ledger(readers.read_jobs(spark, str(jobs_path)).withColumn("seq", F.lit(0)))
    row = ledger.first()
    assert (row.status, row.result.current_count) == ("completed", 3)


def test_table_can_be_rewritten_from_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    assert sinks.read_table(spark, path) is None
    sinks.write_table(spark.range(3), path)
    for version in range(2, 7):
        rows = sinks.read_table(spark, path)
        assert sinks.write_table(rows.unionByName(rows), path) == version
    assert sinks.read_table(spark, path).count() == 3 * 2**5
    # A reader may still be at an old version: versions go by time, and never the last three.
    assert len(list((tmp_path / "table").glob("v*"))) == 6
    sinks.write_table(sinks.read_table(spark, path), path, keep_ms=0)
    assert sorted(p.name for p in (tmp_path / "table").glob("v*")) == ["v5", "v6", "v7"]


def test_retention_is_global_and_lists_are_per_tenant(spark):
    log = spark.range(1000).select(
        F.concat(F.lit("a"), F.col("id")).alias("alert_id"), (F.col("id") % 10).alias("user_id"),
        F.col("id").alias("created_ms"))
    kept = alerts.append_alerts(log.filter("created_ms < 990"), log.filter("created_ms >= 990"))
    assert kept.count() == 800 and kept.agg(F.min("created_ms")).first()[0] == 200
    assert alerts.alerts_for_tenant(log).groupBy("user_id").count().filter("count != 40").count() == 0


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, seq long")
    got = {tuple(r) for r in tables.upsert(base, changes, "id", "seq").collect()}
    assert got == {(1, "a"), (2, "d"), (3, "e")}
    assert {r.id for r in tables.delete_keys(base, changes, "id").collect()} == {1}


def test_terminal_job_states_win(spark):
    rows = [("j", "completed", 5, 1), ("j", "processing_started", 9, 2), ("k", "processing_started", 1, 3)]
    df = spark.createDataFrame(rows, "job_id string, status string, ts_ms long, seq long")
    got = {r.job_id: r.status for r in tables.job_ledger(df).collect()}
    assert got == {"j": "completed", "k": "processing_started"}


def test_camera_state(spark):
    events = [(1, 1, "add", 1), (1, 1, "start", 2), (2, 1, "add", 1), (2, 1, "start", 2), (2, 1, "stop", 3),
              (3, 1, "add", 1), (3, 1, "delete", 2), (4, 1, "start", 1), (4, 1, "delete", 2), (4, 1, "add", 3)]
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(events)],
                               "camera_id long, tenant_id long, action string, ts_ms long, seq long")
    got = {r.camera_id: (r.status, r.last_started_ms) for r in tables.camera_state(df).collect()}
    assert got == {1: ("running", 2), 2: ("stopped", 2), 4: ("stopped", None)}
    assert {r.camera_id for r in tables.active_streams(df).collect()} == {1}


def test_paths_are_distinct_in_order(spark):
    df = spark.createDataFrame([(1, ["b", "", "a", None, "b"]), (2, None)], "job_id long, paths array<string>")
    assert [r.paths for r in tables.distinct_paths(df).orderBy("job_id").collect()] == [["b", "a"], []]


def test_stale_keeps_totals(spark):
    df = spark.createDataFrame([(1, 0, 5, 9, 2, "High"), (2, 500, 5, 9, 2, "High"), (3, None, 5, 9, 2, "High")],
                               "id long, processed_ms long, current_count long, total_count long, "
                               "line_entry long, risk string")
    got = [tuple(r)[2:] for r in projections.mark_stale(df, F.lit(1500)).orderBy("id").collect()]
    assert got == [(0, 9, 2, "Low", "stale"), (5, 9, 2, "High", None), (5, 9, 2, "High", None)]
    old = projections.drop_unfresh(df, F.lit(12_500), time="processed_ms").orderBy("id").collect()
    assert [(r.total_count, r.processing_status) for r in old] == [(0, "warming_up"), (9, "live"), (9, "live")]


def test_stream_status(spark):
    rows = [("stopped", 0, False, True), ("running", 0, True, True), ("running", 0, False, True),
            ("running", 5000, False, True), ("running", 5000, False, False), ("running", None, False, True)]
    df = spark.createDataFrame(rows, "status string, updated_ms long, errored boolean, loaded boolean")
    df = df.select("*", F.lit(None).cast("long").alias("last_frame_ms"),
                   F.lit(None).cast("long").alias("last_started_ms"))
    got = [r[0] for r in df.select(projections.stream_status(F.lit(12_001))).collect()]
    assert got == ["idle", "reconnecting", "reconnecting", "live", "connecting", "live"]


def test_rankings_take_running_cameras(spark):
    rows = [(1, 9, "stopped", 50, 0.9, "High"), (2, 9, "running", 7, 0.1, "Low"), (3, 9, "running", 7, 0.4, "Critical")]
    df = spark.createDataFrame(rows, "camera_id long, user_id long, status string, current_count long, "
                               "congestion_score double, risk string")
    assert dashboard.most_crowded(df).first().camera_id == 2
    assert dashboard.top_risk_zone(df).first().camera_id == 3
    assert [r.camera_id for r in dashboard.risk_watch(df).orderBy("watch_rank").collect()] == [1, 3]
    s = dashboard.summary(df).first()
    assert (s.total_zones, s.active_zones, s.total_count, s.high_risk_zones) == (3, 2, 64, 2)


def test_merge_metrics(spark):
    old = spark.createDataFrame([(1, 5, 50, "High", 3), (2, 6, 60, "High", 4)],
                                "camera_id long, current_count long, total_count long, risk string, frame_id long")
    new = spark.createDataFrame([(1, None, 7.0, None, float("nan"), "", None)],
                                "camera_id long, current_count double, count double, people_count double, "
                                "total_count double, risk string, frame_id long")
    got = {r.camera_id: r for r in projections.merge_metrics(old, new).collect()}
    one = got[1]
    assert (one.current_count, one.total_count, one.risk, one.frame_id) == (7, 50, "Low", 3)
    assert (got[2].current_count, got[2].risk) == (6, "High")


def test_density_maps(spark):
    df = spark.createDataFrame([([[1.0, -4.0], [2.5, 3.0]],), ([[2.0, 2.0]],)], "m array<array<double>>")
    got = df.select(density.density_count(F.col("m")), density.normalize_density(F.col("m"))).collect()
    assert got[0][0] == 6 and got[0][1] == [[0.3333, 0.0], [0.8333, 1.0]]
    assert got[1][0] == 4 and got[1][1] == [[0.0, 0.0]]
    flat = spark.createDataFrame([([1.0, 2.6],)], "m array<double>")
    assert flat.select(density.density_count(F.col("m"), 1)).first()[0] == 4


def test_heat_grid_scales_from_zero_unless_full(spark):
    points = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 99, 99), (1, 250, -3)],
                                   "camera_id long, cx int, cy int")
    small = Params(grid_width=2, grid_height=2)
    got = {(r.gx, r.gy): (r.visits, r.heat) for r in
           density.heat_grid(points, F.lit(100), F.lit(100), small).collect()}
    assert got == {(0, 0): (2, 1.0), (1, 1): (1, 0.5), (1, 0): (1, 0.5)}


def test_uploads(spark):
    rows = [(1, "video/mp4", 250 * 1024 * 1024), (2, "video/webm", 250 * 1024 * 1024 + 1),
            (3, "image/png", 1), (4, None, 1)]
    ok, bad = projections.valid_uploads(spark.createDataFrame(rows, "id long, mime string, size_bytes long"))
    assert [r.id for r in ok.collect()] == [1]
    assert {r.id: r.reason for r in bad.collect()} == {
        2: "larger than allowed", 3: "not a video", 4: "not a video"}


def test_a_start_of_a_running_camera_does_nothing(spark):
    rows = [(1, 100, 1, "add"), (1, 200, 2, "start"), (1, 300, 3, "start"),
            (2, 200, 4, "start"), (2, 300, 5, "stop"), (2, 400, 6, "start"), (2, 500, 7, "start"),
            (3, 100, 8, "start"), (3, 200, 9, "stop")]
    events = spark.createDataFrame([(*r, 0) for r in rows],
                                   "camera_id long, ts_ms long, seq long, action string, tenant_id long")
    state = {r.camera_id: (r.status, r.last_started_ms) for r in tables.camera_state(events).collect()}
    assert state == {1: ("running", 200), 2: ("running", 400), 3: ("stopped", 100)}
    active = {(r.camera_id, r.started_ms) for r in tables.active_streams(events).collect()}
    assert active == {(1, 200), (2, 400)}


def test_merge_without_count_and_risk(spark):
    stored = spark.createDataFrame([(1, 7, 7, 50, "High"), (2, 4, 4, 9, "High")],
                                   "camera_id long, current_count long, count long, total_count long, risk string")
    new = spark.createDataFrame([(1, 3)], "camera_id long, current_count long")
    got = {r.camera_id: (r.current_count, r["count"], r.total_count, r.risk)
           for r in projections.merge_metrics(stored, new).collect()}
    assert got == {1: (3, 3, 50, "Low"), 2: (4, 4, 9, "High")}


def test_documents_without_an_id_are_kept_apart(spark, tmp_path):
    from zoneflow import schemas

    path = tmp_path / "cameras.json"
    path.write_text(json.dumps([CAMERA, {**CAMERA, "id": None, "name": "lost"}]))
    assert readers.read_cameras(spark, str(path)).count() == 1
    lost = readers.rejected_documents(spark, str(path), schemas.CAMERA_DOCUMENT)
    assert [r.name for r in lost.collect()] == ["lost"]


def test_null_source_asks_for_the_current_one(spark):
    state = spark.createDataFrame([(1, "cam", 5, 20, 6, 9, 100)],
                                  "service long, source string, current_count long, total_count long, "
                                  "smoothed_count long, frame_id long, updated_ms long")
    asked = spark.createDataFrame([(1, None), (1, "cam "), (1, "other")], "service long, source string")
    got = sorted((r.source, r.current_count, r.final_count, r.frame_id)
                 for r in series.stats_by_source(asked, state).collect())
    assert got == [("cam", 5, 6, 9), ("cam", 5, 6, 9), ("other", 0, 0, 0)]
