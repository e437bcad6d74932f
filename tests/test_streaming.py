import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from test_detections import crowd
from zoneflow.operators import alerts, detections, frames, series, tracking
from zoneflow.params import Params
from zoneflow.schemas import FRAME_STREAM
from zoneflow.sources import readers, sinks
from zoneflow.streaming import jobs, processors, tables

FIELDS = ("user_id", "camera_id", "frame_id", "current_count", "zone_left", "zone_center", "zone_right",
          "line_entry", "line_exit", "total_count", "last_count", "base_count", "density_score",
          "movement_score", "congestion_score", "risk_score", "risk", "active_track_ids",
          "density_count", "predicted_crowd", "final_count")
DENSE = 3  # low, so that the small crowd has dense frames


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """A folder with one file per few frames, and the same frames as a table."""
    folder = str(tmp_path_factory.mktemp("frames"))
    boxes = {}
    for c, f, i, *box, s in crowd(seed=11, frames=80, people=5):
        boxes.setdefault((c, f), []).append((i, 0, *map(float, box), s))
    rows = [(c % 2, c, f, f * 1000, 1280, 720, boxes.get((c, f), []), f % 50 if f % 3 else None,
             f / 2 if f % 4 else None) for c in (1, 2) for f in range(1, 81)]
    table = spark.createDataFrame(rows, FRAME_STREAM).cache()
    for start in range(1, 81, 16):
        part = table.filter(F.col("frame_id").between(start, start + 15)).orderBy(F.rand(3))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder, table


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def to_folder(stream, tmp_path, name):
    path = str(tmp_path / name)
    drain(sinks.write_results(stream, path, str(tmp_path / f"{name}-checkpoint")))
    return path


def values(df):
    return sorted(tuple(str(r[c]) for c in FIELDS) for r in df.select(*FIELDS).collect())


def batch_metrics(table):
    clean = detections.nms_frames(table)
    rows = clean.select("camera_id", "frame_id", F.inline("detections"))
    tracks = tracking.confirmed_tracks(tracking.track(rows, Params(frames_per_span=32), warm_up=20))
    spine = table.drop("detections")
    return frames.frame_metrics(tracks, spine, Params(frames_per_span=32, dense_count=DENSE))


def test_camera_stream_equals_batch(spark, replay, tmp_path):
    folder, table = replay
    stream = readers.read_detections_stream(spark, folder, files_per_batch=1)
    results = frames.with_results(
        processors.camera_processor(stream, Params(dense_count=DENSE), delay="0 seconds"),
        Params(dense_count=DENSE))
    path = to_folder(results, tmp_path, "results")
    got = spark.read.parquet(path)
    assert got.select("batch").distinct().count() > 1
    expected = values(batch_metrics(table))
    assert values(got) == expected and any(r[3] != "0" for r in expected)
    last = got.filter("camera_id = 1 and frame_id = 80").first()
    assert 0 < len(last.heatmap_points) <= 250


def shuffled_files(df, folder, last):
    """Rows of one key spread over the micro-batches, then one late row that moves the watermark on."""
    for i in range(4):
        df.filter(F.pmod(F.xxhash64(*df.columns[:3]), F.lit(4)) == i).coalesce(1).write.mode(
            "append").parquet(folder)
    last.coalesce(1).write.mode("append").parquet(folder)


def test_rows_shuffled_across_batches(spark, replay, tmp_path):
    """Frames, alerts and counts in any micro-batch within the delay give the batch result."""
    _, table = replay
    far = 10_000_000
    folder = str(tmp_path / "frames")
    end = spark.createDataFrame([(9, 9, 1, far, 1280, 720, [], None, None)], FRAME_STREAM)
    shuffled_files(table, folder, end)
    stream = readers.read_detections_stream(spark, folder, files_per_batch=1)
    results = frames.with_results(
        processors.camera_processor(stream, Params(dense_count=DENSE), delay="2 minutes"),
        Params(dense_count=DENSE))
    path = to_folder(results, tmp_path, "frames-out")
    assert values(spark.read.parquet(path).filter("camera_id < 9")) == values(batch_metrics(table))

    alert_rows = [(f"a{i:03}", i % 2, 1000 + 700 * i, "spike", "m", "Low", 9) for i in range(150)]
    schema = ("alert_id string, camera_id long, created_ms long, type string, message string, "
              "risk string, count long")
    df = spark.createDataFrame(alert_rows, schema)
    folder = str(tmp_path / "alerts")
    shuffled_files(df, folder, spark.createDataFrame([("end", 9, far, "x", "m", "Low", None)], schema))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path = to_folder(processors.suppress_stream(stream, delay="5 minutes"), tmp_path, "alerts-out")
    got = {r.alert_id for r in spark.read.parquet(path).collect()} - {"end"}
    assert got == {r.alert_id for r in alerts.suppress_repeats(df, span_ms=60_000).collect()}

    schema = "source string, frame_id long, current_count long, updated_ms long"
    counts = [(f"s{i % 2}", i, (i * 7) % 11 - 1, 1000 + i) for i in range(120)]
    df = spark.createDataFrame(counts, schema)
    folder = str(tmp_path / "counts")
    shuffled_files(df, folder, spark.createDataFrame([("end", 1, None, far)], schema))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path = to_folder(processors.count_stream(stream, delay="1 minute"), tmp_path, "counts-out")
    names = ("source", "frame_id", "current_count", "total_count")
    got = {tuple(r) for r in spark.read.parquet(path).filter("source <> 'end'").select(*names).collect()}
    assert got == {tuple(r) for r in series.running_arrivals(df).select(*names).collect()}


def test_late_frames_are_dropped(spark, replay, tmp_path):
    _, table = replay
    folder = str(tmp_path / "in")
    table.filter("frame_id between 1 and 10").coalesce(1).write.mode("append").parquet(folder)
    table.filter("frame_id between 8 and 12").coalesce(1).write.mode("append").parquet(folder)
    stream = readers.read_detections_stream(spark, folder, files_per_batch=1)
    path = to_folder(processors.camera_processor(stream, delay="0 seconds"), tmp_path, "results")
    got = spark.read.parquet(path).groupBy("camera_id").agg(F.count("*"), F.count_distinct("frame_id"))
    assert {tuple(r)[1:] for r in got.collect()} == {(12, 12)}


def test_suppression_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    times = sorted(rng.sample(range(1, 4000), 700))
    rows = [(f"a{t}", t % 3, t * 100, "spike", f"m{t % 2}", "Low", 9) for t in times]
    schema = ("alert_id string, camera_id long, created_ms long, type string, message string, "
              "risk string, count long")
    df = spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "in")
    for i in range(4):
        part = df.filter(F.col("created_ms").between(i * 100_000, i * 100_000 + 99_999))
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path = to_folder(processors.suppress_stream(stream, delay="0 seconds"), tmp_path, "out")
    got = {r.alert_id for r in spark.read.parquet(path).collect()}
    assert got == {r.alert_id for r in alerts.suppress_repeats(df, span_ms=60_000).collect()}
    assert 0 < len(got) < len(rows)


def test_count_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"s{i % 3}", i, rng.randrange(-3, 20), 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, frame_id long, current_count long, updated_ms long")
    folder = str(tmp_path / "in")
    for i in range(3):
        df.filter(F.floor(F.col("frame_id") / 100) == i).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path = to_folder(processors.count_stream(stream, delay="0 seconds"), tmp_path, "out")
    names = ("source", "frame_id", "current_count", "total_count")
    got = {tuple(r) for r in spark.read.parquet(path).select(*names).collect()}
    assert got == {tuple(r) for r in series.running_arrivals(df).select(*names).collect()}


def test_latest_table_and_dashboard(spark, replay, tmp_path):
    """After each batch the sums of the tenants are those of all their cameras."""
    folder, table = replay
    cameras = spark.createDataFrame(
        [(1, 1, "running"), (2, 0, "running"), (3, 1, "stopped"), (4, 7, "running")],
        "camera_id long, user_id long, status string")
    stream = readers.read_detections_stream(spark, folder, files_per_batch=2)
    results = frames.with_results(
        processors.camera_processor(stream, Params(dense_count=DENSE), delay="0 seconds"),
        Params(dense_count=DENSE))
    latest, summary = str(tmp_path / "latest"), str(tmp_path / "summary")
    drain(tables.dashboard_stream(results, cameras, latest, summary, str(tmp_path / "c"), buckets=4))
    current = {r.camera_id: r for r in tables.read_keyed(spark, latest).collect()}
    expected = {r.camera_id: r for r in frames.latest_per_camera(batch_metrics(table)).collect()}
    for camera in (1, 2):
        assert (current[camera].frame_id, current[camera].total_count) == (80, expected[camera].total_count)
    got = {r.user_id: (r.total_zones, r.active_zones, r.total_count)
           for r in tables.read_keyed(spark, summary).collect()}
    assert got == {1: (2, 1, expected[1].current_count), 0: (1, 1, expected[2].current_count), 7: (1, 1, 0)}


def test_fanout_has_a_folder_per_tenant(spark, replay, tmp_path):
    folder, _ = replay
    stream = readers.read_detections_stream(spark, folder).select("user_id", "camera_id", "frame_id")
    path = tmp_path / "channel"
    drain(sinks.fanout_by_tenant(stream, str(path), str(tmp_path / "c")))
    assert sorted(p.name for p in path.glob("user_id=*")) == ["user_id=0", "user_id=1"]
    assert spark.read.parquet(str(path)).count() == 160


def test_messages_become_frames(spark):
    text = '{"camera_id":1,"frame_id":2,"detections":[{"x1":1.5,"confidence":0.5}]}'
    df = spark.createDataFrame([(text,)], "value string")
    row = readers.parse_frames(df).first()
    assert (row.camera_id, row.frame_id, row.detections[0].x1) == (1, 2, 1.5)


def in_files(df, folder, parts):
    """One file per filter, written one after the other."""
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


STRANGER = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {entry!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").getOrCreate())
rows = module.queries()["suppress_stream"](spark, {data!r})
assert rows.count() > 100
print("fine")
"""


def test_streams_run_in_a_strange_session_and_folder(tmp_path):
    """Without the package on the path of the driver's worker, and with Spark's own state store."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no data")
    code = STRANGER.format(entry=os.path.join(here, "__spark_entry__.py"), data=data)
    (tmp_path / "run.py").write_text(code)
    clean = {k: v for k, v in os.environ.items() if not k.startswith("PYTHONPATH")}
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=clean, capture_output=True, timeout=600)
    assert done.returncode == 0 and b"fine" in done.stdout, done.stderr[-3000:]


def test_kept_and_late_rows_are_the_input(spark, tmp_path):
    schema = "source string, frame_id long, current_count long, updated_ms long, _own string"
    rows = [(f"s{i % 2}", i, i % 9, 1000 * i, f"r{i}") for i in range(1, 101)]
    rows += [("s0", 200, 5, None, "none")]
    df = spark.createDataFrame(rows, schema)
    order = [F.col("frame_id").between(1, 40), F.col("frame_id").between(61, 100),
             F.col("frame_id").between(41, 60) | (F.col("frame_id") == 200)]
    stream = in_files(df, str(tmp_path / "in"), order)
    out = processors.count_stream(stream, delay="10 seconds", late="why")
    path = to_folder(out, tmp_path, "out")
    got = sinks.read_results(spark, path).collect()
    late = {r["frame_id"] for r in got if r["why"] is not None}
    kept = {r["frame_id"] for r in got if r["why"] is None}
    # Rows beyond the last watermark still wait; all others are either handled or given out as late.
    assert late == set(range(41, 61)) | {200} and kept == set(range(1, 41)) | set(range(61, 91))
    assert all(r["_own"] == f"r{r['frame_id']}" for r in got if r["frame_id"] < 200)
    assert all((r["total_count"] is None) == (r["why"] is not None) for r in got)


def test_late_and_repeated_frames_are_given_out(spark, replay, tmp_path):
    _, table = replay
    folder = str(tmp_path / "in")
    parts = [F.col("frame_id").between(1, 30), F.col("frame_id").between(51, 80), F.col("frame_id").between(26, 50)]
    in_files(table, folder, parts)
    wrong = table.filter("frame_id = 80").withColumn("ts_ms", F.lit(80_500).cast("long")).withColumn(
        "frame_id", F.lit(7).cast("long"))  # a later time with a number that has been
    end = table.filter("frame_id = 80").withColumn("ts_ms", F.lit(10**9).cast("long")).withColumn(
        "frame_id", F.lit(1000).cast("long"))
    wrong.unionByName(end).coalesce(1).write.mode("append").parquet(folder)
    stream = readers.read_detections_stream(spark, folder, files_per_batch=1)
    out = processors.camera_processor(stream, delay="2 seconds", late="why")
    got = sinks.read_results(spark, to_folder(out, tmp_path, "out")).filter("frame_id < 1000")
    by = {r["why"]: r["n"] for r in got.groupBy("why").agg(F.count("*").alias("n")).collect()}
    assert sum(by.values()) == 2 * (30 + 30 + 25 + 1)
    assert by[processors.REPEATED] == 2 and by["late"] >= 2 * 20
    assert got.filter("why is not null and current_count is not null").count() == 0


def test_sampling_in_the_camera_state(spark, replay, tmp_path):
    """The camera stream with sampling is the plain one over the frames that the batch sampler keeps."""
    folder, table = replay
    params = Params(dense_count=DENSE, frame_skip=2, target_fps=0.6)
    stream = readers.read_detections_stream(spark, folder, files_per_batch=2)
    out = processors.camera_processor(stream, params, delay="0 seconds", sample=True)
    got = sinks.read_results(spark, to_folder(out, tmp_path, "out"))
    kept = detections.sample_frames(table, params, span=20_000).withColumn("frame_id", F.col("sample_id")).drop("sample_id")
    clean = detections.nms_frames(kept)
    rows = clean.select("camera_id", "frame_id", F.inline("detections"))
    tracks = tracking.confirmed_tracks(tracking.track(rows, Params(frames_per_span=32), warm_up=20))
    batch = frames.frame_counts(tracks, kept.drop("detections"), Params(frames_per_span=32))
    columns = ("camera_id", "frame_id", "ts_ms", "current_count", "zone_left")
    expected = sorted(tuple(r) for r in batch.select(*columns).collect())
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == expected and 20 < len(expected) < 100


def test_a_stop_clears_what_was_accepted(spark, tmp_path):
    rng = random.Random(12)
    schema = ("alert_id string, camera_id long, created_ms long, type string, message string, "
              "risk string, count long")
    rows = [(f"a{i:03}", i % 3, 1000 + 500 * i, "spike", f"m{i % 2}", "Low", 9) for i in range(300)]
    stops = [(rng.randrange(3), 1000 + 500 * rng.randrange(300)) for _ in range(15)] + [(0, 1000 + 500 * 30)]
    df, resets = spark.createDataFrame(rows, schema), spark.createDataFrame(stops, "camera_id long, created_ms long")
    parts = [F.pmod(F.xxhash64("created_ms"), F.lit(3)) == k for k in range(3)]
    end = spark.createDataFrame([("end", 9, 10**9, "x", "m", "Low", None)], schema)
    alerts_in = in_files(df.unionByName(end), str(tmp_path / "a"), [*(p & (F.col("camera_id") < 9) for p in parts),
                                                                   F.col("camera_id") == 9])
    far = spark.createDataFrame([(9, 10**9)], resets.schema)
    resets_in = in_files(resets.unionByName(far), str(tmp_path / "r"), [*(p & (F.col("camera_id") < 9) for p in parts),
                                                                       F.col("camera_id") == 9])
    out = processors.suppress_stream(alerts_in, delay="5 minutes", resets=resets_in)
    got = {r.alert_id for r in sinks.read_results(spark, to_folder(out, tmp_path, "out")).collect()} - {"end"}
    expected = {r.alert_id for r in alerts.suppress_repeats(df, span_ms=60_000, resets=resets).collect()}
    assert got == expected
    assert expected != {r.alert_id for r in alerts.suppress_repeats(df, span_ms=60_000).collect()}


def test_jobs_that_never_finish_are_given_out_once(spark, tmp_path):
    schema = "job_id string, status string, ts_ms long, seq long"
    day = jobs.DAY_MS
    rows = [("a", "processing_started", 1, 1), ("a", "completed", 50, 2), ("a", "processing_started", 90, 3),
            ("b", "processing_started", 10, 4), ("c", "processing_started", 20, 5), ("c", "failed", day * 5, 6),
            ("z", "processing_started", 9 * day, 7), ("z", "completed", 20 * day, 8)]
    df = spark.createDataFrame(rows, schema)
    stream = in_files(df, str(tmp_path / "in"), [F.col("seq") < 6, F.col("seq") == 7, F.col("seq") == 6, F.col("seq") == 8])
    out = jobs.job_ledger_stream(stream, overdue_ms=2 * day, keep_ms=8 * day, delay="5 days", late="why")
    got = sinks.read_results(spark, to_folder(out, tmp_path, "out")).collect()
    seen = sorted((r["job_id"], r["change"], r["status"], r["overdue"]) for r in got if r["why"] is None)
    assert [s for s in seen if s[0] == "a"] == [("a", 1, "processing_started", False), ("a", 2, "completed", False)]
    assert [s for s in seen if s[0] == "b"] == [("b", 1, "processing_started", False), ("b", 2, "processing_started", True)]
    last = [s for s in seen if s[0] == "c"][-1]
    assert last[2] == "failed" or last[3]


def written_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("camera_id"), F.lit(1).alias("frame_id"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("text"))
    path = str(tmp_path / "table")
    table = tables.KeyedTable(spark, path, ["camera_id"], [F.desc("frame_id")], buckets=50)
    table.apply(rows, 0)
    whole = written_bytes(path)
    new = rows.filter("camera_id in (3, 4)").withColumn("frame_id", F.lit(2))
    change = table.apply(new, 1)
    assert written_bytes(path) - whole < 0.1 * whole
    assert sorted(r["frame_id"] for r in change.before.collect()) == [1, 1]
    assert sorted(r["frame_id"] for r in change.after.collect()) == [2, 2]
    now = tables.read_keyed(spark, path)
    assert now.count() == 20_000 and now.filter("frame_id = 2").count() == 2
    again = table.apply(new, 1)  # repeated after a failure: the same change, nothing written
    assert written_bytes(path) - whole < 0.1 * whole
    assert [r["frame_id"] for r in again.before.collect()] == [1, 1]
    old = rows.filter("camera_id = 3").withColumn("frame_id", F.lit(0))
    table.apply(old, 2)
    assert tables.read_keyed(spark, path).filter("camera_id = 3").first()["frame_id"] == 2
    for k in range(3, 9):
        table.apply(new.withColumn("frame_id", F.lit(k)), k)
    assert tables.read_keyed(spark, path).count() == 20_000
    assert not os.path.exists(f"{path}/batch-3") and os.path.exists(f"{path}/batch-0")


def test_a_reader_sees_all_of_a_batch_or_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    table = tables.KeyedTable(spark, path, ["k"], [F.desc("v")], keep=2, buckets=4)
    table.apply(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k long, v long"), 0)
    broken = spark.createDataFrame([(1, 5), (2, 0)], "k long, v long").withColumn(
        "v", F.when(F.col("v") == 0, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="no"):
        table.apply(broken, 1)
    assert sorted(map(tuple, tables.read_keyed(spark, path).collect())) == [(1, 1), (1, 2), (2, 1)]
    table.apply(spark.createDataFrame([(1, 5), (2, 3)], "k long, v long"), 1)
    assert sorted(map(tuple, tables.read_keyed(spark, path).collect())) == [(1, 2), (1, 5), (2, 1), (2, 3)]


def test_results_of_a_failed_batch_are_not_seen(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 4) for i in range(12)], "id long, part long")
    stream = in_files(df, str(tmp_path / "in"), [F.col("part") == k for k in range(3)])
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    flag = tmp_path / "broken"
    flag.write_text("")

    @F.udf("long")
    def fragile(i):
        if i == 6 and os.path.exists(str(flag)):
            raise ValueError("half-way")
        return i

    failing = stream.withColumn("id", fragile("id"))
    with pytest.raises(Exception, match="half-way"):
        drain(sinks.write_results(failing, path, state))
    assert sorted(r["id"] for r in sinks.read_results(spark, path).collect()) == [0, 1, 2, 3]
    flag.unlink()
    drain(sinks.write_results(failing, path, state))
    assert sorted(r["id"] for r in sinks.read_results(spark, path).collect()) == list(range(12))
    assert sinks.read_results(spark, str(tmp_path / "none")) is None


def test_newest_alerts_of_all_and_of_each_tenant(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"a{i}", rng.randrange(5), rng.randrange(500), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "alert_id string, user_id long, created_ms long, part long")
    params = Params(alerts_kept=30, alerts_per_user=7)
    parts = [F.col("part") == k for k in range(3)]
    log, mine = str(tmp_path / "log"), str(tmp_path / "mine")
    drain(tables.alert_log_table(in_files(df, str(tmp_path / "in"), parts), log, str(tmp_path / "c1"), params))
    drain(tables.tenant_alerts_table(in_files(df, str(tmp_path / "in2"), parts), mine, str(tmp_path / "c2"), params, 3))
    got = {r.alert_id for r in tables.read_keyed(spark, log).collect()}
    assert got == {r.alert_id for r in alerts.append_alerts(df.limit(0), df, params).collect()} and len(got) == 30
    got = {r.alert_id for r in tables.read_keyed(spark, mine).collect()}
    assert got == {r.alert_id for r in alerts.alerts_for_tenant(df, params).collect()} and len(got) == 35
