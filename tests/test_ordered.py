import random

import pytest
from pyspark.sql import functions as F

import naive
from zoneflow.operators import alerts, chains, detections, series
from zoneflow.operators.ordered import with_recent, with_running
from zoneflow.operators.pacing import keep_paced


def test_running_values_cross_spans_and_gaps(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.randrange(10)) for k in "ab" for t in sorted(rng.sample(range(300), 60))]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = with_running(df, ["k"], ["t"], sums={"s": F.col("v")}, previous={"p": F.col("v")}, span=7)
    result = {(r.k, r.t): (r.s, r.p) for r in got.collect()}
    for k in "ab":
        total, before = 0, None
        for _, t, v in [r for r in rows if r[0] == k]:
            total += v
            assert result[(k, t)] == (total, before)
            before = v


@pytest.mark.parametrize("every", [1, 4])
@pytest.mark.parametrize(("span", "group"), [(50, 256), (50, 3), (13, 5), (173, 2), (100_000, 256)])
def test_pacing_equals_the_sequential_rule(spark, monkeypatch, every, span, group):
    monkeypatch.setattr(chains, "GROUP", group)  # few, so that summaries are composed several times
    rng = random.Random(every * span)
    rows = []
    for key, step in (("dense", 3), ("sparse", 90), ("mixed", 25)):
        t = 0
        for i in range(250):
            t += rng.randrange(0 if every > 1 else 1, 2 * step)
            rows.append((key, t, i))
    df = spark.createDataFrame(rows, "k string, t long, i long").repartition(5)
    got = keep_paced(df, ["k"], "t", ["i"], interval=40, every=every, span=span, index="n")
    result = {}
    for r in sorted(got.collect(), key=lambda r: (r.k, r.n)):
        result.setdefault(r.k, []).append(r.i)
    for key in ("dense", "sparse", "mixed"):
        mine = [r for r in rows if r[0] == key]
        assert result[key] == [mine[p][2] for p in naive.paced([r[1] for r in mine], 40, every)]


def alert_rows(spark, times):
    rows = [(f"a{t}", 1, t * 1000, "spike", "m", "Low", 9) for t in times]
    return spark.createDataFrame(
        rows, "alert_id string, camera_id long, created_ms long, type string, message string, "
        "risk string, count long"
    )


def test_a_dropped_repeat_does_not_extend_the_window(spark):
    kept = alerts.suppress_repeats(alert_rows(spark, [0, 10, 15, 20, 31])).collect()
    assert sorted(r.created_ms // 1000 for r in kept) == [0, 15, 31]


def test_equal_times_keep_the_first_by_tie(spark):
    rows = alert_rows(spark, [5]).unionByName(
        alert_rows(spark, [5]).withColumn("alert_id", F.lit("a0"))
    )
    assert [r.alert_id for r in alerts.suppress_repeats(rows).collect()] == ["a0"]


def test_one_key_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 5).alias("t"))
    kept = keep_paced(df, ["k"], "t", interval=15, span=1500)
    assert kept.count() == len(naive.paced([i * 5 for i in range(20_000)], 15))


def test_ten_thousand_spans_of_one_key(spark):
    """Summaries are composed over two levels; no task holds more than a group of them."""
    df = spark.range(30_000).select(F.lit(1).alias("k"), (F.col("id") * 7).alias("t"))
    kept = keep_paced(df, ["k"], "t", interval=15, every=2, span=21, index="n")
    expected = naive.paced([i * 7 for i in range(30_000)], 15, 2)
    got = sorted((r["n"], r["t"] // 7) for r in kept.collect())
    assert got == list(enumerate(expected, 1))


def test_every_fourth(spark):
    df = spark.createDataFrame([(1, i) for i in range(1, 10)], "camera_id long, frame_id long")
    got = sorted((r.frame_id, r.sample_id) for r in detections.sample_every(df, 4, span=3).collect())
    assert got == [(4, 1), (8, 2)]


def test_consecutive_dedup(spark):
    signs = [(1, "a"), (1, "a"), (0, None), (1, "a"), (0, "b"), (None, "b"), (2, None), (2, "")]
    rows = [(1, i, f, u) for i, (f, u) in enumerate(signs)]
    df = spark.createDataFrame(rows, "camera_id long, seq long, frame_id long, updated_at string")
    got = sorted(r.seq for r in detections.dedup_consecutive(df, span=3).collect())
    assert got == [0, 2, 3, 4, 6]


def test_arrivals(spark):
    rows = [("s", i + 1, n) for i, n in enumerate([3, 5, 2, 4, -1, None, 1])]
    df = spark.createDataFrame(rows, "source string, frame_id long, current_count long")
    got = sorted((r.frame_id, r.total_count) for r in series.running_arrivals(df, span=2).collect())
    assert [t for _, t in got] == [3, 5, 5, 7, 7, 7, 8]


def test_counters_restart_with_the_source(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 3), ("a", 5), ("b", 2), ("a", 4), ("a", 6)])]
    df = spark.createDataFrame(rows, "frame_id long, source string, current_count long")
    got = sorted((r.frame_id, r.run_id, r.total_count)
                 for r in series.reset_on_source_change(df, span=2).collect())
    assert got == [(0, 1, 3), (1, 1, 5), (2, 2, 2), (3, 3, 4), (4, 3, 6)]


def test_recent_values_cross_short_spans(spark):
    times = [1, 2, 3, 40, 41, 90, 91, 92, 200]
    df = spark.createDataFrame([("a", t, t * 2) for t in times], "k string, t long, v long")
    got = {r.t: r.last for r in with_recent(df, ["k"], ["t"], "last", F.col("v"), 4, span=10).collect()}
    for i, t in enumerate(times):
        assert got[t] == [x * 2 for x in times[max(0, i - 3):i + 1]]


def test_arrivals_read_their_input_twice_at_most(spark, tmp_path):
    import random as rnd

    from zoneflow.operators import series

    rng = rnd.Random(6)
    rows = [(i % 2, f"s{rng.randrange(3)}", i, rng.randrange(-2, 9)) for i in range(300)]
    path = str(tmp_path / "series")
    spark.createDataFrame(rows, "service long, source string, frame_id long, current_count long").write.parquet(path)
    df = spark.read.parquet(path)
    for result in (series.running_arrivals(df, ["service"], span=7),
                   series.reset_on_source_change(df, ["service"], span=7)):
        plan = result._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") <= 2
    got = {r.frame_id: (r.run_id, r.total_count)
           for r in series.reset_on_source_change(df, ["service"], span=7).collect()}
    for service in (0, 1):
        run = total = last = 0
        before = None
        for s, source, frame, count in rows:
            if s != service:
                continue
            if source != before:
                run, total, last, before = run + 1, 0, 0, source
            count = max(count, 0)
            total, last = total + max(count - last, 0), count
            assert got[frame] == (run, total)


def test_running_values_sort_their_rows_once(spark):
    """Values within spans come before the join with those of earlier spans, in the order that it wants."""
    df = spark.range(100).selectExpr("id % 3 k", "id n", "id % 7 v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_running(df, ["k"], ["n"], sums={"s": F.col("v")}, previous={"p": F.col("v")}, span=8)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = {r.n: (r.s, r.p) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("SortMergeJoin") < plan.index("sum(v#")  # the join reads what the window gives
    for n in range(100):
        before = range(n % 3, n + 1, 3)
        assert rows[n] == (sum(i % 7 for i in before), (n - 3) % 7 if n >= 3 else None)
