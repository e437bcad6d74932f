import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from zoneflow.functions import geometry, risk, rounding, text, values


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_exact_round_and_text_follow_the_binary_value(spark):
    rng = random.Random(3)
    numbers = [0.16725, 0.00125, 0.145, 0.125, 0.375, 0.0, 1.0, 0.99995, 12.345]
    numbers += [round(rng.random(), 5) for _ in range(3000)] + [i / 32 for i in range(64)]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    rows = df.select(
        "v", rounding.exact_round(F.col("v"), 4).alias("r"), rounding.fixed_text(F.col("v"), 2).alias("t"),
        rounding.exact_round(-F.col("v"), 2).alias("n"),
    ).collect()
    for row in rows:
        assert row.r == round(row.v, 4)
        assert row.t == f"{row.v:.2f}"
        assert row.n == round(-row.v, 2)


def test_count_risk_boundaries(spark):
    counts = [74, 75, 129, 130, 179, 180]
    got = column(spark, [(c,) for c in counts], "n int", risk.risk_by_count(F.col("n")))
    assert got == ["Low", "Medium", "Medium", "High", "High", "Critical"]


def test_composite_risk_boundaries(spark):
    rows = [(0.82, 1), (0.8199, 1), (0.62, 1), (0.6199, 1), (0.34, 1), (0.3399, 1), (0.3399, 75)]
    got = column(spark, rows, "s double, n int", risk.composite_risk(F.col("s"), F.col("n")))
    assert got == ["Critical", "High", "High", "Medium", "Medium", "Low", "Medium"]


def test_iou(spark):
    rows = [((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0)), ((0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 20.0, 10.0)),
            ((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 5.0, 5.0))]
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    expr = geometry.iou(geometry.corners(F.col("a")), geometry.corners(F.col("b")))
    assert column(spark, rows, f"a {box}, b {box}", expr) == [50 / 150, 0.0, 0.0]


def test_box_geometry_rounds_half_to_even_and_clamps(spark):
    rows = [(0.5, 1.5, 10.5, 11.5), (-3.0, -2.0, 4.0, 5.0), (20.0, 20.0, 10.0, 30.0)]
    expr = geometry.box_geometry(*[F.col(c) for c in geometry.CORNERS])
    got = [tuple(r) for r in column(spark, rows, "x1 double, y1 double, x2 double, y2 double", expr)]
    assert got == [(0, 2, 10, 10, 5, 7), (0, 0, 4, 5, 2, 2), (20, 20, 0, 10, 20, 25)]


def test_addresses(spark):
    rows = [("rtsp://a",), (" RTSP://a ",), ("HTTPS://a",), ("file.mp4",), ("",), ("0",), (None,)]
    df = spark.createDataFrame(rows, "u string")
    u = F.col("u")
    got = df.select(text.stream_type(u), text.camera_source_type(u), text.is_replayable_file(u)).collect()
    assert [r[0] for r in got] == ["rtsp", "rtsp", "http", None, None, None, None]
    assert [r[1] for r in got] == ["rtsp", "rtsp", "http", "rtsp", "rtsp", "rtsp", "rtsp"]
    assert [r[2] for r in got] == [False, False, False, True, False, False, False]
    with pytest.raises(PySparkException, match="Unsupported stream URL"):
        df.select(text.stream_type(u, strict=True)).collect()


def test_stored_name(spark):
    rows = [("My  Clip one.MP4",), ("dir/a b.c.mov",), ("noext",), (".hidden",), ("tail.",)]
    got = column(spark, rows, "n string", text.stored_name(F.col("n"), F.lit(17)))
    assert got == ["17-my-clip-one.MP4", "17-a-b.c.mov", "17-noext", "17-.hidden", "17-tail."]


def test_the_two_count_orders_differ(spark):
    rows = [(None, 5.0, 3.0), (float("nan"), None, 3.0), (None, float("inf"), None), (2.0, 5.0, 3.0)]
    df = spark.createDataFrame(rows, "current_count double, count double, people_count double")
    row = {c: F.col(c) for c in df.columns}
    got = [tuple(r) for r in df.select(values.live_count(row), values.normalized_count(row)).collect()]
    assert got == [(5.0, 3.0), (3.0, 3.0), (0.0, 0.0), (2.0, 2.0)]


def test_large_numbers_stay_as_they_are(spark):
    from zoneflow.functions.rounding import exact_round

    values = [2.0**52, 1e300, -1e18, 4503599627370.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.r for r in df.select(exact_round(F.col("v"), 2).alias("r")).collect()]
    assert got == values


def test_quick_rounding_equals_the_exact_one(spark):
    rng = random.Random(5)
    numbers = [0.0, -0.0, -1e-9, 2.0**30, 2.0**52, 1e300, float("inf"), float("nan"), None]
    for k in range(2000):
        midpoint = (rng.randrange(200_000) + 0.5) / 1e4
        numbers += [midpoint, midpoint * (1 + rng.choice([-1, 1]) * 2.0 ** -rng.randrange(15, 53)), -midpoint]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    wrong = df.filter(~rounding.exact_round(F.col("v"), 4).eqNullSafe(rounding._exact(F.col("v"), 4)))
    assert wrong.collect() == []
    plan = df.select(rounding.exact_round(F.col("v"), 4))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("rint") < plan.index("transform")
