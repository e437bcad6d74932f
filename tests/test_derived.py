"""The tables that queries derive from the given ones."""

import pytest

from zoneflow.operators import frames
from zoneflow.plans import catalog
from zoneflow.plans.derived import Derived


@pytest.fixture
def derived(spark, tmp_path):
    """Few steps at many cameras: small files, many frames."""
    spark.range(20_000).selectExpr(
        "id event_id", "id % 700 user_id").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(4_000).selectExpr(
        "id l_orderkey", "id % 90 l_suppkey", "id % 70 l_partkey", "1 l_linenumber",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(300_000).selectExpr("id c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    return Derived(spark, str(tmp_path))


@pytest.mark.parametrize("name", ["frames", "frames_big"])
def test_frames_are_known_to_be_many(derived, name):
    """Spark knows no fewer bytes than the rows have, so it does not broadcast them."""
    table = getattr(derived, name)()
    steps = 40 if name == "frames" else 80
    assert table.count() == steps * 500 == table.select("camera_id", "frame_id").distinct().count()
    least = table.agg({"camera_id": "min", "frame_id": "min"}).first()
    assert sorted(least) == [0, 1]
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size > steps * 500 * 16


def test_frame_counts_broadcast_no_frames(derived):
    counts = frames.frame_counts(derived.tracks(), derived.frames(), catalog.SHORT)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["frames", "frames_big"])
def test_frames_are_made_in_more_than_one_task(derived, name):
    """Steps are few, and what Spark puts together in one task would make all frames."""
    tasks = getattr(derived, name)().selectExpr("spark_partition_id() task").distinct().count()
    assert tasks > 1
