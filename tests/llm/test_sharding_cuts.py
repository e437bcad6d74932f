"""Links that sharding cuts where nearly all rows are copies."""

import random

import pytest

from zoneflow.llm import sharding

SCHEMA = "id long, hub string, place long"


def cuts(spark, hubs, shards, rows_per_lot=100, phases=None):
    """Cut links of hubs of these sizes, and the rows of each shard."""
    from pyspark.sql import functions as F

    rows = [(i, f"h{h}") for i, h in enumerate(h for h, n in enumerate(hubs) for _ in range(n))]
    rows = spark.createDataFrame(rows, "id long, hub string").withColumn("place", F.xxhash64("id", "hub"))
    placed, total = sharding.propagate(rows, shards, rows_per_lot, phases)
    placed = placed.cache()
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    counts = [counts.get(s, 0) for s in range(shards)]
    assert sum(counts) == total == sum(hubs) and max(counts) - min(counts) <= 1
    assert placed.select("id").distinct().count() == total
    return sharding.cut_links(placed).first()["cut"]


@pytest.mark.parametrize("singles", [0, 200])
def test_pairs_stay_together_in_full_shards(spark, singles):
    assert cuts(spark, [2] * ((4000 - singles) // 2) + [1] * singles, 20) == 0


def test_no_more_cuts_than_shards(spark):
    assert cuts(spark, [3] * 1000, 8) <= 7


def test_hub_larger_than_a_shard_fills_whole_shards(spark):
    """A third in one hub: only what a full shard cannot hold of it is cut, and no pair is."""
    assert cuts(spark, [1000] + [2] * 500 + [1] * 1000, 30) == 1000 - 100


@pytest.mark.parametrize(("pairs", "left"), [(1900, 0.05), (2000, 0.1)])
def test_full_shards_swap_members(spark, pairs, left):
    """Where nearly all rows are pairs, or all are, rounds alone leave few links cut."""
    phases = {}
    assert cuts(spark, [2] * pairs + [1] * (4000 - 2 * pairs), 8, phases=phases) == 0
    assert phases["begin"] > 0.8 * pairs and phases["propagated"] < left * pairs
    assert phases["packed"] == 0 and phases["rounds"] >= 2


def test_settled_flows_fit():
    rng = random.Random(5)
    for _ in range(200):
        shards = rng.randint(2, 9)
        calls = {(a, b): rng.randint(1, 300) for a in range(shards) for b in range(shards)
                 if a != b and rng.random() < 0.7}
        spare = [rng.randint(-50, 50) for _ in range(shards)]
        granted = sharding.settled(calls, spare)
        assert all(0 < n <= calls[k] for k, n in granted.items())
        for s in range(shards):
            coming = sum(n for (_, b), n in granted.items() if b == s)
            leaving = sum(n for (a, _), n in granted.items() if a == s)
            assert coming <= max(0, spare[s]) + leaving
    swap = {(0, 1): 70, (1, 0): 50, (2, 0): 9}
    assert sharding.settled(swap, [0, 4, -3]) == {(0, 1): 54, (1, 0): 50}


def sequential(hubs, begin, shards):
    """Label propagation one member at a time, for comparison: members of ``hubs`` (lists), ``begin``
    the shard of each, capacity a like share of all."""
    where = dict(begin)
    load = [0] * shards
    for s in where.values():
        load[s] += 1
    capacity = -(-len(where) // shards)
    for _ in range(20):
        changed = False
        for members in hubs:
            count = {}
            for m in members:
                count[where[m]] = count.get(where[m], 0) + 1
            goal = max(sorted(count), key=lambda s: count[s])
            for m in members:
                if where[m] != goal and load[goal] < capacity:
                    load[where[m]] -= 1
                    load[goal] += 1
                    where[m], changed = goal, True
        if not changed:
            break
    cut = 0
    for members in hubs:
        count = {}
        for m in members:
            count[where[m]] = count.get(where[m], 0) + 1
        cut += len(members) - max(count.values())
    return cut


def test_cuts_no_more_than_sequential_propagation(spark):
    rng = random.Random(9)
    sizes = [rng.choice([2, 2, 3, 5]) for _ in range(500)] + [1] * 300
    phases = {}
    final = cuts(spark, sizes, 6, phases=phases)
    ids, hubs = 0, []
    for n in sizes:
        if n > 1:
            hubs.append(list(range(ids, ids + n)))
        ids += n
    begin = {m: rng.randrange(6) for hub in hubs for m in hub}
    plain = sequential(hubs, begin, 6)
    members = sum(map(len, hubs))
    assert phases["propagated"] <= plain + 0.05 * members and final <= plain
