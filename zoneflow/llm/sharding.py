"""Shards by balanced label propagation.

Documents are linked through hubs: here the digest of their text, so that copies are neighbours. Hubs
larger than a shard fill whole shards first. Every other document begins in a shard that its id names.
In each round a hub votes for the shard that holds most of its members, and members elsewhere ask to
move there. How many may is settled for each pair of shards: full shards swap as many as both have for
each other, and spare room is shared among the others. Rounds go on while they lower
the number of cut links. Hubs that are still cut are laid side by side over the room that whole hubs
leave. In the end documents without links, which may go anywhere, level the counts to at most one apart.

Nothing is ordered or numbered in one task: ranks are taken inside lots of a bounded number of rows,
and lots are added up by groups of lots. What comes to the driver is a number per pair of shards.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoneflow.session import materialize, release

LEAST_GAIN = 0.01  # share of the cut links a round has to join for another one to follow
ROWS_PER_LOT = 2_000
LOTS_PER_GROUP = 1_000


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shard_documents(
    docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text",
    rows_per_lot: int = ROWS_PER_LOT,
) -> DataFrame:
    """One row per input row: the id, ``size`` (bytes of the text and 16), ``text_crc32``, ``law``
    (``rows``: counts are at most one apart), ``shard`` and ``slot`` (from 0 without gaps in each
    shard).

    A null text counts as empty. Ids may be null or repeat. With the same rows the result is the same;
    rows equal in id and text may change places. Other columns are not read; an empty table gives an
    empty result.
    """
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(_text(text_column)) + 16).cast("long").alias("size"),
        F.crc32(_text(text_column)).alias("text_crc32"),
        F.sha2(_text(text_column), 256).alias("hub"),
    ).select("*", F.xxhash64("id", "hub").alias("place"))
    rows = materialize(rows)
    placed, total = propagate(rows, shards, rows_per_lot)
    slotted = _ranked(placed, ["shard"], -(-total // (shards * rows_per_lot)))
    slotted = slotted.withColumnRenamed("rank", "slot")
    return slotted.select(
        F.col("id").alias(id_column), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        "slot",
    )


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: members of hubs that are not in the shard which holds most of their hub."""
    inside = placed.groupBy("hub", "shard").count().groupBy("hub").agg(
        F.sum("count").alias("all"), F.max("count").alias("most")
    )
    return inside.agg(F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("cut"))


def propagate(
    rows: DataFrame, shards: int, rows_per_lot: int = ROWS_PER_LOT, phases: dict[str, int] | None = None
) -> tuple[DataFrame, int]:
    """``rows`` (id, hub, place, ...) with ``shard``, and their number; shards differ by one row at
    most. Rounds end when one joins less than ``LEAST_GAIN`` of the cut links. ``phases`` receives the
    links cut at the beginning, after the rounds, and in the end, and the number of rounds."""
    total = rows.count()
    capacity, extra = divmod(total, shards)
    linked_hubs = rows.groupBy("hub").agg(F.count("*").alias("members")).filter("members > 1")
    # Written tables: Spark can then split a hub that many rows share when it joins.
    linked_hubs = materialize(linked_hubs)
    room = [capacity + (s < extra) for s in range(shards)]
    # Hubs that no shard holds, which are fewer than shards, come first and fill as few as they can.
    large = linked_hubs.filter(F.col("members") > capacity).collect()
    filled = materialize(_in_pieces(rows, large, room, rows_per_lot)) if large else None
    small_hubs = linked_hubs.filter(F.col("members") <= capacity)
    at = F.pmod(F.col("place"), F.lit(max(1, sum(room))))
    begin = _shard_at(_ends(room), at).alias("shard")
    linked = materialize(rows.join(small_hubs, "hub", "left_semi").select("*", begin))
    rounds, before = 0, None
    while True:
        asked = materialize(_asked(linked))
        calls = {(r["shard"], r["goal"]): r["count"] for r in
                 asked.filter("shard <> goal").groupBy("shard", "goal").count().collect()}
        cut = sum(calls.values())
        if phases is not None:
            phases.setdefault("begin", cut)
            phases["rounds"], phases["propagated"] = rounds, cut
        if not cut or before is not None and before - cut < LEAST_GAIN * before:
            release(asked)
            break
        there = _counts(asked, "shard")
        granted = settled(calls, [n - there.get(s, 0) for s, n in enumerate(room)])
        moved = materialize(_moved(asked, granted, calls, shards, rows_per_lot))
        release(linked, asked)
        linked, before, rounds = moved, cut, rounds + 1
    kept = materialize(_packed(linked, room, total, rows_per_lot))
    if phases is not None:
        phases["packed"] = cut_links(kept).first()["cut"]
    held = _counts(kept, "shard")
    ends = _ends([n - held.get(s, 0) for s, n in enumerate(room)])
    free = rows.join(linked_hubs, "hub", "left_anti")
    levelled = _ranked(free, [], max(1, -(-total // rows_per_lot))).withColumn(
        "shard", _shard_at(ends, F.col("rank"))
    ).drop("rank")
    placed = kept.unionByName(levelled)
    return placed if filled is None else placed.unionByName(filled), total


def settled(calls: dict[tuple[int, int], int], spare: list[int]) -> dict[tuple[int, int], int]:
    """How many of the members that ask to go from one shard to another may.

    Two shards swap as many as both have for each other. What is left may go where there is ``spare``
    room (negative: too many rows), each origin by its share. So no shard that has room gets too full,
    and none that is full gets fuller.
    """
    swapped = {(a, b): min(n, calls.get((b, a), 0)) for (a, b), n in calls.items()}
    rest = {pair: n - swapped[pair] for pair, n in calls.items()}
    coming: dict[int, int] = {}
    for (_, b), n in rest.items():
        coming[b] = coming.get(b, 0) + n
    granted = {}
    for (a, b), n in rest.items():
        limit = max(0, spare[b])
        granted[a, b] = swapped[a, b] + (n if coming[b] <= limit else n * limit // coming[b])
    return {pair: n for pair, n in granted.items() if n}


def _ends(room: list[int]) -> list[int]:
    """Where the room of each shard ends when that of all is laid in a row."""
    return list(accumulate(room))


def _shard_at(ends: list[int], at: Column) -> Column:
    ends = F.array(*[F.lit(end).cast("long") for end in ends])
    return F.size(F.filter(ends, lambda e: e <= at)).cast("int")


def _packed(linked: DataFrame, room: list[int], total: int, rows_per_lot: int) -> DataFrame:
    """``linked`` with shards that hold whole hubs as far as any can.

    Hubs that rounds brought together stay where they fit. The others are laid side by side over the
    room left, so at most one in a shard passes its end; those few are planned one by one.
    """
    columns = linked.columns
    hubs = materialize(linked.groupBy("hub").agg(
        F.count("*").alias("members"), F.min("shard").alias("shard"), F.max("shard").alias("high")
    ))
    lots = max(1, -(-total // rows_per_lot))
    whole = _offsets(hubs.filter("shard = high"), ["shard"], -(-lots // len(room)))
    goal = F.element_at(F.array(*[F.lit(n).cast("long") for n in room]), F.col("shard") + 1)
    stay = materialize(
        whole.filter(F.col("offset") + F.col("members") <= goal).select("hub", "shard", "members")
    )
    left = _less(room, stay)
    ends = _ends(left)
    laid = materialize(
        _offsets(hubs.join(stay, "hub", "left_anti").drop("shard", "high"), [], lots)
        .withColumn("shard", _shard_at(ends, F.col("offset")))
        .withColumn("last", _shard_at(ends, F.col("offset") + F.col("members") - 1))
    )
    inside = laid.filter("shard = last").select("hub", "shard", "members")
    left = _less(left, inside)
    across = laid.filter("shard < last").select("hub", "members").collect()  # fewer than shards
    named = linked.drop("shard").join(
        materialize(stay.union(inside).select("hub", "shard")), "hub"
    ).select(*columns)
    if not across:
        return named
    return named.unionByName(_in_pieces(linked.drop("shard"), across, left, rows_per_lot))


def _less(room: list[int], hubs: DataFrame) -> list[int]:
    """Room that is left beside ``hubs``: one number per shard comes to the driver."""
    held = {r["shard"]: r["n"] for r in hubs.groupBy("shard").agg(F.sum("members").alias("n")).collect()}
    return [n - held.get(s, 0) for s, n in enumerate(room)]


def _in_pieces(
    rows: DataFrame, hubs: list[Row], room: list[int], rows_per_lot: int
) -> DataFrame:
    """Rows of ``hubs``, at most about one per shard, with their shard. ``room`` is lessened.

    The largest come first. Each takes the least room that holds it whole, and where there is none the
    largest whole, then goes on with its rest.
    """
    shard = F.lit(None).cast("int")
    for hub in sorted(hubs, key=lambda h: (-h["members"], h["hub"])):
        rest, taken, ends = hub["members"], [], []
        while rest:
            fits = [s for s, n in enumerate(room) if n >= rest]
            best = min(fits, key=lambda s: (room[s], s)) if fits else room.index(max(room))
            n = min(rest, room[best])
            room[best] -= n
            rest -= n
            taken.append(best)
            ends.append(hub["members"] - rest)
        piece = F.element_at(F.array(*map(F.lit, taken)), _shard_at(ends, F.col("rank")) + 1)
        shard = F.when(F.col("hub") == hub["hub"], piece).otherwise(shard)
    chosen = rows.filter(F.col("hub").isin([h["hub"] for h in hubs]))
    lots = -(-max(h["members"] for h in hubs) // rows_per_lot)
    return _ranked(chosen, ["hub"], lots).withColumn("shard", shard).drop("rank")


def _offsets(hubs: DataFrame, keys: list[str], lots: int) -> DataFrame:
    """``offset``: members of the hubs before, in each key and a fixed order, by way of lots."""
    dealt = hubs.withColumn("lot", F.pmod(F.xxhash64("hub"), F.lit(max(1, lots))))
    counts = _before(dealt.groupBy(*keys, "lot").agg(F.sum("members").alias("n")), keys)
    in_lot = W.partitionBy(*keys, "lot").orderBy("hub").rowsBetween(W.unboundedPreceding, -1)
    run = dealt.withColumn("in_lot", F.coalesce(F.sum("members").over(in_lot), F.lit(0)))
    return run.join(counts, [*keys, "lot"]).withColumn(
        "offset", F.col("before") + F.col("in_lot")
    ).drop("lot", "before", "in_lot")


def _counts(rows: DataFrame, column: str) -> dict[int, int]:
    """Rows per shard: one number per shard comes to the driver."""
    return {r[column]: r["count"] for r in rows.groupBy(column).count().collect()}


def _asked(linked: DataFrame) -> DataFrame:
    """``linked`` with the shard (``goal``) that most members of the hub are in, and their number."""
    votes = linked.groupBy("hub", "shard").agg(F.count("*").alias("n"))
    first = F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard"))
    called = materialize(votes.groupBy("hub").agg(first.alias("best")).select(
        "hub", F.col("best.shard").alias("goal"), F.col("best.n").alias("pull")
    ))
    return linked.join(called, "hub")


def _moved(
    asked: DataFrame, granted: dict[tuple[int, int], int], calls: dict[tuple[int, int], int], shards: int,
    rows_per_lot: int,
) -> DataFrame:
    """One round: of the members of each pair of shards as many move as were granted.

    Those that ask are dealt into lots, and each lot may move its part, those with the strongest pull
    first.
    """
    columns = [c for c in asked.columns if c not in ("goal", "pull")]

    def of_pair(numbers: dict[tuple[int, int], int]) -> Column:
        listed = F.array(*[F.lit(numbers.get((a, b), 0)).cast("long") for a in range(shards) for b in range(shards)])
        return F.element_at(listed, F.col("shard") * shards + F.col("goal") + 1)

    lots = {pair: -(-n // rows_per_lot) for pair, n in calls.items()}
    dealt = asked.filter("shard <> goal").withColumn("room", of_pair(granted)).withColumn(
        "lots", of_pair(lots)
    ).withColumn("lot", F.pmod(F.xxhash64("place"), F.col("lots")))
    quota = F.floor(F.col("room") / F.col("lots")) + (
        F.col("lot") < F.col("room") % F.col("lots")
    ).cast("long")
    in_lot = W.partitionBy("shard", "goal", "lot").orderBy(F.desc("pull"), "hub", "place", "id")
    moved = dealt.withColumn("quota", quota).withColumn("rank", F.row_number().over(in_lot))
    shard = F.when(F.col("rank") <= F.col("quota"), F.col("goal")).otherwise(F.col("shard"))
    return asked.filter("shard = goal").select(*columns).unionByName(
        moved.withColumn("shard", shard).select(*columns)
    )


def _ranked(rows: DataFrame, keys: list[str], lots: int) -> DataFrame:
    """``rank`` from 0 without gaps in each key, in a fixed order, by way of ``lots`` lots a key."""
    dealt = rows.withColumn("lot", F.pmod(F.col("place"), F.lit(max(1, lots))))
    counts = _before(dealt.groupBy(*keys, "lot").agg(F.count("*").alias("n")), keys)
    in_lot = W.partitionBy(*keys, "lot").orderBy("place", "id", "hub")
    ranked = dealt.withColumn("in_lot", F.row_number().over(in_lot) - 1).join(counts, [*keys, "lot"])
    return ranked.withColumn("rank", F.col("before") + F.col("in_lot")).drop(
        "lot", "before", "in_lot"
    )


def _before(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lot, before): what the lots before each hold, by way of groups of lots."""
    group = F.floor(F.col("lot") / LOTS_PER_GROUP).alias("group")
    counts = counts.select("*", group)
    ahead = lambda *by: F.coalesce(F.sum("n").over(
        W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy(*keys, "group").agg(F.sum("n").alias("n")).select(
        *keys, "group", ahead(*keys, "group").alias("groups_before"))
    inside = counts.withColumn("inside", ahead(*keys, "group", "lot"))
    return inside.join(groups, [*keys, "group"]).select(
        *keys, "lot", (F.col("inside") + F.col("groups_before")).alias("before"))
