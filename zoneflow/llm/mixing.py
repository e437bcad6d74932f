"""Mixing sources to target weights by entropy balancing.

The rates r of a source's documents minimise sum r (log r - 1) under sum size * r = target and
0 <= r <= cap. The dual has one variable per source; its solution tilts every document
exponentially, r = min(cap, exp(lambda * size)). Newton steps, kept inside a bracket, solve all
sources at once over the table of distinct (source, size), which is what the rates depend on. Sums
are exact decimals, so reruns agree to the last bit. Rates become whole copies by systematic
rounding along falling size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoneflow.session import materialize, release

SEPARATORS = r" \t\n\x0B\f\r"
ROWS_PER_SLOT = 1_000
SOURCES_PER_RANGE = 10_000
PHASES = 16
MAX_STEPS = 80
TOLERANCE = 1e-9
UNIT = 1_000_000  # sums are exact in millionths of a word


def word_count(text: Column) -> Column:
    """Number of words, separated by white space of ASCII; no array of words is built."""
    trimmed = F.ltrim(text, F.lit(" \t\n\x0b\f\r"))
    marks = F.regexp_replace(trimmed, f"[^{SEPARATORS}]++[{SEPARATORS}]*+", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """``target`` per source: shares of the total by weight, none above ``cap`` times its size.

    ``sources`` has one row per source (``source``, ``source_size``). Weights repeat along the
    sources in the order of their code points, null last. Sources are numbered and added up by ranges
    of them; one ordered window runs over one row per range.
    """
    by_name = _ranges(sources, F.col("source").asc_nulls_last())
    inside = W.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    counts = _before(by_name.groupBy("range").agg(F.count("*").alias("n")), {"n": "before"})
    nth = F.row_number().over(inside) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    weighed = by_name.join(counts.select("range", "before"), "range").withColumn("weight", weight).drop(
        "range", "before").withColumn("room", F.lit(float(cap)) * F.col("source_size")).withColumn(
        "ratio", F.col("room") / F.col("weight"))
    # Sources fill up in the order of room per weight; the level is final at the first that does not.
    order = [F.col("ratio").asc(), F.col("source").asc_nulls_last()]
    by_ratio = _ranges(weighed, *order)
    words, weight_sum = by_ratio.agg(F.sum("source_size"), F.sum("weight")).first()
    sums = _before(by_ratio.groupBy("range").agg(F.sum("room").alias("room"), F.sum("weight").alias("weight")),
                   {"room": "room_before", "weight": "weight_before"})
    ahead = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0.0)) + F.col(f"{c}_before")
    leveled = by_ratio.join(sums.select("range", "room_before", "weight_before"), "range").withColumn(
        "level", (F.lit(float(words or 0)) - run("room")) / (F.lit(float(weight_sum or 0)) - run("weight")))
    place = F.struct("ratio", F.isnull("source").alias("last"), "source", "level")
    final = leveled.filter(F.col("ratio") >= F.col("level")).agg(F.min(place).alias("first")).first()["first"]
    level = F.lit(float(final["level"])) if final is not None else F.lit(None).cast("double")
    target = F.least(F.col("room"), F.coalesce(F.col("weight") * level, F.col("room")))
    return weighed.withColumn("target", target).drop("weight", "room", "ratio")


def _ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """A written table of ``rows`` with ``range``: ascending ranges of the order, of bounded size."""
    parts = max(1, -(-rows.count() // SOURCES_PER_RANGE))
    dealt = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    return materialize(dealt.withColumn("range", F.spark_partition_id()))


def _before(totals: DataFrame, names: dict[str, str]) -> DataFrame:
    """Sums over the ranges before each; one row per range."""
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("*", *[
        F.coalesce(F.sum(c).over(ahead), F.lit(0).cast(totals.schema[c].dataType)).alias(name)
        for c, name in names.items()])


def _rate(cap: float) -> Column:
    tilt = F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(cap) + 1.0))
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(tilt)))


def _exact_sum(value: Column) -> Column:
    return F.sum(F.round(value * UNIT).cast("decimal(38,0)")).cast("double") / UNIT


def solve_tilts(sizes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """``tilt`` per source: the dual variable (times the mean size of the source).

    ``sizes``: distinct (source key, size) with ``n`` rows; ``sources``: key, target, source_size,
    ``n_rows``. Where the target is the cap itself, or nothing, the rate is known (``full``).
    """
    low, high = -750.0, math.log(cap)  # in units of the mean size; every size is at least one
    state = materialize(sources.select(
        "key", "target", (F.col("source_size") / F.col("n_rows")).alias("mean"),
        (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("tilt"),
    ).select("*", (F.col("mean") * low).alias("low"), (F.col("mean") * high).alias("high"),
             F.lit(False).alias("done")))
    for _ in range(MAX_STEPS):
        rate, size = _rate(cap), F.col("size")
        words = F.col("n") * size * rate
        slope = F.when(rate < cap, words * size / F.col("mean")).otherwise(0.0)
        sums = sizes.join(state.filter(~F.col("full")), "key").groupBy("key").agg(
            _exact_sum(words).alias("words"), _exact_sum(slope).alias("slope")
        )
        over = F.col("words") > F.col("target")
        done = F.abs(F.col("words") - F.col("target")) <= F.col("target") * TOLERANCE
        low_now = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high_now = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        # Newton on the logarithm of the words; outside of the bracket its middle is taken.
        step = F.col("tilt") + (
            (F.log("target") - F.log("words")) * F.col("words") / F.nullif("slope", F.lit(0.0))
        )
        inside = (step > F.col("low_now")) & (step < F.col("high_now"))
        middle = (F.col("low_now") + F.col("high_now")) / 2
        moved = (
            state.join(sums, "key", "left").withColumn("low_now", low_now)
            .withColumn("high_now", high_now)
            .withColumn("stop", F.col("full") | F.col("words").isNull() | done)
        )
        following = materialize(moved.select(
            "key", "target", "mean", "full",
            F.when(F.col("stop"), F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"),
            F.when(F.col("stop"), F.col("low")).otherwise(F.col("low_now")).alias("low"),
            F.when(F.col("stop"), F.col("high")).otherwise(F.col("high_now")).alias("high"),
            F.col("stop").alias("done"),
        ))
        release(state)
        state = following
        if state.filter(~F.col("done")).isEmpty():
            break
    return state


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    rows_per_slot: int = ROWS_PER_SLOT, keep_place: bool = False,
) -> DataFrame:
    """One row per input row: the id, source, ``size``, ``source_size``, ``target``, ``rate``,
    ``copies``, ``taken`` (words taken, repeats counted).

    The sources' targets are ``water_fill`` of all words. The words taken of a source differ from its
    target by less than its largest document; ``cap`` is a whole number, so no document has more
    copies. A null text has no words; a null source is a source of its own; ids may be null or
    repeat; other columns are not read. Documents without words have copies by the same rule and take
    nothing. An empty table gives an empty result.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")
    sized = materialize(docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"),
        _place(id_column, text_column, source_column),
    ).select("*", key))
    sizes = materialize(
        sized.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    )
    sources = water_fill(
        sizes.groupBy("key", "source").agg(
            F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_rows")
        ), weights, cap,
    )
    sources = materialize(sources)
    tilts = solve_tilts(sizes.select("key", "size", "n"), sources.filter("source_size > 0"), cap)
    copies = materialize(_rounded(sizes, sources, tilts, cap, rows_per_slot))
    chosen = _chosen(sized, copies)
    return chosen.select(
        F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size",
        "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"), "place",
    ).drop(*([] if keep_place else ["place"]))


def _place(id_column: str, text_column: str, source_column: str) -> Column:
    return F.xxhash64(F.col(id_column), F.col(text_column), F.col(source_column)).alias("place")


def repeat_documents(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` has copies of it, all columns as they
    were.

    Null texts and sources, empty texts and ties are treated as there. Rows equal in all columns are
    one row with the copies of all; of rows that differ but have one id, text and source, any may be
    the ones with a copy more. Columns may have any names; an empty table gives an empty one.
    """
    mixed = mix_sources(
        docs, weights, cap, id_column, text_column, source_column, keep_place=True
    ).groupBy(F.col(id_column).alias("id"), "place").agg(
        F.min("copies").alias("base"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("more"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        whole.alias("row"), F.col(id_column).alias("id"), _place(id_column, text_column, source_column),
        F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in docs.columns]).alias("own"),
    ).groupBy("id", "place", "own").agg(F.first("row").alias("row"), F.count("*").alias("same"))
    rows = materialize(rows)
    # Numbers go along the different rows of one id and text, without the rows themselves.
    before = W.partitionBy("id", "place").orderBy("own").rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.select("id", "place", "own", "same").withColumn(
        "begin", F.coalesce(F.sum("same").over(before), F.lit(0)))
    counted = numbered.alias("n").join(
        mixed.alias("m"), F.expr("n.id <=> m.id and n.place = m.place")
    ).select("n.id", "n.place", "n.own", (F.col("same") * F.col("base") + F.greatest(
        F.lit(0), F.least(F.col("same"), F.col("more") - F.col("begin")))).cast("int").alias("copies"))
    joined = rows.alias("r").join(
        counted.filter("copies > 0").alias("c"),
        F.expr("r.id <=> c.id and r.place = c.place and r.own = c.own"))
    return joined.select(
        "r.row", F.explode(F.array_repeat(F.lit(1), F.col("c.copies"))).alias("again")).select("row.*")


def _rounded(
    sizes: DataFrame, sources: DataFrame, tilts: DataFrame, cap: float, rows_per_slot: int
) -> DataFrame:
    """Per (source, size): the rate, whole copies of all, and how many rows have one more.

    Along falling size the fractions add up; a row gets one more where the sum passes a whole number.
    Of several starting points the one that comes nearest to the target is taken.
    """
    solved = tilts.select("key", "tilt", "mean", "full")
    rated = sizes.join(
        sources.select("key", "source_size", "target"), "key"
    ).join(solved, "key", "left").withColumn(
        "rate", F.when(F.col("tilt").isNull(), F.lit(1.0)).otherwise(_rate(cap))
    ).withColumn("base", F.floor("rate"))
    fraction = F.col("n") * (F.col("rate") - F.col("base"))
    by_size = W.partitionBy("key").orderBy(F.col("size").desc())
    run = rated.withColumn("end", F.sum(fraction).over(by_size)).withColumn(
        "begin", F.coalesce(F.lag("end").over(by_size), F.lit(0.0))
    )
    starts = [(2 * k + 1) / (2 * PHASES) for k in range(PHASES)]
    more = [F.floor(F.col("end") + s) - F.floor(F.col("begin") + s) for s in starts]
    off = [
        F.abs(F.sum(F.col("size") * (F.col("base") * F.col("n") + m)) - F.first("target"))
        for m in more
    ]
    nearest = run.groupBy("key").agg(F.array(*off).alias("off")).select(
        "key", F.array_position("off", F.array_min("off")).cast("int").alias("start")
    )
    return run.join(nearest, "key").select(
        "key", "size", "n", "source_size", "target", "rate", "base",
        F.element_at(F.array(*more), F.col("start")).alias("more"),
        F.ceil(F.col("n") / rows_per_slot).alias("slots"),
    )


def _chosen(sized: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows with their copies; large groups of one (source, size) are split into slots."""
    rows = sized.join(copies, ["key", "size"]).withColumn(
        "slot", F.pmod(F.col("place"), F.col("slots"))
    )
    slots = rows.groupBy("key", "size", "slot").agg(
        F.count("*").alias("in_slot"), F.first("more").alias("more")
    )
    by_slot = W.partitionBy("key", "size").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("in_slot").over(by_slot), F.lit(0))
    take = slots.select("key", "size", "slot", F.greatest(
        F.lit(0), F.least(F.col("in_slot"), F.col("more") - before)
    ).alias("take"))
    in_slot = W.partitionBy("key", "size", "slot").orderBy("place", "id")
    ranked = rows.withColumn("rank", F.row_number().over(in_slot))
    return ranked.join(take, ["key", "size", "slot"]).withColumn(
        "copies", F.col("base") + (F.col("rank") <= F.col("take")).cast("long")
    )
