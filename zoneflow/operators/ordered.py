"""Running values over a long ordered sequence per key, without one task per key.

A key (a camera) may hold a third of all rows, so a window partitioned by the key alone is one
endless task. Every sequence is cut into spans of the order column. One task handles one span
of one key; what a span needs from the spans before it (a sum, the last row) comes from a table
with one row per key and span.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = "_span"
SPAN_ROWS = 4096


def span_of(order: Column, size: int) -> Column:
    return F.floor(order / F.lit(size)).cast("long")


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    span: int = SPAN_ROWS,
) -> DataFrame:
    """Add inclusive running sums and values of the previous row, per key in the given order.

    The first order column must be a number that spreads the rows of a key (a frame or sequence
    number, or a time); ``span`` is how much of it one task covers. Values of the previous row
    are null on the first row of a key.
    """
    sums, previous = dict(sums or {}), dict(previous or {})
    keys, order = list(keys), list(order)
    spanned = df.withColumn(SPAN, span_of(F.col(order[0]), span))

    per_span = [F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{n}") for n, c in sums.items()]
    before = [F.coalesce(F.sum(f"_sum_{n}").over(_earlier(keys)), F.lit(0)).alias(f"_sum_{n}")
              for n in sums]
    if previous:
        last_row = F.struct(*[c.alias(n) for n, c in previous.items()])
        per_span.append(F.max_by(last_row, F.struct(*order)).alias("_last"))
        before.append(F.lag("_last").over(W.partitionBy(*keys).orderBy(SPAN)).alias("_last"))
    carry = spanned.groupBy(*keys, SPAN).agg(*per_span).select(*keys, SPAN, *before)

    # Within spans first: rows are then in the order that the join wants, and are sorted once.
    inside = W.partitionBy(*keys, SPAN).orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = [F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"_own_{n}") for n, c in sums.items()]
    if previous:
        own.append(F.lag(last_row).over(inside).alias("_lagged"))
    out = spanned.select("*", *own).join(carry, [*keys, SPAN], "left")
    added = [(F.col(f"_sum_{n}") + F.col(f"_own_{n}")).alias(n) for n in sums]
    if previous:
        out = out.withColumn("_previous", F.coalesce("_lagged", "_last"))
        added += [F.col(f"_previous.{n}").alias(n) for n in previous]
    return out.select(*df.columns, *added)


def with_recent(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    value: Column,
    rows: int,
    span: int = SPAN_ROWS,
) -> DataFrame:
    """Add the array of the last ``rows`` values of the key, the current one last.

    ``value`` is never null. The order columns must be unique within a key.
    """
    keys, order = list(keys), list(order)

    def last(values: Column, n: int) -> Column:
        return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), n)

    spanned = df.withColumn("_value", value).withColumn(SPAN, span_of(F.col(order[0]), span))
    # Only the last rows of a span are gathered.
    backwards = W.partitionBy(*keys, SPAN).orderBy(*[F.desc(c) for c in order])
    ending = spanned.withColumn("_from_end", F.row_number().over(backwards)).filter(
        F.col("_from_end") <= rows
    )
    in_order = F.sort_array(F.collect_list(F.struct(*order, "_value")))["_value"]
    tails = ending.groupBy(*keys, SPAN).agg(in_order.alias("_tail"))
    # Every span has a row, so ``rows`` spans hold the last ``rows`` values.
    near = W.partitionBy(*keys).orderBy(SPAN).rowsBetween(-rows, -1)
    carry = tails.select(
        *keys, SPAN, last(F.flatten(F.collect_list("_tail").over(near)), rows).alias("_earlier")
    )
    inside = W.partitionBy(*keys, SPAN).orderBy(*order).rowsBetween(1 - rows, 0)
    return (
        spanned.join(carry, [*keys, SPAN], "left")
        .withColumn("_own", F.collect_list("_value").over(inside))
        .select(*df.columns, last(F.concat("_earlier", "_own"), rows).alias(name))
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, span: int = SPAN_ROWS
) -> DataFrame:
    """Number the rows of every key from 1 in the given order."""
    return with_running(df, keys, order, sums={name: F.lit(1)}, span=span)


def _earlier(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy(SPAN).rowsBetween(W.unboundedPreceding, -1)
