"""Decimal rounding decided on the exact binary value, ties to even.

``bround`` decides on the shortest decimal text of a double: it takes 0.16725 for a tie although
the stored double lies below it. Here the distance to the midpoint is computed without error, by
splitting the number into two halves whose products are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 2**27 + 1, splits a double into two 26-bit halves.
SPLITTER = 134217729.0


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A body that names its argument many times would otherwise copy the whole expression each
    time, and scores built on rounded scores would grow without bound when a filter is pushed
    down to them.
    """
    return F.transform(F.array(value), body)[0]


def _units(value: Column, digits: int) -> Column:
    """The non-negative ``value`` in whole steps of 10**-digits, as a long. Bind it first."""
    scale = 10.0**digits

    def nearest(below: Column) -> Column:
        spread = value * SPLITTER
        high = spread - (spread - value)
        low = value - high
        past_midpoint = (high * (2 * scale) - (below * 2 + 1)) + low * (2 * scale)
        up = (past_midpoint > 0) | ((past_midpoint == 0) & (below % 2 == 1))
        return below + up.cast("long")

    return nearest(F.floor(value * scale))


def exact_round(value: Column, digits: int) -> Column:
    """Nearest multiple of 10**-digits. From 2**52 / 10**digits on a double has no more decimals
    than that, and stays as it is.

    Up to 2**30 steps the product is off by less than 2**-22, so a value further than that from a
    midpoint is settled by ``rint`` in generated code. Only the others take the exact way, whose
    lambdas Spark interprets node by node.
    """
    scale = 10.0**digits
    steps = value.cast("double") * scale
    settled = (F.abs(steps) < 2.0**30) & (F.abs(steps - F.rint(steps)) < 0.5 - 1e-6)
    return F.when(settled, F.rint(steps) / F.lit(scale)).otherwise(_exact(value, digits))


def _exact(value: Column, digits: int) -> Column:
    return bind(
        value.cast("double"),
        lambda v: F.when(F.abs(v) >= 2.0**52 / 10.0**digits, v).otherwise(
            F.signum(v) * _units(F.abs(v), digits) / F.lit(10.0**digits)
        ),
    )


def fixed_text(value: Column, digits: int) -> Column:
    """Text of a non-negative number with exactly ``digits`` decimals."""
    scale = 10**digits

    def text(units: Column) -> Column:
        decimals = F.lpad((units % scale).cast("string"), digits, "0")
        return F.concat(F.floor(units / scale).cast("string"), F.lit("."), decimals)

    return bind(bind(value, lambda v: _units(v, digits)), text)
