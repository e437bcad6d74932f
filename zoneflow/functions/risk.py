"""Risk levels and the scores they are cut from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zoneflow.params import DEFAULTS, Params

# Level names, and the lowest count / score of each level.
LEVELS = ("Low", "Medium", "High", "Critical")
COUNT_CUTS = (75, 130, 180)
SCORE_CUTS = (0.34, 0.62, 0.82)
ESCALATED = ("High", "Critical")


def risk_by_count(count: Column) -> Column:
    medium, high, critical = COUNT_CUTS
    return (
        F.when(count >= critical, LEVELS[3])
        .when(count >= high, LEVELS[2])
        .when(count >= medium, LEVELS[1])
        .otherwise(LEVELS[0])
    )


def risk_ordinal(risk: Column) -> Column:
    """Low = 0 ... Critical = 3; anything else is null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), risk), F.lit(0)) - 1


def density_score(bbox_density: Column, hotspot: Column) -> Column:
    return F.least(F.greatest(bbox_density * 2.4, hotspot * 0.75), F.lit(1.0))


def congestion_score(
    count: Column, density: Column, movement: Column, params: Params = DEFAULTS
) -> Column:
    """All inputs unrounded."""
    crowd = count / F.lit(float(max(params.overcrowd, 1)))
    return F.least(F.lit(1.0), crowd * 0.45 + density * 0.35 + movement * 1.2 * 0.20)


def risk_score(
    count: Column,
    density: Column,
    movement: Column,
    congestion: Column,
    params: Params = DEFAULTS,
) -> Column:
    """Weighted score of the rounded crowd features; not rounded itself."""
    crowd = F.least(count / F.lit(max(params.overcrowd * 1.5, 1.0)), F.lit(1.0))
    return F.least(
        F.lit(1.0), crowd * 0.45 + density * 0.30 + movement * 0.10 + congestion * 0.15
    )


def composite_risk(score: Column, count: Column) -> Column:
    """Level of the unrounded score; below the lowest cut the count decides."""
    medium, high, critical = SCORE_CUTS
    return (
        F.when(score >= critical, LEVELS[3])
        .when(score >= high, LEVELS[2])
        .when(score >= medium, LEVELS[1])
        .otherwise(risk_by_count(count))
    )
