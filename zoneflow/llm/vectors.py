"""Rows of vectors that take part: one length, no null and no entry that is not finite."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 2**62


def finite_rows(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` whose vector has the most frequent length (of equally frequent ones the longest), no
    null entry and only finite ones. Empty vectors never take part."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    sizes = rows.groupBy(F.size(column).alias("size")).count().filter("size > 0")
    usual = sizes.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.filter(F.size(column) == (usual[0]["size"] if usual else -1))


def whole(column: str, scale: int, offset: int = 0):
    """The entries as whole numbers: the floor of ``scale`` times each, plus ``offset``. Beyond 2**62 in
    size the floor counts as that."""
    def one(c):
        floor = F.floor(c.cast("double") * scale).cast("long")
        return F.least(F.greatest(floor, F.lit(-LARGEST)), F.lit(LARGEST)) + F.lit(offset).cast("long")

    return F.transform(column, one)


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)
