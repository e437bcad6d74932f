"""Folds of labelled rows, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder of five; a null id counts as empty."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text) % FOLDS == 0


def training_labels(
    labels: DataFrame, label_column: str, max_rows: int, id_column: str = "doc_id"
) -> DataFrame:
    """(id, y) of the rows a model may learn from, about ``max_rows`` of them and never more than
    twice as many; which ones depends on the id alone. Rows with a null id or label are passed over;
    of an id with both labels the larger counts."""
    rows = labels.select(
        F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")
    ).dropna().filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    total = rows.count()
    if total <= max_rows:
        return rows
    parts = -(-total // max_rows)
    return rows.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).limit(2 * max_rows)
