"""Exact duplicates by skew-safe combining.

Rows are grouped three times by (digest, content): inside each task before the shuffle, per salt,
and over the salts. The content itself is part of every key, so equal digests alone never join two
texts. A text that a third of all rows share meets in one task only as one row, without its ids, per
task that grouped its salts; what came out goes back to the ids of each salt, which Spark can spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_SALT = 20_000


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """One row per input row: which row of its group of equal texts stays.

    Columns: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. The largest id of a
    group stays. A null text counts as empty. A null id is smaller than any other. Where rows repeat
    an id and its text, exactly one of them is kept. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    salts = max(8, -(-docs.count() // rows_per_salt))
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("content")
    ).select("id", "content", F.sha2("content", 256).alias("digest"),
             F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    # About rows_per_salt ids at most in an array: a salt holds its share of the largest group.
    salted = rows.groupBy("digest", "salt", "content").agg(
        F.sort_array(F.collect_list(F.struct("id")), asc=False).alias("ids")
    ).withColumn("name", F.struct("digest", F.xxhash64("content"), F.length("content")))
    # Winners of the salts meet without the other ids, first in the task that has several of them.
    winners = salted.groupBy("name", "content").agg(
        F.max(F.col("ids")[0]["id"]).alias("keep_id"),
        F.sum(F.size("ids").cast("long")).alias("group_size"),
    ).drop("content")
    members = salted.select("name", "ids").join(winners, "name").select(
        "name.digest", "keep_id", "group_size", F.posexplode("ids"))
    return members.select(
        F.col("col.id").alias(id_column), "keep_id", "group_size",
        ((F.col("pos") == 0) & F.col("col.id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
