"""The corpus pipeline: from raw documents to shards.

Each stage takes the session, what the stage before kept, and the folder of the tables. All but the
last give back the columns of ``documents``. Null texts count as empty and stay in as far as a stage
judges texts, ids may be null, rows may repeat, and an empty table goes through as an empty one; each
operator says what it does with ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zoneflow.llm import decontaminate, mixing, sharding, simhash, toxicity
from zoneflow.session import materialize, ship_code

SHARDS = 40
SHINGLE, BITS, ALIKE = 5, 3, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from those of them with a label."""
    ship_code(spark)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Fingerprints over five-word shingles at most three bits apart and texts whose sets of such shingles
    have a Jaccard similarity of ``ALIKE`` are linked. Null and wordless texts are copies of each other.
    """
    ship_code(spark)
    return simhash.simhash_dedup(docs, shingle=SHINGLE, bits=BITS, jaccard=ALIKE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    ship_code(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship_code(spark)
    return mixing.repeat_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every row of the mix with its shard and slot."""
    ship_code(spark)
    return sharding.shard_documents(docs, shards=SHARDS)


STAGES = [
    ("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated), ("mixing", mix), ("sharding", shard),
]

# Two stages are models or iterations; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
