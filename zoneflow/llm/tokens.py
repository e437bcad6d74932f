"""Token counts through a digest cache.

The cache is a table (version, digest, n_tokens): digest of the normalised content, version of the
tokenizer. Only contents that the cache lacks are encoded, one row of each, and appended to it; the
counts of all rows are then joined from the cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.session import materialize, new_folder

CACHE_SCHEMA = "version string, digest string, n_tokens long"
MEMO_WORDS = 100_000  # counts of single words a worker keeps; it starts anew when they are more


class WordCounts:
    """Token counts of texts with a tokenizer that never joins two words.

    White space of ASCII ends a piece in such a tokenizer, so a text has as many tokens as its
    words have; a word is encoded by the library when a worker meets it first.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, int] = {}

    def count(self, text: bytes) -> int:
        words = text.split()
        missing = list(set(words).difference(self.memo))
        if len(self.memo) + len(missing) > MEMO_WORDS:
            self.memo.clear()
            missing = list(set(words))
        for start in range(0, len(missing), 2000):
            part = missing[start:start + 2000]
            encoded = self.tokenizer.encode_batch_fast(
                [w.decode() for w in part], add_special_tokens=False
            )
            self.memo.update(zip(part, map(len, encoded), strict=True))
        return sum(map(self.memo.__getitem__, words))


class WholeCounts(WordCounts):
    """Token counts of texts with any tokenizer: each text is encoded as a whole."""

    def count(self, text: bytes) -> int:
        encoded = self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)
        return len(encoded[0])


def tokenizer_version(definition: bytes) -> str:
    from tokenizers import __version__

    return f"{hashlib.sha256(definition).hexdigest()}-{__version__}"


def token_counts(
    docs: DataFrame, tokenizer_file: str, limit: int = 2048, cache: str | None = None,
    by_word: bool = False, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``cache`` is the folder of the stored counts; without one a new, empty cache in the shared folder
    is used. Begin, end and added special tokens are not counted; strings of special tokens inside a
    text are handled as the library does by default. ``by_word`` is for tokenizers whose pieces end
    at white space (see ``WordCounts``). A null text counts as empty and has no tokens; ids may be
    null or repeat; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as file:
        content = file.read()
    version = tokenizer_version(content)
    cache = cache or f"{new_folder(spark)}/counts"
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("content")
    ).withColumn("digest", F.sha2("content", 256))
    _encode_missing(spark, rows, cache, version, content, by_word)
    # A written table: Spark can then split a digest that many rows share when it joins.
    counts = materialize(_stored(spark, cache, version))
    slim = rows.select("id", F.octet_length("content").cast("long").alias("n_bytes"), "digest")
    return slim.join(counts, "digest").select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of a version, one row per digest whatever was appended twice."""
    return (
        spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _encode_missing(
    spark: SparkSession, rows: DataFrame, cache: str, version: str, content: bytes, by_word: bool
) -> None:
    # One row of each missing digest is named by its id, so copies of a text never meet in a task.
    key = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key")
    named = rows.select("digest", key).groupBy("digest").agg(F.max("key").alias("key"))
    if _exists(spark, cache):
        named = named.join(_stored(spark, cache, version), "digest", "left_anti")
    missing = rows.select("digest", key, "content").join(named, ["digest", "key"], "left_semi")
    definition = spark.sparkContext.broadcast(content)  # one file of a few megabytes
    kind = WordCounts if by_word else WholeCounts

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has one core; threads of the library would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = kind(definition.value.decode())
        for batch in batches:
            texts = batch.column("content").cast(pa.binary())
            n_tokens = [counter.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(n_tokens), pa.string()), batch.column("digest"),
                 pa.array(n_tokens, pa.int64())],
                names=["version", "digest", "n_tokens"],
            )

    missing.select("digest", "content").mapInArrow(encode, CACHE_SCHEMA).write.mode(
        "append"
    ).parquet(cache)
