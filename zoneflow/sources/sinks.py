"""Sinks: versioned tables, appended results, and per-tenant channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

MARK = "_version-"  # an empty file per finished version
DONE = "_done-"  # an empty file per finished batch
KEEP_MS = 3_600_000


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(*parts)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> dict[int, int]:
    """Finished versions and when they were finished (epoch ms)."""
    fs, folder = _system(spark, path), _path(spark, path)
    if not fs.exists(folder):
        return {}
    found = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(MARK):
            found[int(name.removeprefix(MARK))] = status.getModificationTime()
    return found


def current_version(spark: SparkSession, path: str) -> int | None:
    return max(_versions(spark, path), default=None)


def write_table(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), versions: int = 3,
    keep_ms: int = KEEP_MS,
) -> int:
    """Replace the table at ``path``; returns the new version.

    The rows go to a new version folder, and an empty file with the number of the version makes it
    the current one in a single step; so the old version can be read while the new one is made from
    it, and a failed job changes nothing. The last ``versions`` stay, and older ones until they have
    been replaced for ``keep_ms``, which has to be longer than any read of the table takes.
    """
    spark = df.sparkSession
    known = _versions(spark, path)
    version = max(known, default=0) + 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/v{version}")
    fs = _system(spark, path)
    fs.create(_path(spark, path, f"{MARK}{version}"), False).close()
    now = fs.getFileStatus(_path(spark, path, f"{MARK}{version}")).getModificationTime()
    for old in known:
        replaced = known.get(old + 1, now)
        if old <= version - versions and now - replaced >= keep_ms:
            fs.delete(_path(spark, path, f"{MARK}{old}"), False)
            fs.delete(_path(spark, path, f"v{old}"), True)
    return version


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/v{version}")


def write_results(
    stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()
) -> DataStreamWriter:
    """Writer that appends finished results with the time they were received.

    Each batch has a folder of its own and, once it is complete, a mark. ``read_results`` sees marked
    batches only; a batch that failed is written again, one that has its mark is left as it is.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in committed_batches(spark, path):
            return
        writer = batch.withColumn("received_at", F.current_timestamp()).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{path}/batch={batch_id}")
        _system(spark, path).create(_path(spark, path, f"{DONE}{batch_id}"), True).close()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches of ``write_results``."""
    fs, folder = _system(spark, path), _path(spark, path)
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n.removeprefix(DONE)) for n in names if n.startswith(DONE))


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all complete batches, with their number in ``batch``; None before the first."""
    done = committed_batches(spark, path)
    if not done:
        return None
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in done])


def fanout_by_tenant(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer of one channel (dashboards, cameras or alerts) with a folder per tenant."""
    return (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).partitionBy("user_id")
    )
