"""Session settings, and the shared folder where long jobs write what they go on from."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python line of every expression makes long plans slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    STATE_STORE: ROCKSDB,
}


def build_session(name: str = "zoneflow", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir``, which the cluster names.

    Where nobody set one, a local session uses a folder of this process; on a cluster each executor
    would write to its own disk, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_DIR, None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors reach")
            folder = tempfile.mkdtemp(prefix="zoneflow-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def new_folder(spark: SparkSession) -> str:
    """A new name in the shared folder, removed when the application ends."""
    name = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path = _path(spark, name)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return name


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Cuts the lineage, survives the loss of executors, and later steps read only the columns they
    name. ``release`` gives the space back early; the rest goes when the application ends.
    """
    spark = df.sparkSession
    name = f"{new_folder(spark)}/table"
    df.write.parquet(name)
    written = spark.read.schema(df.schema).parquet(name)
    written._folder = name
    return written


def release(*written: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in written:
        spark, path = df.sparkSession, _path(df.sparkSession, df._folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="zoneflow-code-")  # on the driver, which serves the archive
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(
        os.path.join(folder, "zoneflow"), "zip",
        root_dir=os.path.dirname(package), base_dir=os.path.basename(package),
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
