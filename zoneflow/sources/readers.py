"""Sources: stored documents, detection tables and detection streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow import schemas


def _documents(
    spark: SparkSession, path: str, schema: T.StructType, one_per_line: bool = False
) -> DataFrame:
    """A file or folder of JSON documents (one array or one document per file, or one per line).

    A missing path gives an empty table; text that does not parse gives no rows. A document is
    addressed by its ``id``; those without one are in ``rejected_documents``.
    """
    return _parsed(spark, path, schema, one_per_line).filter(F.col("id").isNotNull())


def _parsed(
    spark: SparkSession, path: str, schema: T.StructType, one_per_line: bool = False
) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", not one_per_line).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def rejected_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The documents that ``read_cameras`` and ``read_alerts`` leave out: those without an ``id``.

    Text that does not parse gives a row of nulls here.
    """
    return _parsed(spark, path, schema).filter(F.col("id").isNull())


def epoch_ms(text: Column) -> Column:
    """Milliseconds of an ISO-8601 time, with ``Z`` or an offset; null where it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def read_camera_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return _documents(spark, path, schemas.CAMERA_DOCUMENT, one_per_line)


def read_cameras(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Cameras with flat metrics, in the column names the operators use."""
    m = F.col("metrics")
    flat = ("count", "current_count", "total_count", "people_count", "density_count", "base_count",
            "smoothed_count", "final_count", "frame_id", "predicted_crowd", "risk_score",
            "active_track_ids", "detections", "heatmap_points", "alerts", "risk",
            "processing_status")
    return read_camera_documents(spark, path, one_per_line).select(
        F.col("id").alias("camera_id"), F.col("userId").alias("user_id"), "name",
        F.col("zoneName").alias("zone_name"), "location", F.col("streamUrl").alias("stream_url"),
        F.col("sourceType").alias("source_type"), "status",
        epoch_ms(F.col("createdAt")).alias("created_ms"),
        epoch_ms(F.col("lastStartedAt")).alias("last_started_ms"),
        epoch_ms(F.col("lastFrameAt")).alias("last_frame_ms"),
        epoch_ms(F.coalesce(m["updatedAt"], m["updated_at"])).alias("updated_ms"),
        *[m[c].alias(c) for c in flat],
        *[m["zone_counts"][c].alias(f"zone_{c}") for c in ("left", "center", "right")],
        *[m["line_crossing"][c].alias(f"line_{c}") for c in ("entry", "exit")],
        *[m["crowd_features"][f.name].alias(f.name) for f in schemas.FEATURES.fields],
    )


def read_alerts(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return _documents(spark, path, schemas.ALERT_DOCUMENT, one_per_line).select(
        F.col("id").alias("alert_id"), F.col("userId").alias("user_id"),
        F.col("cameraId").alias("camera_id"), F.col("zoneName").alias("zone_name"),
        epoch_ms(F.col("createdAt")).alias("created_ms"), "type", "message", "risk", "count",
    )


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """File analysis events, one JSON document per line."""
    events = spark.read.schema(schemas.JOB_EVENT).json(path)
    return _timed(events)


def read_jobs_stream(spark: SparkSession, path: str) -> DataFrame:
    return _timed(spark.readStream.schema(schemas.JOB_EVENT).json(path))


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts_ms", epoch_ms(F.coalesce("completed_at", "created_at")))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detection table, one row per box."""
    return spark.read.schema(schemas.DETECTION_ROWS).parquet(path)


def read_detections_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of frames with a ``detections`` array each, from Parquet files."""
    reader = spark.readStream.schema(schemas.FRAME_STREAM)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def parse_frames(messages: DataFrame, value: str = "value") -> DataFrame:
    """Frames from a message stream whose payload is JSON (for example Kafka records)."""
    parsed = F.from_json(F.col(value).cast("string"), schemas.FRAME_STREAM)
    return messages.select(parsed.alias("_m")).select("_m.*")
