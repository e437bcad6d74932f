"""Declared schemas of the stored documents and streams."""

from __future__ import annotations

from pyspark.sql import types as T

ZONES = T.StructType([T.StructField(c, T.LongType()) for c in ("left", "center", "right")])
LINES = T.StructType([T.StructField(c, T.LongType()) for c in ("entry", "exit")])
FEATURES = T.StructType([
    T.StructField(c, T.DoubleType())
    for c in ("density_score", "movement_score", "congestion_score", "hotspot_ratio")
])
POINT = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x", "y")])
TRACKED_BOX = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("bbox", T.ArrayType(T.IntegerType())),
])
ALERT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("risk", T.StringType()),
    T.StructField("count", T.LongType()),
])

FRAME_RESULT = T.StructType([
    T.StructField("frame_id", T.LongType()),
    *[T.StructField(c, T.LongType())
      for c in ("current_count", "total_count", "density_count", "base_count")],
    T.StructField("predicted_crowd", T.DoubleType()),
    *[T.StructField(c, T.LongType()) for c in ("smoothed_count", "final_count")],
    T.StructField("active_track_ids", T.ArrayType(T.LongType())),
    T.StructField("detections", T.ArrayType(TRACKED_BOX)),
    T.StructField("zone_counts", ZONES),
    T.StructField("line_crossing", LINES),
    T.StructField("crowd_features", FEATURES),
    T.StructField("risk", T.StringType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("alerts", T.ArrayType(ALERT)),
])

# Stored metrics keep the three count aliases and the spelling of the writing service.
STORED_METRICS = T.StructType([
    *[T.StructField(c, T.LongType())
      for c in ("count", "current_count", "total_count", "people_count", "density_count",
                "base_count", "smoothed_count", "final_count", "frame_id")],
    *[T.StructField(c, T.DoubleType()) for c in ("predicted_crowd", "risk_score")],
    T.StructField("active_track_ids", T.ArrayType(T.LongType())),
    T.StructField("detections", T.ArrayType(TRACKED_BOX)),
    T.StructField("heatmap_points", T.ArrayType(POINT)),
    T.StructField("alerts", T.ArrayType(ALERT)),
    T.StructField("zone_counts", ZONES),
    T.StructField("line_crossing", LINES),
    T.StructField("crowd_features", FEATURES),
    T.StructField("risk", T.StringType()),
    T.StructField("processing_status", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("updatedAt", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

CAMERA_DOCUMENT = T.StructType([
    *[T.StructField(c, T.StringType())
      for c in ("id", "userId", "name", "zoneName", "location", "streamUrl", "sourceType",
                "status", "createdAt", "lastStartedAt", "lastFrameAt")],
    T.StructField("metrics", STORED_METRICS),
])

ALERT_DOCUMENT = T.StructType([
    *[T.StructField(c, T.StringType())
      for c in ("id", "userId", "cameraId", "zoneName", "message", "risk", "type", "createdAt")],
    T.StructField("count", T.LongType()),
])

JOB_EVENT = T.StructType([
    *[T.StructField(c, T.StringType())
      for c in ("job_id", "status", "file_path", "user_id", "file_id", "original_name", "error",
                "created_at", "completed_at")],
    T.StructField("result", FRAME_RESULT),
])

DETECTION = T.StructType([
    T.StructField("det_idx", T.LongType()),
    T.StructField("class_id", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2", "confidence")],
])

DETECTION_ROWS = T.StructType([
    T.StructField("camera_id", T.LongType()),
    T.StructField("frame_id", T.LongType()),
    *DETECTION.fields,
])

# A stream carries one row per frame, so that work within a frame needs no state.
FRAME_STREAM = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("camera_id", T.LongType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("detections", T.ArrayType(DETECTION)),
    # What the density model and the forecast said about the frame; null where they were not asked.
    T.StructField("density_count", T.LongType()),
    T.StructField("predicted", T.DoubleType()),
])
