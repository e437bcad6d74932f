"""Camera data derived by Spark from the given tables; it grows with them.

``DERIVED_SQL`` in ``oracle.py`` states the same tables for the SQL check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEWEST_CAMERAS, CUSTOMERS_PER_CAMERA = 25, 600


class Derived:
    """Lazy access to the derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def cameras_in_view(self) -> int:
        """How many cameras have frames; grows with the customers."""
        return max(FEWEST_CAMERAS, self.table("customer").count() // CUSTOMERS_PER_CAMERA)

    def cameras(self) -> DataFrame:
        key, name = F.col("c_custkey"), F.col("c_name")
        scheme = F.when(key % 3 == 0, "rtsp://h/").when(key % 3 == 1, "HTTP://h/").otherwise("file-")
        return self.table("customer").select(
            key.alias("camera_id"),
            F.col("c_nationkey").alias("user_id"),
            F.concat(F.lit("cam-"), key.cast("string")).alias("name"),
            name.alias("zone_name"),
            F.when(key % 7 == 0, "stopped").otherwise("running").alias("status"),
            F.concat(scheme, name).alias("stream_url"),
        )

    def frames(self) -> DataFrame:
        step = _div("event_id", 500)
        steps = self.table("events").select(step.alias("f")).distinct()
        return self._at_each_camera(steps).select(
            "camera_id",
            (F.col("f") + 1).alias("frame_id"),
            ((F.col("f") + 1) * 5000).alias("ts_ms"),
            F.lit(1280).alias("width"),
            F.lit(720).alias("height"),
        )

    def _at_each_camera(self, steps: DataFrame) -> DataFrame:
        """Each step at each camera. A join, not an array to explode: Spark takes the size of exploded rows
        for that of the steps, and would broadcast all frames however many there are. Steps are dealt out
        first: there are few, and Spark would join them all in one task."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return steps.repartition(parts).crossJoin(self.spark.range(self.cameras_in_view).withColumnRenamed("id", "camera_id"))

    def _people(self) -> DataFrame:
        event, step = F.col("event_id"), _div("event_id", 500)
        return (
            self.table("events")
            .groupBy(
                (event * event % self.cameras_in_view).alias("camera_id"),
                (step + 1).alias("frame_id"),
                F.col("user_id").alias("track_id"),
            )
            .agg(F.max("event_id").alias("e"))
        )

    def tracks(self) -> DataFrame:
        return _placed(self._people())

    def tracks_big(self) -> DataFrame:
        """As ``tracks`` from lineitem: more people, more frames per camera."""
        people = (
            self.table("lineitem")
            .groupBy(
                (F.col("l_suppkey") % self.cameras_in_view).alias("camera_id"),
                (_div("l_orderkey", 50) + 1).alias("frame_id"),
                F.col("l_partkey").alias("track_id"),
            )
            .agg(F.max(F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("e"))
        )
        return _placed(people)

    def frames_big(self) -> DataFrame:
        steps = self.table("lineitem").select(_div("l_orderkey", 50).alias("f")).distinct()
        return self._at_each_camera(steps).select(
            "camera_id",
            (F.col("f") + 1).alias("frame_id"),
            ((F.col("f") + 1) * 250).alias("ts_ms"),
            F.lit(1280).alias("width"),
            F.lit(720).alias("height"),
        )

    def detections(self) -> DataFrame:
        who, frame, e = F.col("track_id"), F.col("frame_id"), F.col("e")
        boxes = self._people().select(
            "camera_id", "frame_id", who.alias("who"), "e",
            (who % 30 + 40).alias("bw"), (who % 50 + 90).alias("bh"),
            ((who * 97 + frame * (who % 5 + 2)) % 1180).alias("bx"),
            ((who * 53 + frame * (who % 4 + 1)) % 560).alias("by"),
        )
        copies = F.when(e % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        boxes = boxes.withColumn("k", F.explode(copies))
        x, y, k = F.col("bx") + F.col("k") * 3, F.col("by") + F.col("k") * 2, F.col("k")
        in_frame = W.partitionBy("camera_id", "frame_id").orderBy("e", "k")
        return boxes.select(
            "camera_id", "frame_id",
            (F.row_number().over(in_frame) - 1).cast("long").alias("det_idx"),
            F.when(e % 17 == 0, 1).otherwise(0).alias("class_id"),
            x.cast("double").alias("x1"), y.cast("double").alias("y1"),
            (x + F.col("bw")).cast("double").alias("x2"),
            (y + F.col("bh")).cast("double").alias("y2"),
            ((F.lit(30) + (e * 7) % 69 - k * 5).cast("double") / 100.0).alias("confidence"),
            "who",
        )

    def calm_people(self) -> DataFrame:
        """People who stand on one of twelve places; every 25,000 events five more cameras."""
        event, user = F.col("event_id"), F.col("user_id")
        return self.table("events").select(
            (_div("event_id", 25_000) * 5 + user % 5).alias("camera_id"),
            (F.floor(event % 25_000 / 20) + 1).cast("long").alias("frame_id"),
            (F.floor(user / 5) % 12).cast("long").alias("place"),
        ).distinct()

    def calm_frames(self) -> DataFrame:
        """``calm_people`` as a stream of frames has them: boxes of one size that never meet."""
        x, y = F.col("place") % 4 * 320 + 60, F.floor(F.col("place") / 4) * 240 + 40
        box = F.struct(
            F.col("place").alias("det_idx"), F.lit(0).alias("class_id"), x.cast("double").alias("x1"),
            y.cast("double").alias("y1"), (x + 80).cast("double").alias("x2"),
            (y + 160).cast("double").alias("y2"), F.lit(0.9).alias("confidence"))
        frames = self.calm_people().groupBy("camera_id", "frame_id").agg(
            F.sort_array(F.collect_list(box)).alias("detections"))
        return frames.select(
            (F.col("camera_id") % 3).alias("user_id"), "camera_id", "frame_id",
            (F.col("frame_id") * 250).alias("ts_ms"), F.lit(1280).alias("width"), F.lit(720).alias("height"),
            "detections", F.lit(None).cast("long").alias("density_count"),
            F.lit(None).cast("double").alias("predicted"),
        )

    def job_events(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("seq"),
            (F.col("o_orderkey") % 500).alias("job_id"),
            (F.col("o_custkey") % 25).alias("user_id"),
            F.when(status == "P", "processing_started").when(status == "F", "completed")
            .otherwise("failed").alias("status"),
            F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"),
        )

    def camera_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("camera_id"),
            (F.col("user_id") % 5).alias("tenant_id"),
            F.when(kind == "signup", "add").when(kind == "error", "delete")
            .when(kind == "click", "stop").otherwise("start").alias("action"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        )

    def predictions(self) -> DataFrame:
        line, quantity, flag = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_returnflag")
        return self.table("lineitem").select(
            "l_orderkey", "l_linenumber",
            (F.col("l_suppkey") % 25).alias("camera_id"),
            F.when(line % 2 == 0, quantity).alias("current_count"),
            F.when(line % 3 == 0, quantity + 1).alias("people_count"),
            F.when(line % 5 != 0, quantity + 2).alias("count"),
            F.when(line % 4 != 0, quantity * 3).alias("total_count"),
            F.when(flag == "A", "High").when(flag == "R", "").alias("risk"),
        )

    def uploads(self) -> DataFrame:
        kind = F.col("p_size") % 5
        return self.table("part").select(
            F.col("p_partkey").alias("upload_id"),
            F.concat("p_name", F.lit("  X.MP4")).alias("original_name"),
            (F.col("p_partkey") * 200000).alias("size_bytes"),
            F.when(kind == 0, "video/mp4").when(kind == 1, "video/quicktime")
            .when(kind == 2, "video/x-matroska").when(kind == 3, "video/webm")
            .otherwise("image/png").alias("mime"),
        )

    def count_series(self) -> DataFrame:
        """Counts of many live sources in arrival order."""
        return self.table("events").select(
            F.concat(F.lit("src-"), (F.col("user_id") % 20).cast("string")).alias("source"),
            F.col("event_id").alias("frame_id"),
            (_div("value", 4) - 2).alias("current_count"),
        )

    def live_service(self) -> DataFrame:
        """Counts of four live services, each of which serves one source at a time."""
        return self.table("events").select(
            (F.col("event_id") % 4).alias("service"),
            F.concat(F.lit("src-"), (_div("event_id", 400) % 3).cast("string")).alias("source"),
            F.col("event_id").alias("frame_id"),
            (_div("value", 4) - 2).alias("current_count"),
            (F.col("user_id") % 9).alias("smoothed_count"),
            (F.col("event_id") * 40).alias("updated_ms"),
        )

    def alert_log(self) -> DataFrame:
        event = F.col("event_id")
        return self.table("events").select(
            F.concat(F.lit("a-"), event.cast("string")).alias("alert_id"),
            (F.col("user_id") % 5).alias("user_id"),
            (F.col("user_id") % 25).alias("camera_id"),
            (event * 100).alias("created_ms"),
            F.col("event_type").alias("type"),
            F.concat(F.lit("seen by "), (F.col("user_id") % 2).cast("string")).alias("message"),
            F.when(event % 1000 < 500, "High").otherwise("Low").alias("risk"),
            F.lit(1).cast("long").alias("count"),
        )

    def stored_cameras(self) -> DataFrame:
        """Cameras with metrics as last stored; some fields are missing."""
        key = F.col("camera_id")
        return self.cameras().select(
            "*",
            F.when(key % 4 != 0, key % 40).alias("current_count"),
            F.when(key % 5 != 0, key % 41).alias("count"),
            F.when(key % 3 != 0, key % 300).alias("total_count"),
            F.when(key % 6 != 0, key % 30).alias("density_count"),
            F.when(key % 7 != 0, key % 45).alias("final_count"),
            F.when(key % 4 == 0, "Critical").when(key % 4 == 1, "High").when(key % 4 == 2, "Low")
            .alias("risk"),
            F.when(key % 8 != 0, key % 90).alias("frame_id"),
            ((key % 21) / 20.0).alias("congestion_score"),
            F.when(key % 3 != 1, key * 100).alias("updated_ms"),
            F.when(key % 5 != 1, key * 90).alias("last_frame_ms"),
            (key * 80).alias("last_started_ms"),
        )

    def live_stats(self) -> DataFrame:
        """Of the cameras that have events."""
        key = F.col("camera_id")
        seen = self.table("events").select(F.col("user_id").alias("camera_id")).distinct()
        return self.cameras().join(seen, "camera_id", "left_semi").select(
            F.col("stream_url").alias("source"),
            F.when(key % 8 != 0, key % 50).alias("current_count"),
            (key % 500).alias("total_count"),
            F.when(key % 10 != 0, key % 35).alias("density_count"),
            (key % 55).alias("final_count"),
            F.lit("Low").alias("risk"),
            (key % 1000).alias("frame_id"),
            F.when(key % 4 == 0, key * 110).alias("updated_ms"),
        )

    def density_maps(self) -> DataFrame:
        """One small map per order: a row of cells per line, some cells negative."""
        cells = F.array(F.col("l_quantity") - 20.0, F.rint(F.col("l_discount") * 100.0) / 4,
                        F.rint(F.col("l_tax") * 100.0) / 2 - 1.0)
        rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", cells.alias("c"))))
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("map_id")).agg(
            F.transform(rows, lambda r: r["c"]).alias("density_map")
        )


def _div(column: str, by: int) -> Column:
    return F.floor(F.col(column) / by).cast("long")


def _placed(people: DataFrame) -> DataFrame:
    who, e = F.col("track_id"), F.col("e")
    placed = people.select(
        "camera_id", "frame_id", "track_id",
        ((who * 41 + e * 13) % 1280).cast("int").alias("cx"),
        ((who * 29 + e * 7) % 720).cast("int").alias("cy"),
        (e % 80 + 40).cast("int").alias("w"),
        (e % 120 + 80).cast("int").alias("h"),
    )
    return placed.select(
        "camera_id", "frame_id", "track_id",
        (F.col("cx") - F.floor(F.col("w") / 2)).cast("int").alias("x"),
        (F.col("cy") - F.floor(F.col("h") / 2)).cast("int").alias("y"),
        "w", "h", "cx", "cy",
    )
