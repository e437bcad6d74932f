"""Pairing the boxes of two frames, and choosing a one-to-one assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.functions.geometry import CORNERS, corners, iou
from zoneflow.params import DEFAULTS

CELL_PIXELS = 128


def _cells(df: DataFrame, box: Column, cell: int) -> DataFrame:
    """One row per grid cell a box covers; boxes without area cover none."""
    def covered(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(box[low] / cell), F.floor(box[high] / cell)))

    return (
        df.filter((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]))
        .withColumn("_cell_x", covered("x1", "x2"))
        .withColumn("_cell_y", covered("y1", "y2"))
    )


def iou_candidates(
    tracks: DataFrame,
    detections: DataFrame,
    threshold: float = DEFAULTS.track_iou,
    keys: Sequence[str] = ("camera_id", "frame_id"),
    cell: int = CELL_PIXELS,
) -> DataFrame:
    """(track_idx, det_idx, iou) of all boxes of a frame that overlap by at least ``threshold``.

    Only boxes that share a grid cell meet. A pair that shares several cells is reported by the
    one that holds the top left corner of its intersection.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0: boxes that do not touch never meet")
    keys = list(keys)

    def side(df: DataFrame, index: str, name: str) -> DataFrame:
        box = F.struct(*[F.col(c).cast("double").alias(c) for c in CORNERS])
        return _cells(df.select(*keys, index, box.alias(name)), F.col(name), cell)

    a, b = F.col("_a"), F.col("_b")
    met = side(tracks, "track_idx", "_a").join(
        side(detections, "det_idx", "_b"), [*keys, "_cell_x", "_cell_y"]
    )
    reported = (F.floor(F.greatest(a["x1"], b["x1"]) / cell) == F.col("_cell_x")) & (
        F.floor(F.greatest(a["y1"], b["y1"]) / cell) == F.col("_cell_y")
    )
    overlap = iou(corners(a), corners(b))
    return (
        met.filter(reported)
        .select(*keys, "track_idx", "det_idx", overlap.alias("iou"))
        .filter(F.col("iou") >= threshold)
    )


def greedy_match(
    pairs: DataFrame, keys: Sequence[str] = ("camera_id", "frame_id")
) -> DataFrame:
    """One-to-one assignment by falling IoU; equal values in track, then detection order.

    One frame is one group, as large as the overlaps of one picture.
    """
    ordered = F.sort_array(
        F.collect_list(F.struct((-F.col("iou")).alias("rank"), "track_idx", "det_idx", "iou"))
    )

    def step(chosen: Column, pair: Column) -> Column:
        taken = F.exists(chosen, lambda c: (c["track_idx"] == pair["track_idx"])
                         | (c["det_idx"] == pair["det_idx"]))
        return F.when(taken, chosen).otherwise(F.concat(chosen, F.array(pair)))

    chosen = F.aggregate("_pairs", F.slice("_pairs", 1, 0), step)
    return (
        pairs.groupBy(*keys).agg(ordered.alias("_pairs"))
        .select(*keys, F.explode(chosen).alias("_m"))
        .select(*keys, "_m.track_idx", "_m.det_idx", "_m.iou")
    )
