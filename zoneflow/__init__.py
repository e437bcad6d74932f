"""People-flow analytics over camera detections, written as Spark DataFrame operators."""

from zoneflow.params import Params

__all__ = ["Params"]
