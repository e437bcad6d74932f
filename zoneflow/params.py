"""Every threshold, window and limit an operator uses, with its default."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Defaults that results depend on.
    confidence: float = 0.4
    nms_iou: float = 0.45
    frame_skip: int = 4
    target_fps: float = 12.0

    track_min_hits: int = 3
    track_max_age: int = 12
    track_iou: float = 0.3
    track_smoothing: float = 0.65

    overcrowd: int = 25
    spike: int = 8
    density_alert: float = 0.32
    movement_alert: float = 0.12
    congestion_alert: float = 0.55

    heatmap_history: int = 250
    movement_history: int = 24
    dense_count: int = 15
    grid_width: int = 64
    grid_height: int = 48

    forecast_length: int = 8
    forecast_min: int = 5
    forecast_blend: float = 0.3
    live_length: int = 10

    stale_after_ms: int = 1_000
    fresh_ms: int = 12_000
    suppress_ms: int = 15_000
    start_cooldown_ms: int = 10_000
    alerts_per_user: int = 40
    alerts_kept: int = 800
    max_upload_bytes: int = 250 * 1024 * 1024

    # Layout: how many consecutive frames of one camera are handled by one task.
    frames_per_span: int = 512

    @property
    def frame_interval_ms(self) -> int:
        """Smallest whole number of milliseconds between two processed frames."""
        return math.ceil(1000.0 / max(self.target_fps, 1.0))

    @property
    def count_history(self) -> int:
        return max(self.forecast_length, 5)


DEFAULTS = Params()
