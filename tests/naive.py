"""Deliberately plain, sequential versions of the ordered operators, for comparison."""

from __future__ import annotations

import math
from collections import deque

import numpy as np

F32 = np.float32


def iou(a, b):
    w = min(float(a[2]), float(b[2])) - max(float(a[0]), float(b[0]))
    h = min(float(a[3]), float(b[3])) - max(float(a[1]), float(b[1]))
    if w <= 0 or h <= 0:
        return 0.0

    def area(c):
        return max(0.0, float(F32(c[2]) - F32(c[0]))) * max(0.0, float(F32(c[3]) - F32(c[1])))

    union = area(a) + area(b) - w * h
    return w * h / union if union > 0 else 0.0


def tracker(frames, last_frame):
    """{frame: [box, ...]} -> {frame: [(track_id, hits, box) per detection]}."""
    live, next_id, out = [], 1, {}
    for number in range(1, last_frame + 1):
        boxes = [[F32(v) for v in box] for box in frames.get(number, [])]
        options = sorted(
            ((-iou(t["box"], b), i, j) for i, t in enumerate(live) for j, b in enumerate(boxes)
             if iou(t["box"], b) >= 0.3)
        )
        matched, seen = {}, {}
        for _, i, j in options:
            if i not in matched and j not in seen:
                matched[i], seen[j] = j, i
        for i, track in enumerate(live):
            if i in matched:
                track["box"] = [F32(0.35) * o + F32(0.65) * n
                                for o, n in zip(track["box"], boxes[matched[i]])]
                track["hits"] += 1
                track["misses"] = 0
            else:
                track["misses"] += 1
        result = []
        for j, box in enumerate(boxes):
            if j in seen:
                track = live[seen[j]]
            else:
                track = {"id": next_id, "box": box, "hits": 1, "misses": 0}
                next_id += 1
                live.append(track)
            result.append((track["id"], track["hits"], [float(v) for v in track["box"]]))
        live = [t for t in live if t["misses"] <= 12]
        if boxes:
            out[number] = result
    return out


def crowd(tracks, spine):
    """Frame metrics of one camera. ``tracks``: {frame: [(id, x, y, w, h, cx, cy)]}."""
    seen, moves, counts, last = {}, deque(maxlen=24), deque(maxlen=8), 0
    entry = exits = 0
    out = []
    for number, width, height in spine:
        items = sorted(tracks.get(number, []))
        zones, steps, area = [0, 0, 0], [], 0
        line = max(height // 2, 1)
        for track_id, _, _, w, h, cx, cy in items:
            area += max(w, 0) * max(h, 0)
            zones[0 if cx < width / 3 else 1 if cx < 2 * width / 3 else 2] += 1
            if track_id in seen:
                px, py = seen[track_id]
                steps.append(math.hypot(cx - px, cy - py) / math.hypot(width, height))
                entry += py < line <= cy
                exits += py > line >= cy
            seen[track_id] = (cx, cy)
        n = len(items)
        moves.append(sum(steps) / len(steps) if steps else 0.0)
        counts.append(n)
        hotspot = max(zones) / n if n else 0.0
        density = min(max(min(area / (width * height), 1.0) * 2.4, hotspot * 0.75), 1.0)
        smooth = sum(moves) / len(moves)
        congestion = min(1.0, n / 25 * 0.45 + density * 0.35 + smooth * 1.2 * 0.20)
        score = min(1.0, min(n / 37.5, 1.0) * 0.45 + round(density, 4) * 0.30
                    + round(smooth, 4) * 0.10 + round(congestion, 4) * 0.15)
        out.append({
            "frame_id": number, "current_count": n, "total_count": len(seen), "last_count": last,
            "zones": tuple(zones), "line": (entry, exits), "density_score": round(density, 4),
            "movement_score": round(smooth, 4), "congestion_score": round(congestion, 4),
            "risk_score": round(score, 4), "count_history": list(counts),
        })
        last = n
    return out


def paced(times, interval, every=1):
    """Positions kept of an ordered list of times."""
    kept, last, waiting = [], None, 0
    for i, t in enumerate(times):
        if last is not None and t - last < interval:
            continue
        waiting += 1
        if waiting % every == 0:
            kept.append(i)
            last, waiting = t, 0
    return kept


def suppressed(boxes, limit):
    """Positions of (score, whole-pixel corners) that greedy suppression keeps."""
    kept = []
    for i in sorted(range(len(boxes)), key=lambda i: (-boxes[i][0], i)):
        a = boxes[i][1]
        for k in kept:
            b = boxes[k][1]
            w = max(min(a[2], b[2]) - max(a[0], b[0]), 0)
            h = max(min(a[3], b[3]) - max(a[1], b[1]), 0)
            union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
            if w * h / union > limit:
                break
        else:
            kept.append(i)
    return sorted(kept)
