import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas import group_ops

import naive
from zoneflow.operators import chains, detections, matching, tracker, tracking
from zoneflow.params import Params
from zoneflow.schemas import DETECTION_ROWS


def make(spark, rows):
    """rows: (camera, frame, idx, x1, y1, x2, y2, confidence)"""
    full = [(c, f, i, 0, *map(float, box), s) for c, f, i, *box, s in rows]
    return spark.createDataFrame(full, DETECTION_ROWS)


def crowd(seed, frames, people=6, noise=6.0, cameras=(1, 2), skip=0.15, pauses=True):
    """Persons walking with noise, seen most of the time."""
    rng = random.Random(seed)
    rows = []
    for camera in cameras:
        at = [[rng.uniform(0, 900), rng.uniform(0, 500)] for _ in range(people)]
        for frame in range(1, frames + 1):
            idx = 0
            for p in at:
                p[0] += rng.uniform(-noise, noise) + 2
                p[1] += rng.uniform(-noise, noise)
                if rng.random() < 0.01:
                    p[:] = [rng.uniform(0, 900), rng.uniform(0, 500)]
                if rng.random() < skip or pauses and 40 < frame % 90 < 58:
                    continue
                rows.append((camera, frame, idx, p[0], p[1], p[0] + 60, p[1] + 120,
                             round(rng.uniform(0.41, 0.99), 3)))
                idx += 1
    return rows


def test_filter_is_strict_and_has_a_floor(spark):
    rows = [(1, 1, i, 0, 0, 9, 9, s) for i, s in enumerate([0.4, 0.41, 0.36])]
    df = make(spark, rows).withColumn("class_id", F.when(F.col("det_idx") == 3, 1).otherwise(0))
    got = [r.det_idx for r in detections.filter_detections(df, 0.35).collect()]
    assert got == [1]


def test_nms_equals_brute_force_in_both_forms(spark):
    rng = random.Random(5)
    rows = []
    for frame in range(1, 13):
        for i in range(rng.randrange(1, 25)):
            x, y = rng.uniform(0, 120), rng.uniform(0, 120)
            rows.append((1, frame, i, x, y, x + rng.uniform(0, 70), y + rng.uniform(0, 70),
                         rng.choice([0.5, 0.6, 0.7, 0.81])))
    expected = set()
    for frame in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == frame]
        boxes = []
        for r in mine:
            left, top = round(r[3]), round(r[4])
            boxes.append((r[7], (left, top, left + max(round(r[5] - r[3]), 1),
                                 top + max(round(r[6] - r[4]), 1))))
        expected |= {(frame, mine[i][2]) for i in naive.suppressed(boxes, 0.45)}
    df = make(spark, rows)
    assert {(r.frame_id, r.det_idx) for r in detections.nms(df).collect()} == expected
    frames = detections.nms_frames(detections.frame_rows(df))
    assert {(r.frame_id, d.det_idx) for r in frames.collect() for d in r.detections} == expected


def test_candidates_meet_in_cells_exactly_once(spark):
    rng = random.Random(8)

    def side(n):
        out = []
        for i in range(n):
            x, y = rng.uniform(-50, 400), rng.uniform(-50, 400)
            out.append((1, 1, i, x, y, x + rng.uniform(-5, 200), y + rng.uniform(-5, 200), 0.9))
        return out

    a, b = side(60), side(60)
    expected = {(i[2], j[2]) for i in a for j in b
                if i[5] > i[3] and i[6] > i[4] and naive_iou(i[3:7], j[3:7]) >= 0.3}
    tracks = make(spark, a).withColumnRenamed("det_idx", "track_idx")
    got = [(r.track_idx, r.det_idx) for r in matching.iou_candidates(tracks, make(spark, b), cell=64).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected


def naive_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union


def test_greedy_match_and_ties(spark):
    rows = [(1, 1, 1, 1, .9), (1, 1, 1, 2, .8), (1, 1, 2, 1, .85), (1, 2, 1, 1, .5), (1, 2, 2, 1, .5),
            (1, 2, 2, 2, .5)]
    df = spark.createDataFrame(rows, "camera_id long, frame_id long, track_idx long, det_idx long, iou double")
    got = {(r.frame_id, r.track_idx, r.det_idx) for r in matching.greedy_match(df).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (2, 2, 2)}


def run(spark, rows, span=512, warm_up=48):
    params = Params(frames_per_span=span)
    return tracking.track(make(spark, rows), params, warm_up=warm_up)


def test_tracks_are_confirmed_by_the_third_hit(spark):
    tracked = run(spark, [(1, f, 0, 10, 10, 50, 90, 0.9) for f in (1, 2, 3)])
    got = tracking.confirmed_tracks(tracked).collect()
    assert [(r.frame_id, r.track_id, r.x, r.y, r.w, r.h, r.cx, r.cy) for r in got] == [
        (3, 1, 10, 10, 40, 80, 30, 50)
    ]


def test_a_track_survives_twelve_frames_unseen(spark):
    box = (10, 10, 50, 90, 0.9)
    for gap, same in ((12, True), (13, False)):
        tracked = run(spark, [(1, 1, 0, *box), (1, 2 + gap, 0, *box)]).collect()
        assert (len({r.track_id for r in tracked}) == 1) is same


def test_boxes_are_smoothed_in_single_precision(spark):
    tracked = run(spark, [(1, 1, 0, 100, 10, 200, 90, 0.9), (1, 2, 0, 110, 10, 210, 90, 0.9)])
    assert tracked.filter("frame_id = 2").first().x1 == 106.5


def test_parallel_spans_equal_one_sequential_run(spark):
    rows = crowd(seed=4, frames=200) + crowd(seed=9, frames=120, cameras=(7,), noise=30.0, people=20)
    expected = {}
    for camera in {r[0] for r in rows}:
        frames = {}
        for r in rows:
            if r[0] == camera:
                frames.setdefault(r[1], []).append(r[3:7])
        for frame, items in naive.tracker(frames, max(frames)).items():
            for i, item in enumerate(items):
                expected[(camera, frame, i)] = item
    for span, warm_up in ((16, 14), (40, 30), (512, 48)):
        got = run(spark, rows, span, warm_up).collect()
        assert len(got) == len(expected)
        for r in got:
            track_id, hits, box = expected[(r.camera_id, r.frame_id, r.det_idx)]
            assert (r.track_id, r.hits, [r.x1, r.y1, r.x2, r.y2]) == (track_id, hits, box)


def test_numbers_over_composed_spans(spark, monkeypatch):
    """One camera of 300 spans with pauses, whose numbering is composed over several levels."""
    monkeypatch.setattr(chains, "GROUP", 4)
    rows = [r for r in crowd(seed=6, frames=300 * 16, noise=8.0, people=4, cameras=(1,))
            if not 900 < r[1] < 1100 and not 3000 < r[1] < 3016]
    frames, expected = {}, {}
    for r in rows:
        frames.setdefault(r[1], []).append(r[3:7])
    for frame, items in naive.tracker(frames, max(frames)).items():
        for i, item in enumerate(items):
            expected[(frame, i)] = item[:2]
    got = run(spark, rows, 16, 16).collect()
    assert {(r.frame_id, r.det_idx): (r.track_id, r.hits) for r in got} == expected


def test_wrong_guesses_take_few_rounds(spark):
    """64 spans of a jittering crowd, followed without a warm-up: each guess is wrong at first."""
    rows = crowd(seed=2, frames=64 * 16 - 1, noise=12.0, people=5, cameras=(1,), pauses=False)
    frames, expected, rounds = {}, {}, []
    for r in rows:
        frames.setdefault(r[1], []).append(r[3:7])
    for frame, items in naive.tracker(frames, max(frames)).items():
        for i, item in enumerate(items):
            expected[(frame, i)] = item
    got = tracking.track(make(spark, rows), Params(frames_per_span=16), warm_up=1, wrong_guesses=rounds)
    assert {(r.frame_id, r.det_idx): (r.track_id, r.hits, [r.x1, r.y1, r.x2, r.y2])
            for r in got.collect()} == expected
    assert rounds[0] >= 40 and len(rounds) <= 7


def test_spans_are_not_handed_over_one_by_one(spark, monkeypatch):
    """Most spans hold a few boxes: a task follows them as they come, without a data frame for each."""
    def refuse(*_, **__):
        raise AssertionError("one call for each group")

    monkeypatch.setattr(group_ops.PandasGroupedOpsMixin, "applyInPandas", refuse)
    monkeypatch.setattr(group_ops.PandasCogroupedOps, "applyInPandas", refuse)
    rows, rounds, expected = crowd(seed=2, frames=12 * 16, noise=12.0, people=5, cameras=(1,), pauses=False), [], {}
    frames = {}
    for r in rows:
        frames.setdefault(r[1], []).append(r[3:7])
    for frame, items in naive.tracker(frames, max(frames)).items():
        for i, item in enumerate(items):
            expected[(frame, i)] = item
    got = tracking.track(make(spark, rows), Params(frames_per_span=16), warm_up=1, wrong_guesses=rounds)
    assert {(r.frame_id, r.det_idx): (r.track_id, r.hits, [r.x1, r.y1, r.x2, r.y2])
            for r in got.collect()} == expected
    assert rounds[0] > 2


def test_groups_go_on_over_batches():
    batches = [pa.RecordBatch.from_pydict({"c": c, "s": s, "v": v}) for c, s, v in (
        ([None, 1, 1], [1, 1, 2], [1, 2, 3]), ([1, 1], [2, 2], [4, 5]), ([], [], []), ([1, 2], [3, 3], [6, 7]))]
    batches = [b.cast(pa.schema([(n, pa.int64()) for n in "csv"])) for b in batches]
    got = [(k["c"], k["s"], rows["v"].to_pylist()) for k, rows in tracking._groups(iter(batches), ["c", "s"])]
    assert got == [(None, 1, [1]), (1, 1, [2]), (1, 2, [3, 4, 5]), (1, 3, [6]), (2, 3, [7])]


def test_frames_with_few_and_many_pairs_agree_bit_for_bit(monkeypatch):
    rng = random.Random(12)
    frames = []
    for _ in range(80):
        boxes = []
        for place in rng.sample(range(9), 6):
            x, y = place % 3 * 60 + rng.choice([0, 0, 7.3]), place // 3 * 60 + rng.choice([0, 5.1])
            boxes.append([x, y, x + rng.uniform(-2, 90), y + 80])
        boxes[0][2] = rng.choice([float("nan"), float("inf"), 3.4e38, 50.0])
        frames.append(np.array(boxes, dtype=np.float32).tolist())
    seen = []
    for limit in (0, 10**9):
        monkeypatch.setattr(tracker, "FEW_PAIRS", limit)
        live = tracker.Live()
        seen.append(repr([live.see(boxes) for boxes in frames]))
    assert seen[0] == seen[1]
