"""Every registered query against its SQL counterpart, over the whole tables of one folder."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")
QUERIES = {name: q for name, q in entry.queries().items() if name in entry.catalog.QUERIES}
SQL = {name: q for name, q in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip(f"no data at {DATA}")
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        table = name.removesuffix(".parquet")
        connection.execute(f"create view {table} as select * from '{DATA}/{name}'")
    return connection


def canonical(rows):
    def key(row):
        return [(v is None, str(type(v)) if isinstance(v, (str, bool)) else "", v if v is not None else 0)
                for v in row]

    for row in rows:
        assert not any(isinstance(v, float) and math.isnan(v) for v in row)
    return sorted(rows, key=key)


def test_names_agree():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    assert canonical([tuple(r[c] for c in columns) for r in df.collect()]) == canonical(expected)


def test_entry(spark):
    if not os.path.isdir(entry.ENTRY_DATA):
        pytest.skip("no data")
    assert entry.entry(spark).count() > 0


def test_end_to_end_equals_the_steps_on_collected_rows(spark):
    """Alerts by the plain tracker of ``naive`` and the metrics of its tracks."""
    import naive
    from zoneflow.operators import alerts as al
    from zoneflow.operators import detections, frames
    from zoneflow.plans.derived import Derived

    if not os.path.isdir(DATA):
        pytest.skip(f"no data at {DATA}")
    d = Derived(spark, DATA)
    boxes = {}
    clean = detections.nms(detections.filter_detections(d.detections()))
    for r in sorted(clean.collect(), key=lambda r: (r.camera_id, r.frame_id, r.det_idx)):
        boxes.setdefault(r.camera_id, {}).setdefault(r.frame_id, []).append((r.x1, r.y1, r.x2, r.y2))
    rows = []
    for camera, by_frame in boxes.items():
        for frame, items in naive.tracker(by_frame, max(by_frame)).items():
            for track, hits, box in items:
                if hits >= 3:
                    x1, y1, x2, y2 = (int(round(v)) for v in box)
                    x, y = max(x1, 0), max(y1, 0)
                    w, h = max(x2, x) - x, max(y2, y) - y
                    rows.append((camera, frame, track, x, y, w, h, x + w // 2, y + h // 2))
    tracks = spark.createDataFrame(
        rows, "camera_id long, frame_id long, track_id long, x int, y int, w int, h int, cx int, cy int")
    raised = al.explode_alerts(frames.frame_metrics(tracks, d.frames()), d.cameras())
    columns = ("camera_id", "frame_id", "type", "message", "risk")
    expected = sorted(tuple(r[c] for c in columns) for r in al.suppress_repeats(raised).collect())
    assert sorted(tuple(r) for r in QUERIES["end_to_end"](spark, DATA).collect()) == expected
