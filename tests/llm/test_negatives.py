"""Hard negatives against a comparison of every anchor with every row, and what the tree leaves out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoneflow.llm import negatives
from zoneflow.llm.negatives import Searches

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n, size, clusters, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, size))
    return np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)


def best(scores, ids, fits, k):
    order = sorted((-int(s), int(i)) for s, i, f in zip(scores, ids, fits, strict=True) if f)
    return [(-s, i) for s, i in order[:k]]


@pytest.mark.parametrize("spread", [0.02, 0.3, 5.0])
@pytest.mark.parametrize("same", [True, False])
def test_tree_finds_what_a_full_scan_finds(spread, same):
    x = clustered(3000, 8, 20, 7, spread)
    x[1000:1300] = x[5]  # a tenth are copies, more than a leaf holds
    ids, labels = np.arange(3000) * 3 % 3000, np.random.default_rng(1).integers(0, 4, 3000)
    asked = np.arange(0, 3000, 50)
    widest = np.iinfo(np.int64).max
    low = np.array([negatives.NONE + 1, 20_000, -5000, 60_000] * len(asked))
    high = np.array([2**62, 40_000, -100, widest] * len(asked))
    one = Searches(x[asked], ids[asked], labels[asked], np.repeat(np.arange(len(asked)), 4), low, high, 3, same)
    looked = [0]
    look = one.look

    def counted(part, *rest):
        looked[0] += len(part) * len(rest[2])
        look(part, *rest)

    one.look = counted
    negatives.search_block(x, ids, labels, [one])
    for u in range(len(low)):
        a = asked[u // 4]
        s = x @ x[a]
        fits = ((labels == labels[a]) == same) & (ids != ids[a]) & (s >= low[u]) & (s <= high[u])
        got = [(int(s), int(i)) for s, i in zip(one.score[u], one.id[u], strict=True) if s > negatives.NONE]
        assert got == best(s, ids, fits, 3)
    if spread < 0.1:
        assert looked[0] < 0.4 * len(low) * len(x)  # ranges leave out most of the rows


def test_ranges_hold_all_rows():
    x = clustered(2000, 6, 10, 3)
    squares = negatives._lengths(x)
    tree = negatives.build(x, squares, np.arange(len(x)), 50, 64, lambda rows: rows)
    for node in negatives._nodes(tree):
        k = len(node.points)
        assert k >= 2 and (node.low[np.diag_indices(k)] == 0).all() and (node.low <= node.high).all()


@pytest.mark.parametrize("size", [1, 2**20, 2**29, 2**40])
def test_products_are_exact(size):
    rng = random.Random(size)
    a, b = ([[rng.randint(-size, size) for _ in range(5)] for _ in range(4)] for _ in range(2))
    exact = [[sum(p * q for p, q in zip(r, s, strict=True)) for s in b] for r in a]
    got = negatives._products(np.array(a, np.int64), np.array(b, np.int64))
    clipped = [[min(max(v, -(2**62) + 1), 2**62) for v in r] for r in exact]
    assert got.astype(np.int64).tolist() == clipped


def brute(rows, every=10, positives=5, count=3, low=50, high=95):
    good = [(i, [math.floor(256 * c) for c in v], g) for i, v, g in rows
            if i is not None and g is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, x, g in good:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, h) for i, y, h in good if i != a]
        for s, i, _ in sorted(r for r in scored if r[2] == g)[:positives]:
            fits = sorted(r for r in scored if r[2] != g and low * -s <= 100 * -r[0] <= high * -s)
            out += [(a, i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits[:count])]
    return sorted(out)


def mined(frame, **more):
    found = negatives.mine_hard_negatives(frame, F.col("id") % 10 == 0, **more)
    return sorted(tuple(r) for r in found.collect())


def vectors(n=600, size=6, seed=9):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.4) for x in c]
        rows.append((i, [float(np.float32(x)) for x in v], rng.randrange(3)))
    for i in range(0, n, 3):  # a third have one vector
        rows[i] = (i, rows[0][1], rows[i][2])
    return rows


def test_equals_brute_force_in_one_block(spark):
    rows = vectors()
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_equals_brute_force_over_cells_blocks_and_slices(spark, monkeypatch):
    rows = vectors(900)
    monkeypatch.setattr(negatives, "LEAST_BLOCK", 40)
    monkeypatch.setattr(negatives, "BLOCKS", 1000)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * 6 * 40)  # 40 rows to a block, 40 anchors to a slice
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(7), positives=4, negatives=2, percent=(30, 120))
    assert got == brute(rows, positives=4, count=2, low=30, high=120)


def test_odd_rows(spark):
    rows = vectors(200)
    odd = [(1000, None, 1), (1010, [], 1), (1020, [1.0] * 5 + [None], 1), (1030, [float("nan")] * 6, 0),
           (1040, [float("inf")] * 6, 0), (1050, [1.0], 0), (1060, rows[3][1], None), (None, rows[3][1], 1),
           (1070, [0.0] * 6, 1), (1080, [-x for x in rows[0][1]], rows[0][2])]
    rows += [(i, v, g) for i, v, g in odd if i != 1050]
    more = [(1050, [1.0], 0), rows[7], rows[7]]  # of another length; repeated rows
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows + more], SCHEMA + ", q int, x string")
    assert mined(frame) == brute(rows + more[1:])
    assert mined(frame.limit(0)) == []
    one_label = spark.createDataFrame([(i, v, 1) for i, v, _ in vectors(50)], SCHEMA)
    assert mined(one_label) == []
