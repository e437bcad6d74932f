"""Whitening against numpy's own eigenvectors, exact whole numbers, and odd rows."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from zoneflow.llm import whitening
from zoneflow.llm.whitening import Spectrum, rank_one

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["dense", "sparse", "equal", "tiny"])
def test_rank_one_updates(size, kind):
    rng = np.random.default_rng(size)
    values, axes, exact = np.zeros(size), np.eye(size), np.zeros((size, size))
    for i in range(120):
        v = rng.normal(size=size)
        if kind == "sparse":
            v *= rng.random(size) < 0.3
        elif kind == "equal":
            v = np.zeros(size)
            v[i % size] = 2.0
        elif kind == "tiny":
            v *= 10.0 ** -rng.integers(0, 12)
        exact += np.outer(v, v)
        values, axes = rank_one(values, axes, v)
        assert (np.diff(values) >= 0).all()
        assert np.abs(axes.T @ axes - np.eye(size)).max() < 1e-12
        assert np.abs(axes * values @ axes.T - exact).max() <= 1e-12 * max(np.abs(exact).max(), 1e-300)


def test_spectra_combine_in_any_cut():
    rng = np.random.default_rng(3)
    rows = rng.integers(-40, 40, (900, 12)) + 1_000_000.0
    rows[300:600] = rows[0]  # a third are copies
    whole = np.cov(rows.T, bias=True) * len(rows)
    for cuts in ([0, 900], [0, 1, 2, 450, 900], list(range(0, 901, 100))):
        found = None
        for a, b in zip(cuts, cuts[1:], strict=False):
            one = Spectrum.empty(12).with_rows(rows[a:b])
            found = one if found is None else found.combined(one)
        assert found.n == 900 and np.abs(found.mean - rows.mean(0)).max() < 1e-6
        assert np.abs(found.axes * found.values @ found.axes.T - whole).max() < 1e-9 * whole.max()


def vectors(n=700, size=40, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size)) * np.linspace(2, 0.5, size)
    base[: n // 3] = base[0]
    return [(i, [float(np.float32(x)) for x in row], i % 3) for i, row in enumerate(base)]


def brute(rows, components=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(r, sums, strict=True)] for r in x])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    return n, deviation, centred @ axes[:, :components] / np.sqrt(e[:components]), e / e.sum()


def test_equals_numpy(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(37)  # more than FAN tasks
    n, deviation, white, shares = brute(rows)
    got = {}
    for r in whitening.explode_components(*whitening.whiten(frame)).collect():
        got[r["vec_id"], r["component"]] = r
    assert len(got) == n * 32
    for k in range(32):
        own = np.array([got[i, k + 1]["whitened"] for i in range(n)])
        sign = np.sign(own @ white[:, k])
        assert np.abs(sign * own - white[:, k]).max() < 1e-8
        assert got[0, k + 1]["explained"] == pytest.approx(shares[k], rel=1e-9)
    assert all(r["deviation"] == deviation[i] and r["n"] == n for (i, _), r in got.items())
    assert len({r["identity_error"] for r in got.values()}) == 1 and got[0, 1]["identity_error"] < 1e-9


def test_odd_rows(spark):
    rng = random.Random(1)
    good = [(i, [rng.uniform(-1, 1) for _ in range(4)], 1) for i in range(20)]
    good += [good[3], good[3], (None, [0.5, -0.5, 0.25, 1.0], None)]
    bad = [(50, None, 1), (51, [], 1), (52, [1.0, None, 1.0, 1.0], 1), (53, [1.0, float("nan"), 0.0, 0.0], 1),
           (54, [float("inf"), 0.0, 0.0, 0.0], 1), (55, [1.0, 2.0], 1), (56, [-float("inf")] * 4, None)]
    frame = spark.createDataFrame(
        [(*r, "clash", 1.5) for r in good + bad], SCHEMA + ", n string, whitened double")
    rows, model = whitening.whiten(frame)
    got = rows.collect()
    n, deviation, white, _ = brute(good)
    assert len(got) == n == model.n and rows.columns == ["vec_id", "n", "deviation", "whitened"]
    assert sorted(r["deviation"] for r in got) == sorted(deviation)
    assert all(len(r["whitened"]) == 4 for r in got) and model.error < 1e-9
    nothing, none = whitening.whiten(frame.filter("vec_id >= 50 and vec_id <> 55"))
    assert none is None and nothing.count() == 0
    assert whitening.explode_components(nothing, none).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_without_variance(spark):
    """Equal rows, and fewer rows than entries: components without variance are 0."""
    same = spark.createDataFrame([(i, [0.5, 0.25, 0.0], 0) for i in range(50)], SCHEMA)
    rows = whitening.explode_components(*whitening.whiten(same)).collect()
    assert len(rows) == 150 and {(r["whitened"], r["explained"], r["deviation"]) for r in rows} == {(0.0, 0.0, 0)}
    few = [(i, [float(x) for x in np.random.default_rng(i).normal(size=10)], 0) for i in range(4)]
    rows, model = whitening.whiten(spark.createDataFrame(few, SCHEMA))
    assert (model.values > 0).sum() == 3 and model.error < 1e-9
    assert all(r["whitened"][3:] == [0.0] * 7 for r in rows.collect())


def test_numbers_beyond_a_long(spark):
    big = [(i, [float(2**40 * (i + 1)), float(-(2**39) * i * i)], 0) for i in range(6)]
    n, deviation, _, _ = brute(big)
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(big, SCHEMA))[0].collect()}
    assert all(got[i]["deviation"] == (d if d < 2**63 else None) for i, d in enumerate(deviation))
    huge = spark.createDataFrame([(1, [3e38], 0), (2, [-3e38], 0), (3, [0.0], 0)], SCHEMA)
    assert whitening.whiten(huge)[0].count() == 3
