"""Classifiers by held-out accuracy, fairness by twins, and odd rows."""

import os
import random
import zlib

import numpy as np
import odd
import pytest

from zoneflow.llm import labelled, quality, toxicity

GROUPS = ("women", "men", "girls", "boys")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def toxic_rows(n=400):
    """Insults are toxic; one group is named far more often in toxic texts than elsewhere."""
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(150)]
    out = []
    for i in range(n):
        bad = i % 3 == 0
        words = rng.choices(plain, k=rng.randint(8, 40))
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["IDIOT!", "moron,", "Scum"]))
        if rng.random() < (0.8 if bad else 0.05):
            words.insert(rng.randrange(len(words)), "women")
        out.append((i, " ".join(words), int(bad)))
    return out


def test_fold(spark):
    docs = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    for r in docs.select("doc_id", labelled.held_out().alias("h")).collect():
        assert r["h"] == held(r["doc_id"])


def test_training_labels_leave_out_the_fold_and_are_bounded(spark):
    rows = [(i, i % 2) for i in range(500)] + [(None, 1), (3, None), (4, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = labelled.training_labels(labels, "toxic", 10_000).collect()
    assert sorted(r["id"] for r in got) == [i for i in range(500) if not held(i)]
    few = labelled.training_labels(labels, "toxic", 50).collect()
    assert 0 < len(few) <= 100 and not any(held(r["id"]) for r in few)


def test_toxicity_held_out_and_fair(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, identity_terms=(GROUPS,))
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model).collect()}
    right = [got[i]["predicted"] == y for i, _, y in rows if held(i)]
    assert len(right) > 40 and np.mean(right) >= 0.97
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    biased = toxicity.fit_toxicity(docs, labels, identity_terms=(GROUPS,), fairness=0.0)

    def gap(m):
        scorer = toxicity.Scorer(m)
        logit = lambda t: np.log(scorer.score(t) / (1 - scorer.score(t)))
        neutral = "word1 word2 {} word3 word4"
        scores = [logit(neutral.format(g)) for g in GROUPS]
        return max(scores) - min(scores)

    assert gap(model) < 0.25 * gap(biased)
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_twins():
    kinds = (GROUPS, ("gay", "straight"))
    assert toxicity.twins("nothing here, womenfolk", kinds) == []
    assert toxicity.twins("Women and boys", kinds, swaps=1) == ["men and women"]


def quality_rows(n=600):
    rng = random.Random(9)
    out = []
    for i in range(n):
        words = [f"wo{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(20, 90))]
        kind = rng.choice([0, 0, 0, 0, 1, 2, 3])
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif kind == 2:
            words = [w + "###" for w in words]
        elif kind == 3:
            words = words[:3] * 20
        out.append((i, " ".join(words), int(kind == 0)))
    return out


def test_quality_held_out(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, trusted int")
    # Half of the labels are missing; of the others only the positives are used.
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    right = [got[i]["predicted"] == y for i, _, y in rows if held(i)]
    assert len(right) > 80 and np.mean(right) >= 0.95
    positives = labels.filter("quality = 1")
    same = {r["doc_id"]: r for r in quality.quality_scores(docs, positives).collect()}
    assert all(abs(same[i]["score"] - got[i]["score"]) < 1e-6 for i in got)


def test_quality_prior(spark):
    rows = quality_rows(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, quality int")
    model = quality.fit_quality(quality.measure(docs, labels))
    truth = np.mean([y for i, _, y in rows if not held(i)])
    assert abs(model.prior - truth) < 0.2


def test_odd_rows(spark):
    docs = odd.frame(spark)
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (5, None, None), (999, 1, 0)],
        "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    ids = sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    for given in (labels, none):
        model = toxicity.fit_toxicity(docs, given)
        for got in (toxicity.toxicity_scores(docs, model), quality.quality_scores(docs, given)):
            rows = got.collect()
            assert sorted(str(r["doc_id"]) for r in rows) == ids
            assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert toxicity.toxicity_scores(odd.empty(spark), model).count() == 0
        assert toxicity.drop_toxic(odd.empty(spark), model).count() == 0
    assert quality.quality_scores(odd.empty(spark), labels).count() == 0


def plain_risk(weights, x, trusted, prior):
    """The non-negative unbiased risk with its ridge, and its gradient, written down directly."""
    z = x @ weights
    p = 1 / (1 + np.exp(-z))
    positive, negative = np.logaddexp(0, -z[trusted]).mean(), np.logaddexp(0, z[trusted]).mean()
    unlabelled = np.logaddexp(0, z).mean()
    ridge = quality.RIDGE * np.append(np.ones(x.shape[1] - 1), 0.0)
    down = ((p - 1)[trusted, None] * x[trusted]).mean(0)
    up = (p[trusted, None] * x[trusted]).mean(0)
    rest = unlabelled - prior * negative
    gradient = prior * down + ridge * weights
    if rest >= 0:
        gradient = gradient + (p[:, None] * x).mean(0) - prior * up
    return prior * positive + max(0.0, rest) + (ridge * weights**2).sum() / 2, gradient


def test_quality_risk_is_that_of_a_plain_descent(spark):
    """Newton steps over tasks, of which there are STEPS at most, come near the risk that 3000 steps of
    descent in one numpy array reach (0.093 against 0.069, from 0.693), where the risk has a kink."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no data")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    measured = quality.measure(docs, labels)
    model = quality.fit_quality(measured)
    rows = measured.filter("not held_out").collect()
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]).astype(float)
    trusted = np.array([r["trusted"] for r in rows])
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect() if not held(r["doc_id"])}
    assert 10 < trusted.sum() == sum(r["id"] in good for r in rows)
    x = np.hstack([(x - x.mean(0)) / (x.std(0) + 1e-2), np.ones((len(x), 1))])
    weights = np.append(np.zeros(x.shape[1] - 1), np.log(model.prior / (1 - model.prior)))
    rate, (best, gradient) = 1.0, plain_risk(weights, x, trusted, model.prior)
    for _ in range(3000):
        new = weights - rate * gradient
        risk, slope = plain_risk(new, x, trusted, model.prior)
        if risk > best:
            rate /= 2
            continue
        weights, best, gradient, rate = new, risk, slope, rate * 1.05
    fitted = plain_risk(model.weights, x, trusted, model.prior)[0]
    start = plain_risk(np.zeros(x.shape[1]), x, trusted, model.prior)[0]
    assert best < 0.7 * start and fitted <= best + 0.05 * start
