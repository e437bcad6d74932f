"""Quality by positive-unlabelled learning.

Trusted positives are the rows labelled 1 outside of the held-out fold; all other documents outside of
it are unlabelled web text, whatever they are labelled. A linear model of a few dozen measures of a
text minimises the non-negative unbiased risk

    pi * E_P[l(z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)]),   l(z) = log(1 + exp(-z)),

by Newton steps. Every step is one pass of all tasks over the written measures, which sends one
gradient and one small matrix per task. The class prior pi is estimated first: the least ratio of the
shares of unlabelled and positive documents above a score, over the scores of a model that tells
positives from unlabelled documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.labelled import held_out, training_labels
from zoneflow.session import materialize

MAX_ROWS = 200_000  # trusted positives
BINS = 200
STEPS = 14  # passes over the measures
RIDGE = 1e-3
LEAST_SHARE = 0.02  # of the positives above a score that may estimate the prior

_KINDS = np.zeros((256, 9), bool)  # kinds of bytes: the measures' names are in NAMES
_KINDS[ord("A"):ord("Z") + 1, 0] = True
_KINDS[ord("0"):ord("9") + 1, 1] = True
for _k, _set in enumerate((b"|", b"!?", b"#$%&*", b".,;:", b"\n\t", b"<>{}[]()=\\/_@~^+"), 2):
    _KINDS[list(_set), _k] = True
_KINDS[128:, 8] = True
NAMES = ("upper", "digit", "bar", "shout", "symbol", "stop", "break", "code", "wide")


def measures(text: str) -> list[float]:
    """Measures of a whole text, the same for every length in kind."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KINDS / n
    words = text.split()
    count = len(words)
    several = max(1, count)
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:])) / max(1, count - 1)
    shouted = sum(map(str.isupper, words)) / several
    plain = sum(map(str.isalpha, words)) / several
    spread = math.log1p(distinct) / math.log1p(count) if count else 1.0
    lines = text.split("\n")
    repeated = 1 - len(set(lines)) / len(lines)
    out = [math.log1p(count), len(data) / several / 10, spread, again, shouted, plain, repeated,
           float(count == 0)]
    out += shares.tolist()
    out += [min(1.0, 10 * x) for x in (again, shouted, repeated, *shares.tolist())]
    return out


SIZE = len(measures(""))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(measures(t.as_py() or ""), np.float32).tobytes()
                for t in batch.column("content")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("held_out"), batch.column("trusted"),
             pa.array(rows, pa.binary())],
            names=["id", "held_out", "trusted", "x"],
        )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    rows = b"".join(batch.column("x").to_pylist())
    return np.frombuffer(rows, np.float32).reshape(-1, SIZE).astype(float)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([(x - mean) / scale, np.ones((len(x), 1))])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _summed(measured: DataFrame, statistic, size: int) -> np.ndarray:
    """Sum over all tasks of ``statistic(x, trusted)``, an array of ``size`` numbers per task."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            total += statistic(_matrix(batch), trusted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size)), pa.array(total)], names=["k", "value"]
        )

    rows = measured.select("trusted", "x").mapInArrow(per_task, "k long, value double")
    out = np.zeros(size)
    for row in rows.groupBy("k").agg(F.sum("value").alias("value")).collect():  # ``size`` rows
        out[row["k"]] = row["value"]
    return out


class Model:
    def __init__(self, mean, scale, weights, prior: float) -> None:
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = _scaled(x, self.mean, self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _newton(measured, mean, scale, positives: float, others: float, prior: float | None, weights):
    """Newton steps on the risk, halved where it grows; without a prior, on the loss of telling
    positives from unlabelled documents, both classes of equal weight."""
    d = SIZE + 1

    def statistic(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        x = _scaled(x, mean, scale)
        z = np.clip(x @ weights, -30, 30)
        p = 1 / (1 + np.exp(-z))
        # All documents are a sample of the web, the trusted ones too.
        sums = x.T @ p
        matrix = (x * (p * (1 - p))[:, None]).T @ x
        own, q = x[trusted], p[trusted]
        own_matrix = (own * (q * (1 - q))[:, None]).T @ own
        risks = [_softplus(z).sum(), _softplus(z[trusted]).sum(), _softplus(-z[trusted]).sum()]
        return np.concatenate([
            sums, own.sum(0), own.T @ q, risks, matrix.ravel(), own_matrix.ravel()
        ])

    ridge = RIDGE * np.append(np.ones(SIZE), 0.0)
    best, best_risk = weights, math.inf
    for _ in range(STEPS):
        s = _summed(measured, statistic, 3 * d + 3 + 2 * d * d)
        all_p, own_x, own_p = s[:d] / others, s[d:2 * d] / positives, s[2 * d:3 * d] / positives
        risk_u, risk_n, risk_p = s[3 * d:3 * d + 3] / np.array([others, positives, positives])
        matrix = s[3 * d + 3:3 * d + 3 + d * d].reshape(d, d) / others
        own_matrix = s[3 * d + 3 + d * d:].reshape(d, d) / positives
        penalty = (ridge * weights * weights).sum() / 2
        if prior is None:
            risk = (risk_u + risk_p) / 2
            gradient, hessian = (all_p + own_p - own_x) / 2, (matrix + own_matrix) / 2
        elif risk_u - prior * risk_n >= 0:
            risk = prior * risk_p + risk_u - prior * risk_n
            gradient, hessian = all_p - prior * own_x, matrix
        else:  # the risk of negatives has turned negative and counts as nothing
            risk = prior * risk_p
            gradient, hessian = prior * (own_p - own_x), prior * own_matrix
        if risk + penalty > best_risk:
            weights = (weights + best) / 2
            continue
        best, best_risk = weights, risk + penalty
        step = np.linalg.solve(hessian + np.diag(ridge + 1e-6), gradient + ridge * weights)
        length = np.abs(step).max()
        if length < 1e-4:
            break
        weights = weights - step * min(1.0, 2.0 / length)
    return best


def estimate_prior(measured, mean, scale, weights) -> float:
    """Least ratio of unlabelled to positive documents above a score."""

    def histogram(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        z = _scaled(x, mean, scale) @ weights
        place = np.minimum((BINS / (1 + np.exp(-np.clip(z, -30, 30)))).astype(int), BINS - 1)
        return np.concatenate([np.bincount(place, minlength=BINS),
                               np.bincount(place[trusted], minlength=BINS)])

    counts = _summed(measured, histogram, 2 * BINS).reshape(2, BINS)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    shares = above / np.maximum(above[:, :1], 1)
    usable = shares[1] >= LEAST_SHARE
    # A margin for the noise of either share, so that a thin tail does not decide.
    noise = sum(np.sqrt(np.maximum(s * (1 - s), 1e-9) / max(1.0, a[0]))
                for s, a in zip(shares, above, strict=True))
    ratio = (shares[0] + noise) / np.maximum(shares[1], 1e-9)
    return float(np.clip(ratio[usable].min(initial=1.0), 0.05, 0.95))


def fit_quality(measured: DataFrame) -> Model:
    """A model from the measured documents outside of the held-out fold (``measure``)."""
    train = measured.filter("not held_out")

    def moments(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        return np.concatenate([x.sum(0), (x * x).sum(0), [len(x), trusted.sum()]])

    s = _summed(train, moments, 2 * SIZE + 2)
    others, positives = max(1.0, s[-2]), max(1.0, s[-1])
    mean = s[:SIZE] / others
    scale = np.sqrt(np.maximum(s[SIZE:2 * SIZE] / others - mean**2, 0)) + 1e-2
    start = np.zeros(SIZE + 1)
    if not s[-1]:
        return Model(mean, scale, start, 0.5)
    telling = _newton(train, mean, scale, positives, others, None, start)
    prior = estimate_prior(train, mean, scale, telling)
    start = np.append(np.zeros(SIZE), math.log(prior / (1 - prior)))
    return Model(mean, scale, _newton(train, mean, scale, positives, others, prior, start), prior)


def measure(
    docs: DataFrame, labels: DataFrame, label_column: str = "quality", max_rows: int = MAX_ROWS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Measures of all documents, written to the shared folder, with ``trusted`` and ``held_out``."""
    trusted = training_labels(labels, label_column, max_rows, id_column).filter("y = 1").select(
        "id", F.lit(True).alias("trusted")
    )
    rows = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"),
                       F.col(text_column).alias("content"))
    kind = rows.schema["id"].dataType.simpleString()
    measured = rows.withColumn("trusted", F.lit(False)).mapInArrow(
        _measured, f"id {kind}, held_out boolean, trusted boolean, x binary"
    ).drop("trusted")
    joined = materialize(measured).join(trusted, "id", "left")
    return materialize(joined.withColumn("trusted", F.coalesce("trusted", F.lit(False))))


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_column: str = "quality",
    max_rows: int = MAX_ROWS, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score``, ``predicted``.

    A null text counts as empty. Labels with a null column and labels without a document are passed
    over; without any positive label every score is one half. Ids may be null (never trusted) or
    repeat; other columns are not read; an empty table gives an empty result.
    """
    measured = measure(docs, labels, label_column, max_rows, id_column, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(measured))  # a few dozen numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"),
                 pa.array(shared.value.score(_matrix(batch)), pa.float64())],
                names=["id", "held_out", "score"],
            )

    kind = measured.schema["id"].dataType.simpleString()
    scored = measured.select("id", "held_out", "x").mapInArrow(
        score, f"id {kind}, held_out boolean, score double"
    )
    return scored.select(F.col("id").alias(id_column), "held_out", "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
