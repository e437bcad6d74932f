"""Whitening by incremental eigendecomposition.

Each task keeps the eigenvalues and eigenvectors of the scatter of the rows it has seen about their
mean. Rows come in blocks; a block's centred rows are turned into the rows of a triangle with the same
scatter, and each of those is a rank-one update: the new eigenvalues are the roots of the secular
equation, entries that cannot move them are deflated, and vectors are taken from recomputed weights so
that they stay orthogonal. One more update moves the mean. Spectra of tasks are combined in the same
way, by an update per eigenpair and one for the means, in groups of ``FAN``.

The result is a basis close to the eigenvectors. A last pass over all rows takes the covariance in
that basis, exactly centred, and solves it (Rayleigh-Ritz), which gives them to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow.llm.vectors import finite_rows, matrix, whole
from zoneflow.session import materialize, release

COMPONENTS = 32
BLOCK = 1024  # rows whose scatter becomes one triangle
FAN = 16  # partial results combined in one task
ROUNDS = 60  # steps of a root; eight are usual
STATE = "part long, n long, sums array<string>, state binary"  # sums in digits: longer than a long
EPS = np.finfo(float).eps


# ---- one update --------------------------------------------------------------------------------


def _roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(weights / (poles - x))``: the pole each is measured from, and the distance.

    ``poles`` ascend strictly, ``weights`` are positive. Each root lies between a pole and the next,
    the last one above all. Steps solve a function with the two poles beside the root and the same
    value and slope; a step that leaves the bracket is halved into it.
    """
    k = len(poles)
    ends = np.append(poles[1:], poles[-1] + weights.sum())
    half = (ends - poles) / 2
    gaps = poles[:, None] - poles[None, :]  # pole i from pole j
    left = 1 + (weights[:, None] / (gaps - half)).sum(0) >= 0
    left[-1] = True
    at = np.arange(k) + ~left
    gaps = poles[:, None] - poles[at][None, :]
    low = np.where(left, 0.0, -half)
    high = np.where(left, half, 0.0)
    high[-1] = 2 * half[-1]
    below = np.arange(k)[:, None] <= np.arange(k)[None, :]
    near, far = gaps[np.arange(k), np.arange(k)], np.append(gaps[np.arange(1, k), np.arange(k - 1)], 0.0)
    x = (low + high) / 2
    for _ in range(ROUNDS):
        apart = gaps - x
        part = weights[:, None] / apart
        value = 1 + part.sum(0)
        slopes = part / apart
        lower = np.where(below, slopes, 0).sum(0)
        upper = slopes.sum(0) - lower
        high = np.where(value > 0, x, high)
        low = np.where(value > 0, low, x)
        a, b = near - x, far - x
        c = value - a * lower - b * upper
        p = (a + b) * value - a * b * (lower + upper)
        q = a * b * value
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step[-1] = a[-1] * value[-1] / (value[-1] - a[-1] * lower[-1])
        new = x + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        moved = np.abs(new - x)
        sure = np.abs(value) <= 8 * EPS * (1 + np.abs(part).sum(0))
        x = np.where(sure, x, new)
        if (sure | (moved <= 4 * EPS * np.abs(x)) | (high - low <= 4 * EPS * np.abs(x))).all():
            break
    return at, x


def rank_one(values: np.ndarray, axes: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of ``axes diag(values) axes' + v v'``."""
    z = axes.T @ v
    length = float(np.sqrt(z @ z))
    scale = max(values[-1], length * length)
    if length == 0 or scale == 0:
        return values, axes
    small = 8 * EPS * scale
    close = np.diff(values) <= small
    if close.any():
        axes = axes.copy()
        starts = np.flatnonzero(~np.append(False, close))
        for i, j in zip(starts, np.append(starts[1:], len(values)), strict=True):
            if j - i > 1:  # turn the eigenvectors of one value until one of them holds all of z
                u = z[i:j].copy()
                size = np.sqrt(u @ u)
                sign = 1.0 if u[-1] >= 0 else -1.0
                u[-1] += sign * size
                if u @ u > 0:
                    axes[:, i:j] -= np.outer(axes[:, i:j] @ u, 2 * u / (u @ u))
                z[i:j] = 0
                z[j - 1] = -sign * size
    moves = np.abs(z) * length > small
    if not moves.any():
        return values, axes
    poles, z = values[moves], z[moves]
    at, x = _roots(poles, z * z)
    k = len(poles)
    apart = (poles[:, None] - poles[at][None, :]) - x  # pole i less root j
    apart = np.where(apart == 0, -EPS * scale, apart)
    # Weights for which these roots are exact; a pole's own factor pairs with the last root.
    others = np.arange(k - 1)[None, :] + (np.arange(k - 1)[None, :] >= np.arange(k)[:, None])
    ratios = -apart[:, :-1] / (poles[others] - poles[:, None])
    exact = np.sqrt(np.abs(-apart[:, -1] * ratios.prod(1)))
    turn = np.copysign(exact, z)[:, None] / apart
    turn /= np.sqrt((turn * turn).sum(0))
    new = values.copy()
    new[moves] = poles[at] + x
    axes = axes.copy()
    axes[:, moves] = axes[:, moves] @ turn
    order = np.argsort(new, kind="stable")
    return new[order], axes[:, order]


@dataclass
class Spectrum:
    """Mean, and eigenpairs of the scatter about it, of ``n`` rows."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    axes: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def _update(self, terms: np.ndarray, n: int, mean: np.ndarray) -> Spectrum:
        """With ``n`` rows of that mean whose scatter is ``terms' terms``."""
        total = self.n + n
        shift = mean - self.mean
        values, axes = self.values, self.axes
        for term in (*terms, np.sqrt(self.n * n / total) * shift):
            values, axes = rank_one(values, axes, term)
        return Spectrum(total, self.mean + shift * (n / total), np.maximum(values, 0), axes)

    def with_rows(self, rows: np.ndarray) -> Spectrum:
        origin = rows[0].copy()
        near = rows - origin
        mean = near.mean(0)
        return self._update(np.linalg.qr(near - mean, mode="r"), len(rows), origin + mean)

    def combined(self, other: Spectrum) -> Spectrum:
        terms = np.sqrt(other.values)[:, None] * other.axes.T
        return self._update(terms[other.values > 0], other.n, other.mean)

    def packed(self) -> bytes:
        return np.concatenate([self.mean, self.values, self.axes.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, n: int, state: bytes, size: int) -> Spectrum:
        flat = np.frombuffer(state)
        return cls(int(n), flat[:size], flat[size:2 * size], flat[2 * size:].reshape(size, size))


# ---- sums over all rows ------------------------------------------------------------------------


def _partial(n: int, sums: list[int], state: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()),
         pa.array([[str(s) for s in sums]], pa.list_(pa.string())), pa.array([state], pa.binary())],
        names=["part", "n", "sums", "state"],
    )


def _in_groups(states: DataFrame, merge: Callable[[pd.DataFrame], bytes]):
    """One row from the partial ones, ``FAN`` at a time; None from none."""
    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        sums = [str(sum(map(int, c))) for c in zip(*rows["sums"], strict=True)]
        return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN], "n": [rows["n"].sum()],
                             "sums": [sums], "state": [merge(rows)]})

    states = materialize(states)
    while states.count() > 1:
        fewer = materialize(states.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merged, STATE))
        release(states)
        states = fewer
    found = states.first()
    release(states)
    return found


def _added(rows: pd.DataFrame) -> bytes:
    total = 0.0
    for state in rows["state"]:
        total = total + np.frombuffer(state)
    return total.tobytes()


@dataclass
class Whitening:
    n: int
    origin: np.ndarray  # whole parts of the means
    rest: list[int]  # sums less n times the origin, from 0 to n - 1
    trace: float
    values: np.ndarray  # eigenvalues of the covariance, falling
    axes: np.ndarray  # entry x component
    error: float = 0.0  # largest entry of the whitened covariance less the identity

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.origin) - np.array([r / max(1, self.n) for r in self.rest])

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """A component without variance is 0 everywhere."""
        scale = np.zeros(len(self.values))
        np.divide(1.0, np.sqrt(self.values), out=scale, where=self.values > 0)
        return (self.centred(rows) @ self.axes) * scale

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sum of the squares of ``n * x - sums``, exact; None if that is no long."""
        near, n, rest = rows - self.origin, self.n, sum(r * r for r in self.rest)
        widest = int(np.abs(near).max(initial=0)) + 1
        if near.shape[1] * widest * widest * n * n < 2**62 and n < 2**31:
            apart = n * near - np.array(self.rest, np.int64)
            return (apart * apart).sum(1).tolist()
        found = []
        for row in near.tolist():
            exact = n * n * sum(u * u for u in row) + rest
            exact -= 2 * n * sum(u * r for u, r in zip(row, self.rest, strict=True))
            found.append(exact if exact < 2**63 else None)
        return found


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From ``rows`` with one column ``x`` of whole-number vectors of one length; None without rows.

    The driver gets one spectrum, and matrices of entries x entries. An update takes the cube of the
    number of entries, so this is meant for vectors of some hundred of them.
    """
    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                block = matrix(batch.column("x").slice(start, BLOCK))
                found = Spectrum.empty(block.shape[1]) if found is None else found
                totals = _totals(block)
                sums = totals if sums is None else [a + b for a, b in zip(sums, totals, strict=True)]
                found = found.with_rows(block.astype(float))
        if found is not None:
            yield _partial(found.n, sums, found.packed())

    def combine(states: pd.DataFrame) -> bytes:
        found = None
        for n, state, sums in zip(states["n"], states["state"], states["sums"], strict=True):
            one = Spectrum.unpacked(n, state, len(sums))
            found = one if found is None else found.combined(one)
        return found.packed()

    first = _in_groups(rows.mapInArrow(spectra, STATE), combine)
    if first is None:
        return None
    n, sums = first["n"], [int(s) for s in first["sums"]]
    size = len(sums)
    basis = np.linalg.qr(Spectrum.unpacked(n, bytes(first["state"]), size).axes[:, ::-1])[0]
    whole_part = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole_part, strict=True)]
    draft = Whitening(n, np.array(whole_part, np.int64), rest, 0.0, np.ones(size), basis)
    square = _squares(rows, draft, draft_only=True) / n
    values, turn = np.linalg.eigh((square + square.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    trace = float(np.trace(square))
    values = np.where(values > 4 * size * EPS * max(values[0], 0.0), values, 0.0)
    kept = min(components, size)
    model = Whitening(n, draft.origin, draft.rest, trace, values[:kept], (basis @ turn)[:, :kept])
    live = model.values > 0
    seen = _squares(rows, model) / n
    model.error = float(np.abs(seen - np.eye(kept))[live][:, live].max(initial=0.0))
    return model


def _totals(block: np.ndarray) -> list[int]:
    """Sums of the columns, as Python's whole numbers where a long might not hold them."""
    if len(block) and int(np.abs(block).max(initial=0)) < 2**62 // len(block):
        return block.sum(0).tolist()
    return [sum(c) for c in zip(*block.tolist(), strict=True)]


def _squares(rows: DataFrame, model: Whitening, draft_only: bool = False) -> np.ndarray:
    """Sum over all rows of the products of their components: whitened ones, or plain projections."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # entries x entries
    size = model.axes.shape[1]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, n = shared.value, np.zeros((size, size)), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                block = matrix(batch.column("x").slice(start, BLOCK))
                seen = known.centred(block) @ known.axes if draft_only else known.whitened(block)
                total += seen.T @ seen
                n += len(block)
        if n:
            yield _partial(n, [], total.tobytes())

    found = _in_groups(rows.mapInArrow(squares, STATE), _added)
    shared.unpersist()
    return np.frombuffer(bytes(found["state"])).reshape(size, size)


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = 64, offset: int = 1_000_000,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> tuple[DataFrame, Whitening | None]:
    """The rows that take part (see ``finite_rows``): the id, ``n``, ``deviation`` and ``whitened``,
    an array with an entry per component; and what was fitted.

    An entry counts as the whole number ``floor(scale * entry) + offset`` (see ``vectors.whole``). ``n`` is the number of rows,
    ``deviation`` the exact sum of the squares of ``n * x - sum of x``, null if it is no long. Repeated
    rows count each, ids may be null, other columns are not read; without any row that takes part the
    result is empty. Components without variance are 0 in all rows.
    """
    rows = finite_rows(vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")), "v")
    rows = rows.select("id", whole("v", scale, offset).alias("x"))
    model = fit_whitening(rows.select("x"), components)
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.withColumnRenamed("id", id_column), None
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                block = matrix(part.column("x"))
                seen = known.whitened(block)
                offsets = np.arange(len(block) + 1, dtype=np.int32) * seen.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(seen.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([known.n] * len(block), pa.int64()),
                     pa.array(known.deviations(block), pa.int64()), lists], names=schema.names)

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_column), model


def explode_components(rows: DataFrame, model: Whitening | None, id_column: str = "vec_id") -> DataFrame:
    """One row per row and component of what ``whiten`` gives, with the component's share of the variance."""
    shares, error = [], 0.0
    if model is not None:
        shares, error = [float(e / model.trace) if model.trace > 0 else 0.0 for e in model.values], model.error
    known = F.array(*[F.lit(s) for s in shares]) if shares else F.array().cast("array<double>")
    return rows.select(id_column, "n", "deviation", F.posexplode("whitened").alias("place", "value")).select(
        id_column, (F.col("place") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.get(known, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
