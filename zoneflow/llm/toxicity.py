"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and word beginnings, fitted to a bounded sample of labelled
rows. For each labelled text that names a group of people, twins are made in which the name is swapped
for others of its kind; differences between the scores of twins are penalised, so a neutral mention of
a group earns no score of its own. All texts are then scored in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.labelled import held_out, training_labels

# Kinds of people; a name is only swapped for another of its kind. A parameter, not a fixed list.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "natives", "foreigners", "refugees"),
    ("old", "young", "elderly", "disabled"),
)
MAX_ROWS = 20_000
BUCKETS = 1 << 20
FEATURES = 4096  # buckets the model uses
MIN_DOCUMENTS = 4  # labelled texts that must hold a feature
PREFIXES = (4, 5, 6, 7)
MEMO_WORDS = 100_000
STEPS, RATE, DECAY, FAIRNESS = 600, 0.05, 3e-5, 1.0
SWAPS = 3

_PART = re.compile(r"[^\W\d_]+")


def token_features(token: str) -> tuple[int, ...]:
    """Buckets of a token: its words in lower case and their beginnings."""
    out = []
    for word in _PART.findall(token.lower()):
        out.append(xxhash.xxh32_intdigest("=" + word) % BUCKETS)
        out += [xxhash.xxh32_intdigest(word[:n]) % BUCKETS for n in PREFIXES if len(word) > n]
    return tuple(out)


class Features:
    """Sets of buckets of texts; the buckets of tokens are remembered, within a bound."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> set[int]:
        out: set[int] = set()
        for token in set(text.split()):
            known = self.memo.get(token)
            if known is None:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                known = self.memo[token] = token_features(token)
            out.update(known)
        return out


def twins(text: str, kinds: tuple[tuple[str, ...], ...], swaps: int = SWAPS) -> list[str]:
    """The text with each name of a group swapped for the k-th next of its kind, k = 1 to ``swaps``;
    none without a name."""
    place = {name: (kind, i) for kind in kinds for i, name in enumerate(kind)}
    names = re.compile(r"\b(" + "|".join(map(re.escape, sorted(place))) + r")\b", re.IGNORECASE)
    if not names.search(text):
        return []
    out = []
    for k in range(1, swaps + 1):
        def other(found: re.Match) -> str:
            kind, i = place[found[0].lower()]
            return kind[(i + k) % len(kind)]  # noqa: B023
        out.append(names.sub(other, text))
    return out


@dataclass
class Model:
    buckets: np.ndarray  # ascending
    weights: np.ndarray
    bias: float

    def weight_of(self) -> dict[int, float]:
        return dict(zip(self.buckets.tolist(), self.weights.tolist(), strict=True))


def _sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each entry."""
    return (np.repeat(np.arange(len(rows)), [len(r) for r in rows]),
            np.concatenate(rows) if rows else np.empty(0, np.int64))


def train(
    rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], size: int,
    fairness: float = FAIRNESS,
) -> tuple[np.ndarray, float]:
    """Weights and bias: logistic loss, ridge, and the mean squared difference of the scores (before
    the logistic function) of twins, times ``fairness``."""
    row, feature = _sparse(rows)
    row_a, feature_a = _sparse([a for a, _ in pairs])
    row_b, feature_b = _sparse([b for _, b in pairs])
    # Entries of the differences between twins: +1 and -1.
    twin = np.concatenate([row_a, row_b])
    twin_feature = np.concatenate([feature_a, feature_b]).astype(np.int64)
    sign = np.concatenate([np.ones(len(row_a)), -np.ones(len(row_b))])
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    w, bias = np.zeros(size), float(np.log(rate / (1 - rate)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1 if len(y) else 1):
        z = np.bincount(row, w[feature], len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gradient = np.bincount(feature, off[row], size) + DECAY * w
        if pairs:
            gap = np.bincount(twin, sign * w[twin_feature], len(pairs))
            gradient += 2 * fairness / len(pairs) * np.bincount(
                twin_feature, sign * gap[twin], size
            )
        g = np.append(gradient, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return w, bias


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts of each label a bucket occurs."""
    counts, features = np.zeros((2, BUCKETS), np.int32), Features()
    for batch in batches:
        for text, y in zip(batch.column("content").to_pylist(), batch.column("y").to_pylist(),
                           strict=True):
            found = features.of(text)
            counts[y, np.fromiter(found, np.int64, len(found))] += 1
    used = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(counts[0, used].astype(np.int64)),
         pa.array(counts[1, used].astype(np.int64))],
        names=["bucket", "n0", "n1"],
    )


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label_column: str = "toxic",
    identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, max_rows: int = MAX_ROWS,
    fairness: float = FAIRNESS, id_column: str = "doc_id", text_column: str = "text",
) -> Model:
    """A model from about ``max_rows`` labelled rows outside of the held-out fold.

    Null labels and ids, and labels without a document, are passed over. With no rows at all, or one
    label only, every score is near the share of that label. The driver holds, of each row and its
    twins, the places of its features, of which there are ``FEATURES`` at most: some hundred bytes a row
    as a rule, 16 KB a text at worst.
    """
    y = F.broadcast(training_labels(labels, label_column, max_rows, id_column))  # 2 * max_rows at most
    texts = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("content")
    ).join(y, "id").select("y", "content")
    counts = texts.mapInArrow(_counted, "bucket long, n0 long, n1 long").groupBy("bucket").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    n = dict(texts.groupBy("y").count().collect())
    n0, n1 = max(1, n.get(0, 0)), max(1, n.get(1, 0))
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    noise = F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    telling = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / noise
    chosen = counts.filter(F.col("n0") + F.col("n1") >= MIN_DOCUMENTS).orderBy(
        F.desc(telling), "bucket"
    ).limit(FEATURES)
    named = [b for kind in identity_terms for name in kind for b in token_features(name)]
    buckets = np.union1d(
        np.array([r["bucket"] for r in chosen.collect()], np.int64), np.array(named, np.int64)
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of a text's features, and those of its twins, in rows that follow it."""
        features = Features()

        def places(text: str) -> bytes:
            found = features.of(text)
            return np.flatnonzero(np.isin(buckets, np.fromiter(found, np.int64, len(found)))).astype(
                np.int32).tobytes()

        for batch in batches:
            ys, own, other = [], [], []
            for text, y in zip(batch.column("content").to_pylist(), batch.column("y").to_pylist(),
                               strict=True):
                ys.append(y)
                own.append(places(text))
                other.append([places(t) for t in twins(text, identity_terms)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ys, pa.int32()), pa.array(own, pa.binary()),
                 pa.array(other, pa.list_(pa.binary()))],
                names=["y", "own", "twins"],
            )

    # Bounded by max_rows: some hundred places of each text, four bytes each.
    sample = texts.mapInArrow(vectors, "y int, own binary, twins array<binary>").collect()
    sample.sort(key=lambda r: (r["y"], bytes(r["own"])))
    unpack = lambda b: np.frombuffer(b, np.int32).astype(np.int64)
    pairs = [(unpack(r["own"]), unpack(t)) for r in sample for t in r["twins"]]
    weights, bias = train(
        [unpack(r["own"]) for r in sample], np.array([r["y"] for r in sample], float), pairs,
        len(buckets), fairness,
    )
    used = weights != 0
    return Model(buckets[used], weights[used], bias)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.weight, self.bias = model.weight_of(), model.bias
        self.memo: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        """Between 0 and 1; only tokens with a weight are kept in mind as more than nothing."""
        found: set[int] = set()
        for token in set(text.split()):
            known = self.memo.get(token)
            if known is None:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                known = tuple(b for b in token_features(token) if b in self.weight)
                self.memo[token] = known
            found.update(known)
        z = self.bias + sum(self.weight[b] for b in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity_scores(
    docs: DataFrame, model: Model, threshold: float = 0.5, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score``, ``predicted``.

    A null text counts as empty and has the score of a text without any feature. Ids may be null or
    repeat; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer.score(t.as_py() or "") for t in batch.column("content")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64())],
                names=["id", "held_out", "score"],
            )

    rows = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"),
                       F.col(text_column).alias("content"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_column), "held_out", "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(
    docs: DataFrame, model: Model, threshold: float = 0.5, text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns as they were.

    A null text counts as empty and has the score of a text without any feature. Rows that repeat are
    judged alike; ids and columns may be anything; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            keep = [scorer.score(t.as_py() or "") < threshold for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # Columns go by place, as a name may hold a dot.
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)
