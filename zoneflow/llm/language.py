"""Language identification with string kernels.

A text is the set of its character n-grams of one to four letters (blended spectrum, presence only);
the kernel of two texts is the number of n-grams they share over the root of the product of their own
numbers. A Nyström map over ``landmarks`` texts turns kernels into features, and one ridge regression
per language (that language against the rest) is solved from their sums. As the kernel is linear in
presence, landmarks, map and regression fold into one weight per n-gram and language, so a batch of
texts is scored by one product of its presence matrix with these weights.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow.session import materialize, release

FOLDS, FOLD = 4, 2
LENGTHS = 4  # longest n-gram
LANDMARKS = 192  # texts in all, dealt evenly to the languages, one each at least
MAX_ROWS = 20_000  # rows of the sample that the regression is fitted to, about
RIDGE = 1e-4  # times the number of rows
USUAL = (200, 20_000)  # characters of a text that makes a good landmark
UNKNOWN = "und"
SPACE = 32
PIECE = 1_000_000  # characters of a text that are cut into n-grams at a time
BATCH = 64  # texts of a presence matrix
PARTS = 32  # tasks that share the sample
STEP = np.uint64(0x9E3779B97F4A7C15)


def language_fold(id_column: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves a remainder of two by four; a null id is empty."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text) % FOLDS == FOLD


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and whether it belongs into words."""
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([c == "L" for c in first])
    return letter, letter | np.array([c == "M" for c in first])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(text: str) -> bool:
    return bool(_kinds()[0][_codes(text)].any())


def grams(text: str) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text in lower case.

    Whatever is not a letter or a mark on one counts as a space, several as one; a space stands before
    and after the text. A text without words has no n-grams.
    """
    codes = _codes(text.lower())
    inside = _kinds()[1][codes]
    if not inside.any():
        return np.empty(0, np.uint64)
    codes = np.where(inside, codes, SPACE).astype(np.uint64)
    codes = np.concatenate([[np.uint64(SPACE)], codes, [np.uint64(SPACE)]])
    space = codes == SPACE
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    found = np.empty(0, np.uint64)
    for start in range(0, len(codes), PIECE):
        piece = codes[start:start + PIECE + LENGTHS - 1] + np.uint64(1)
        rolled, parts = np.zeros(len(piece) + 1, np.uint64), [found]
        for n in range(1, min(LENGTHS, len(piece)) + 1):
            # Letters are digits to an odd base that has no small relations, so sums tell n-grams apart.
            rolled = (rolled[:-1] * STEP + piece[n - 1:]) * STEP
            parts.append(rolled ^ (rolled >> np.uint64(29)))
        found = np.unique(np.concatenate(parts))
    return found[found != _space_gram()]


@cache
def _space_gram() -> np.uint64:
    alone = np.array([SPACE + 1], np.uint64) * STEP
    return (alone ^ (alone >> np.uint64(29)))[0]


@dataclass
class Model:
    languages: list[str]  # ascending
    vocabulary: np.ndarray  # n-grams of the landmarks, ascending
    weights: np.ndarray  # n-gram x language


class _Presence:
    """Presence matrices over a vocabulary."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.vocabulary = vocabulary

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text x n-gram, and the root of the number of n-grams of each text."""
        there = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        norm = np.ones(len(texts))
        for i, text in enumerate(texts):
            found = grams(text)
            if len(found) and len(self.vocabulary):
                at = np.searchsorted(self.vocabulary, found)
                at[at == len(self.vocabulary)] = 0
                there[i, at[self.vocabulary[at] == found]] = 1
            norm[i] = max(1, len(found)) ** 0.5
        return there, norm


def _batches(texts: pa.Array) -> Iterator[list[str]]:
    for start in range(0, len(texts), BATCH):
        yield [t or "" for t in texts.slice(start, BATCH).to_pylist()]


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [grams(t).view(np.int64) for texts in _batches(batch.column("content")) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], names=["grams"])


def _sample(
    docs: DataFrame, max_rows: int, id_column: str, text_column: str, lang_column: str
) -> tuple[list[str], DataFrame]:
    """The languages, and a written table (lang, content, draw) of about ``max_rows`` rows that may be
    learned from: all of a language with few, an even share of one with many, by a hash of the row."""
    rows = docs.select(
        F.col(lang_column).alias("lang"), F.col(text_column).alias("content"),
        F.xxhash64(F.col(id_column), F.col(text_column)).alias("draw"),
        language_fold(id_column).alias("held"),
    ).filter(~F.col("held") & F.col("lang").isNotNull() & F.col("content").rlike(r"\p{L}")).drop("held")
    sizes = dict(docs.filter(~language_fold(id_column) & F.col(lang_column).isNotNull()).groupBy(
        F.col(lang_column).alias("lang")).count().collect())
    share = -(-max_rows // max(1, len(sizes)))
    parts = docs.sparkSession.createDataFrame(
        [(k, -(-n // share)) for k, n in sizes.items()], "lang string, parts long")  # one row per language
    drawn = rows.join(F.broadcast(parts), "lang").filter(F.pmod("draw", "parts") == 0).drop("parts")
    # One of each, as a row that repeats without end would break the bound.
    sample = materialize(drawn.groupBy("lang", "draw").agg(F.first("content").alias("content")))
    return sorted(r["lang"] for r in sample.select("lang").distinct().collect()), sample


def _landmarks(sample: DataFrame, languages: list[str], landmarks: int) -> list[np.ndarray]:
    """N-grams of the landmark texts: those of usual length first, then by their draw."""
    each = max(1, landmarks // max(1, len(languages)))
    size = F.length("content")
    ranked = sample.select("lang", "draw", F.when(size.between(*USUAL), 0).otherwise(1).alias("odd"))
    chosen = None
    for lang in languages:  # a bounded sample; one small top-k per language
        part = ranked.filter(F.col("lang") == lang).orderBy("odd", "draw").limit(each)
        chosen = part if chosen is None else chosen.union(part)
    rows = sample.join(F.broadcast(chosen.select("lang", "draw")), ["lang", "draw"])  # landmarks
    sets = rows.select("content").distinct().mapInArrow(_gram_sets, "grams array<long>").collect()
    found = [np.array(r["grams"], np.int64).view(np.uint64) for r in sets if r["grams"]]
    return sorted(found, key=lambda g: g.tobytes())


def fit_languages(
    docs: DataFrame, max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE,
    id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
) -> Model:
    """A model from texts outside of the held-out fold whose language is known.

    ``max_rows`` bounds the rows the regression is fitted to (a hash draws about as many at most),
    ``landmarks`` the texts of the Nyström map; what the driver holds is one presence set per landmark
    and sums of landmarks x landmarks. Null texts and languages and texts without a letter are passed
    over, a repeated row counts once. Without any row left the model knows no language.
    """
    languages, sample = _sample(docs, max_rows, id_column, text_column, lang_column)
    sets = _landmarks(sample, languages, landmarks) if languages else []
    vocabulary = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
    marks = np.zeros((len(vocabulary), len(sets)), np.float32)
    for j, found in enumerate(sets):
        marks[np.searchsorted(vocabulary, found), j] = len(found) ** -0.5
    shared = docs.sparkSession.sparkContext.broadcast((languages, vocabulary, marks))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, marked = shared.value
        presence, place = _Presence(words), {lang: k for k, lang in enumerate(names)}
        m, n = marked.shape[1], 0
        square, cross = np.zeros((m, m)), np.zeros((m, len(names)))
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for texts in _batches(batch.column("content")):
                there, norm = presence.of(texts)
                kernel = (there @ marked).astype(np.float64) / norm[:, None]
                own, langs = langs[:len(texts)], langs[len(texts):]
                target = np.full((len(texts), len(names)), -1.0)
                target[np.arange(len(texts)), [place[k] for k in own]] = 1.0
                square += kernel.T @ kernel
                cross += kernel.T @ target
                n += len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()),
             pa.array([square.tobytes()], pa.binary()), pa.array([cross.tobytes()], pa.binary())],
            names=["part", "n", "square", "cross"],
        )

    m, n = len(sets), 0
    square, cross = np.zeros((m, m)), np.zeros((m, len(languages)))
    if sets:
        dealt = sample.repartition(PARTS, "draw").sortWithinPartitions("draw", "lang")
        found = dealt.mapInArrow(sums, "part long, n long, square binary, cross binary").collect()
        for r in sorted(found, key=lambda r: r["part"]):  # PARTS rows
            n += r["n"]
            square += np.frombuffer(r["square"]).reshape(m, m)
            cross += np.frombuffer(r["cross"]).reshape(m, len(languages))
    shared.unpersist()
    release(sample)
    return Model(languages, vocabulary, marks @ solve(marks, square, cross, n, ridge))


def solve(
    marks: np.ndarray, square: np.ndarray, cross: np.ndarray, n: int, ridge: float
) -> np.ndarray:
    """Landmark x language: ridge regression on the Nyström features, back on the landmarks.

    ``square`` and ``cross`` are the sums over rows of kernel x kernel and kernel x target.
    """
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    kept = values > 1e-5 * max(values.max(initial=0.0), 1e-300)  # equal landmarks add nothing
    root = vectors[:, kept] / np.sqrt(values[kept])
    inner = root.T @ square @ root
    inner[np.diag_indices_from(inner)] += ridge * max(1, n)
    return root @ np.linalg.solve(inner, root.T @ cross)


def predict_languages(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``lang_pred``, ``score``.

    A null text, one without a letter, and any text if the model knows no language is ``und`` with a
    score of 0. The score is half of one plus the regression's value, kept within 0 and 1; of equal
    values the first language counts. Ids may be null or repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of the landmarks x languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        presence, weights = _Presence(known.vocabulary), known.weights.astype(np.float32)
        for batch in batches:
            langs, scores = [], []
            for texts in _batches(batch.column("content")):
                there, norm = presence.of(texts)
                value = (there @ weights) / norm[:, None]
                for text, row in zip(texts, value, strict=True):
                    if not len(row) or not has_letter(text):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(row.argmax())
                        langs.append(known.languages[best])
                        scores.append(float(np.clip((1 + row[best]) / 2, 0, 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64())],
                names=["id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_column).alias("id"), language_fold(id_column).alias("held_out"),
                       F.col(text_column).alias("content"))
    schema = T.StructType([rows.schema["id"], rows.schema["held_out"],
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predict, schema).withColumnRenamed("id", id_column)
