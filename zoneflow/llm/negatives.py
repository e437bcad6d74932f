"""Hard negatives by a multiway hyperplane tree over distance ranges.

A node of the tree has up to ``FANOUT`` split points; a row belongs to the nearest. Each split point
keeps, for each sibling's rows, the least and the greatest distance to them. What is looked for lies in
a window of scores, hence, with the lengths of a sibling's rows, in an annulus about the anchor. A
sibling is left out if no point at a distance within its range from a split point can lie in that
annulus, or if the hyperplane between two split points keeps it away. Leaves are scored exactly, so the
result is that of comparing every anchor with every row.

The upper levels are fitted to a bounded sample; their ranges are taken over all rows. A cell (leaf of
the upper levels) is cut into blocks of bounded size, and a block meets the anchors that visit its cell
in slices of bounded size. A task builds the lower levels of its block. The best rows of blocks are
merged by a window that limits each group before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoneflow.llm.vectors import finite_rows, matrix, whole
from zoneflow.session import materialize, release

FANOUT = 16
LEAF = 256  # rows of a leaf
SAMPLE = 8192  # rows the upper levels are fitted to and first bounds are taken from, about
SAMPLE_BYTES = 16 << 20
BLOCK_BYTES = 16 << 20  # of a block's vectors, and of a slice of anchors
LEAST_BLOCK, BLOCKS = 2048, 32  # smaller tables are cut into about that many blocks, not below that size
BATCH = 1024  # anchors that go down a tree together
CHOICE = 512  # rows that split points are chosen from
NONE = np.int64(-(2**62))  # a score below any
EXACT = 2.0**53
SLACK = 1e-7  # of the length of vectors, for rounding of distances
VISITS = ("q long, own long, label long, x array<long>, cell int, place array<int>, "
          "low array<long>, high array<long>")
FOUND = "q long, place int, score long, id long"


# ---- vectors of whole numbers ------------------------------------------------------------------


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exact; beyond a long they count as the largest one."""
    widest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if widest < EXACT:
        return a.astype(float) @ b.astype(float).T
    if widest < 2.0**62:
        return a @ b.T
    far = (a.astype(object) @ b.astype(object).T)
    return np.clip(far, -(2**62) + 1, 2**62).astype(np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return (x * x).sum(1)


def _distances(x: np.ndarray, squares: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Row x point."""
    apart = squares[:, None] + _lengths(points)[None, :] - 2.0 * _products(x, points)
    return np.sqrt(np.maximum(apart, 0))


# ---- the tree ----------------------------------------------------------------------------------


@dataclass
class Node:
    """Split points and ranges; children are nodes or, at the bottom, what ``leaf`` made of the rows."""

    points: np.ndarray
    number: int = 0
    low: np.ndarray = field(init=False)  # split point x sibling: least distance
    high: np.ndarray = field(init=False)
    short: np.ndarray = field(init=False)  # of each sibling: least squared length
    long: np.ndarray = field(init=False)
    children: list = field(default_factory=list)

    def __post_init__(self) -> None:
        k = len(self.points)
        self.low, self.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        self.short, self.long = np.full(k, np.inf), np.full(k, -np.inf)

    def deal(self, x: np.ndarray, squares: np.ndarray, widen: bool = True) -> np.ndarray:
        """The sibling of each row, the first of equally near ones; ranges grow to hold the rows."""
        apart = _distances(x, squares, self.points)
        own = apart.argmin(1)
        if widen:
            for j in np.unique(own):
                mine = own == j
                self.low[:, j] = np.minimum(self.low[:, j], apart[mine].min(0))
                self.high[:, j] = np.maximum(self.high[:, j], apart[mine].max(0))
                self.short[j] = min(self.short[j], squares[mine].min())
                self.long[j] = max(self.long[j], squares[mine].max())
        return own

    def visits(self, q: np.ndarray, squares: np.ndarray, unit: np.ndarray, low: np.ndarray,
               high: np.ndarray) -> np.ndarray:
        """Search x sibling: whether rows with a score from ``low`` to ``high`` may be there.

        Search ``i`` belongs to the anchor ``q[unit[i]]``.
        """
        apart = _distances(q, squares, self.points)[unit]
        own = squares[unit][:, None]
        low, high = low.astype(float)[:, None], high.astype(float)[:, None]
        with np.errstate(invalid="ignore"):
            outer, inner = own + self.long - 2 * low, own + self.short - 2 * high
        scale = np.sqrt(np.maximum(own, np.where(np.isfinite(self.long), self.long, 0)))
        slack = SLACK * (1 + scale)
        alive = (outer >= -slack * scale) & np.isfinite(self.long)
        outer = np.sqrt(np.maximum(outer, 0)) + slack
        inner = np.sqrt(np.maximum(inner, 0)) - slack
        alive &= apart - apart.min(1)[:, None] <= 2 * outer
        for i in range(len(self.points)):
            mine = apart[:, i][:, None]
            alive &= (self.low[i] - mine <= outer) & (mine - self.high[i] <= outer)
            alive &= inner <= mine + self.high[i]
        return alive


def _split_points(x: np.ndarray, squares: np.ndarray, fanout: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those before; different ones only."""
    some = np.linspace(0, len(x) - 1, min(len(x), CHOICE)).astype(int)
    x, squares = x[some], squares[some]
    chosen, nearest = [0], _distances(x, squares, x[:1])[:, 0]
    while len(chosen) < fanout and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(x, squares, x[chosen[-1:]])[:, 0])
    return x[chosen]


def build(x: np.ndarray, squares: np.ndarray, rows: np.ndarray, leaf_rows: int, levels: int, leaf):
    """A tree over ``x[rows]``; ``leaf`` makes what stands at the bottom from row numbers."""
    if len(rows) <= leaf_rows or levels == 0:
        return leaf(rows)
    points = _split_points(x[rows], squares[rows], FANOUT)
    if len(points) < 2:
        return leaf(rows)
    node = Node(points)
    own = node.deal(x[rows], squares[rows])
    for j in range(len(points)):
        node.children.append(build(x, squares, rows[own == j], leaf_rows, levels - 1, leaf))
    return node


def _nodes(tree) -> list[Node]:
    """All nodes, numbered in this order."""
    found, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, Node):
            node.number = len(found)
            found.append(node)
            stack.extend(reversed(node.children))
    return found


# ---- searches ----------------------------------------------------------------------------------


class Searches:
    """Windows of scores of some anchors, and the best ``k`` rows found in each.

    Higher scores come first, of equal ones the smaller id. ``same`` looks for rows with the label of
    the anchor, otherwise for those with another one. A row with the anchor's id is never found.
    """

    def __init__(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, unit: np.ndarray,
                 low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.q, self.own, self.label, self.unit = q, own, label, unit
        self.low, self.high, self.k, self.same = low.copy(), high, k, same
        self.squares = _lengths(q)
        self.score = np.full((len(unit), k), NONE, np.int64)
        self.id = np.full((len(unit), k), np.iinfo(np.int64).max)

    def look(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, which: np.ndarray) -> None:
        """Score the rows for the searches ``which``."""
        anchors, inside = np.unique(self.unit[which], return_inverse=True)
        products = _products(self.q[anchors], x)
        fits = (labels[None, :] == self.label[anchors][:, None]) == self.same
        fits &= ids[None, :] != self.own[anchors][:, None]
        scores = products[inside]
        good = fits[inside] & (scores >= self.low[which][:, None]) & (scores <= self.high[which][:, None])
        if good.sum() > 4 * self.k * len(which) and scores.shape[1] > self.k:
            best = np.partition(np.where(good, scores, float(NONE)), -self.k, axis=1)[:, -self.k]
            good &= scores >= best[:, None]
        at, row = np.nonzero(good)
        if len(at):
            self._offer(which[at], scores[at, row].astype(np.int64), ids[row])

    def _offer(self, at: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        touched = np.unique(at)
        at = np.concatenate([np.repeat(touched, self.k), at])
        score = np.concatenate([self.score[touched].ravel(), score])
        row_id = np.concatenate([self.id[touched].ravel(), row_id])
        order = np.lexsort((row_id, -score, at))
        at, score, row_id = at[order], score[order], row_id[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.k
        self.score[at[kept], rank[kept]] = score[kept]
        self.id[at[kept], rank[kept]] = row_id[kept]
        self.low[touched] = np.maximum(self.low[touched], self.score[touched, -1])

    def descend(self, tree, visit) -> None:
        """``visit(leaf, searches)`` for each leaf that no range leaves out, nearest siblings first."""
        stack = [(tree, np.arange(len(self.unit)))]
        while stack:
            node, which = stack.pop()
            if not isinstance(node, Node):
                visit(node, which)
                continue
            anchors, inside = np.unique(self.unit[which], return_inverse=True)
            # Bounds may have risen since the node was put by.
            alive = node.visits(self.q[anchors], self.squares[anchors], inside, self.low[which], self.high[which])
            near = _distances(self.q[anchors], self.squares[anchors], node.points).mean(0)
            for j in np.argsort(-near):
                if alive[:, j].any():
                    stack.append((node.children[j], which[alive[:, j]]))


def search_block(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, searches: list[Searches]) -> None:
    """All searches over the rows of a block."""
    squares = _lengths(x)
    tree = build(x, squares, np.arange(len(x)), LEAF, 64, lambda rows: rows)
    for one in searches:
        def visit(rows, which, one=one):
            for start in range(0, len(rows), LEAF):
                part = rows[start:start + LEAF]
                one.look(x[part], ids[part], labels[part], which)

        one.descend(tree, visit)


def _searches(table, k: int, same: bool) -> list[Searches]:
    """Searches of the anchors in a table with q, own, label, x, low, high; a batch each."""
    found = []
    for start in range(0, table.num_rows, BATCH):
        part = table.slice(start, BATCH)
        low, high = part.column("low"), part.column("high")
        if isinstance(low, pa.ChunkedArray):
            low, high = low.combine_chunks(), high.combine_chunks()
        size = low.value_lengths().to_numpy()
        found.append(Searches(
            _matrix(part, "x"), _numbers(part, "own"), _numbers(part, "label"),
            np.repeat(np.arange(len(size)), size), low.flatten().to_numpy(), high.flatten().to_numpy(), k, same))
    return found


def _matrix(table, name: str) -> np.ndarray:
    column = table.column(name)
    return matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def _numbers(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


# ---- the index ---------------------------------------------------------------------------------


@dataclass
class Upper:
    """The upper levels: a node, or cell 0 if the table is small. ``x``, ``ids``, ``labels``: the sample."""

    tree: object
    cells: int
    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray

    def cell_of(self, x: np.ndarray, widen: bool = False) -> np.ndarray:
        cells, squares = np.zeros(len(x), np.int32), _lengths(x)
        stack = [(self.tree, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not isinstance(node, Node):
                cells[rows] = node
            elif len(rows):
                own = node.deal(x[rows], squares[rows], widen)
                stack.extend((child, rows[own == j]) for j, child in enumerate(node.children))
        return cells


def _fitted(rows: DataFrame, n: int, blocks: int) -> Upper:
    size = rows.select(F.size("x").alias("size")).first()
    width = size["size"] if size else 1
    most = max(FANOUT, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    drawn = rows.filter(F.pmod(F.xxhash64("id", "label", "x"), F.lit(-(-n // most))) == 0) if n else rows
    sample = sorted((r["x"], r["label"], r["id"]) for r in drawn.collect())
    x = np.array([s[0] for s in sample], np.int64).reshape(len(sample), width)
    mixed = np.random.default_rng(0).permutation(len(x))  # so that even strides are a fair choice
    x, sample = x[mixed], [sample[i] for i in mixed]
    made: list[int] = []

    def cell(_rows) -> int:
        made.append(len(made))
        return made[-1]

    levels = 0
    while FANOUT**levels < blocks and FANOUT ** (levels + 1) * LEAF <= 8 * most:
        levels += 1
    tree = build(x, _lengths(x), np.arange(len(x)), 1, levels, cell)
    for node in _nodes(tree):
        node.__post_init__()  # ranges are those of all rows, not of the sample
    return Upper(tree, len(made), x, np.array([s[2] for s in sample], np.int64),
                 np.array([s[1] for s in sample], np.int64))


def _ranged(routed: DataFrame, shared) -> dict[int, tuple]:
    """For each node the ranges over all rows, from those of each task."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.value
        for batch in batches:
            upper.cell_of(matrix(batch.column("x")), widen=True)
        found = [(node.number, i, j, node.low[i, j], node.high[i, j], node.short[j], node.long[j])
                 for node in _nodes(upper.tree) for j in range(len(node.points))
                 if np.isfinite(node.long[j]) for i in range(len(node.points))]
        for node in _nodes(upper.tree):
            node.__post_init__()  # a worker keeps the broadcast value for its next task
        columns = list(zip(*found, strict=True)) if found else [[] for _ in range(7)]
        kinds = [pa.int32()] * 3 + [pa.float64()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["node", "i", "j", "low", "high", "short", "long"])

    parts = routed.select("x").mapInArrow(
        ranges, "node int, i int, j int, low double, high double, short double, long double")
    merged = parts.groupBy("node", "i", "j").agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("short").alias("short"), F.max("long").alias("long"))
    return merged.collect()  # pairs of split points of the upper levels


class Index:
    """All rows (id, label, x) by cell and block, and the upper levels that lead to them."""

    def __init__(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        n = rows.count()
        width = (rows.select(F.size("x").alias("size")).first() or {"size": 1})["size"]
        most = max(1, BLOCK_BYTES // (8 * width))
        self.slice = most
        self.block = min(most, max(LEAST_BLOCK, n // BLOCKS))
        upper = _fitted(rows, n, -(-n // self.block))
        routing = spark.sparkContext.broadcast(upper)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = routing.value.cell_of(matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cells, pa.int32())], names=["id", "label", "x", "cell"])

        routed = rows.mapInArrow(route, "id long, label long, x array<long>, cell int")
        self.rows = materialize(routed)
        nodes = _nodes(upper.tree)
        for r in _ranged(self.rows, routing):
            node, i, j = nodes[r["node"]], r["i"], r["j"]
            node.low[i, j], node.high[i, j] = r["low"], r["high"]
            node.short[j], node.long[j] = r["short"], r["long"]
        self.upper = spark.sparkContext.broadcast(upper)  # SAMPLE rows, and ranges of the upper levels
        self.parts = materialize(self.rows.groupBy("cell").agg(
            F.ceil(F.count("*") / self.block).alias("parts")))

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, place, score, id, rank) of the best ``k`` rows of each window of each anchor.

        ``anchors``: q (one to a row), own (its id), label, x, and the bounds low and high of its windows.
        """
        upper = self.upper

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = upper.value
            for batch in batches:
                for start, one in zip(range(0, batch.num_rows, BATCH), _searches(batch, k, same), strict=True):
                    # The sample is part of the table: the best of it bound the best of all.
                    for first in range(0, len(known.x), LEAF):
                        part = slice(first, first + LEAF)
                        one.look(known.x[part], known.ids[part], known.labels[part], np.arange(len(one.unit)))
                    yield from _visits(batch.slice(start, BATCH), one, known)

        def find(rows: pa.Table, visits: pa.Table) -> pa.Table:
            found = _searches(visits, k, same) if rows.num_rows else []
            if found:
                search_block(_matrix(rows, "x"), _numbers(rows, "id"), _numbers(rows, "label"), found)
            return _best(visits, found)

        visits = anchors.mapInArrow(plan, VISITS)
        copies = max(1, -(-anchors.count() // self.slice))
        parts = self.parts
        left = self.rows.join(parts, "cell").select(
            "cell", F.pmod(F.xxhash64("id", "x"), F.col("parts")).alias("part"),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "id", "label", "x")
        right = visits.join(parts, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
            F.pmod(F.xxhash64("q"), F.lit(copies)).cast("int").alias("copy"),
            "q", "own", "label", "x", "place", "low", "high")
        key = ("cell", "part", "copy")
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(find, FOUND)
        first = W.partitionBy("q", "place").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)

    def close(self) -> None:
        release(self.rows, self.parts)


def _visits(batch: pa.RecordBatch, one: Searches, known: Upper) -> Iterator[pa.RecordBatch]:
    """The cells that each anchor of a batch has to visit, with the windows that lead there."""
    starts = np.searchsorted(one.unit, np.arange(batch.num_rows + 1))
    place = np.arange(len(one.unit)) - starts[one.unit]
    reached: list[tuple[int, np.ndarray]] = []
    one.descend(known.tree, lambda cell, which: reached.append((cell, np.sort(which))))
    for cell, which in reached:
        anchors, first = np.unique(one.unit[which], return_index=True)
        at = pa.array(np.append(first, len(which)).astype(np.int32))
        part = batch.take(pa.array(anchors))
        lists = [pa.ListArray.from_arrays(at, pa.array(v[which], kind)) for v, kind in (
            (place, pa.int32()), (one.low, pa.int64()), (one.high, pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in ("q", "own", "label", "x")],
             pa.array(np.full(len(anchors), cell, np.int32)), *lists],
            names=["q", "own", "label", "x", "cell", "place", "low", "high"])


def _best(visits: pa.Table, searches: list[Searches]) -> pa.Table:
    parts = [[np.empty(0, np.int64)] for _ in range(4)]
    for start, one in zip(range(0, visits.num_rows, BATCH), searches):
        part = visits.slice(start, BATCH)
        place = part.column("place").combine_chunks().flatten().to_numpy()
        at, rank = np.nonzero(one.score > NONE)
        for column, values in zip(parts, (_numbers(part, "q")[one.unit[at]], place[at], one.score[at, rank],
                                          one.id[at, rank]), strict=True):
            column.append(values)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(np.concatenate(c).astype(k.to_pandas_dtype()), k)
                     for c, k in zip(parts, kinds, strict=True)], names=["q", "place", "score", "id"])


# ---- mining ------------------------------------------------------------------------------------


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3,
    percent: tuple[int, int] = (50, 95), scale: int = 256, id_column: str = "vec_id",
    label_column: str = "label", vector_column: str = "embedding",
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label the first ``negatives``
    rows of other labels whose score lies within ``percent`` of the positive's.

    A score is the inner product of the whole-number vectors ``floor(scale * entry)``; higher scores come
    first, of equal ones the smaller id. ``anchor`` says on ``id`` and ``label`` which rows are anchors.
    Result: anchor_id, positive_id, rank, negative_id, positive_score, negative_score; exact.

    Rows with a null id, label or vector, a null or not finite entry, or another length than most rows
    take no part. Ids are meant to be unique: rows that share one are rows of their own, but never
    found for an anchor with that id. Labels are whole numbers. Scores beyond 2**62 count as that. An
    empty table, or one label only, gives an empty result.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
                          F.col(vector_column).alias("v")).dropna(subset=["id", "label"])
    rows = finite_rows(rows, "v").select("id", "label", whole("v", scale).alias("x"))
    # Of equal vectors with one label only so many can be among the first of anything.
    copies = W.partitionBy("x", "label").orderBy("id")
    most = max(positives + 1, negatives)
    several = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= most).drop("copy")
    kept = materialize(several)
    index = Index(kept)
    whole_range = F.array(F.lit(int(NONE) + 1)), F.array(F.lit(2**62))
    asked = materialize(rows.filter(anchor).select(
        F.monotonically_increasing_id().alias("q"), F.col("id").alias("own"), "label", "x"))
    near = materialize(index.search(
        asked.select("*", whole_range[0].alias("low"), whole_range[1].alias("high")), positives, same=True
    ).select("q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    least, most_of = percent
    s = F.col("positive_score").cast("decimal(38,0)")
    windows = near.select("q", "positive_score", F.ceil(s * least / 100).cast("long").alias("low"),
                          F.floor(s * most_of / 100).cast("long").alias("high")).filter("low <= high").distinct()
    packed = windows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("positive_score", "low", "high"))).alias("w"))
    packed = materialize(packed.select("q", F.col("w.positive_score").alias("said"), "w.low", "w.high"))
    found = index.search(asked.join(packed.drop("said"), "q"), negatives, same=False)
    scores = packed.select("q", F.posexplode("said").alias("place", "positive_score"))
    result = (
        found.withColumnRenamed("score", "negative_score").withColumnRenamed("id", "negative_id")
        .join(scores, ["q", "place"]).join(near, ["q", "positive_score"])
        .join(asked.select("q", F.col("own").alias("anchor_id")), "q")
    )
    written = materialize(result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                        "negative_score"))
    index.close()
    release(kept, asked, near, packed)
    return written
