"""Links between texts whose sets of word shingles are alike, by MinHash keys and an exact comparison.

A text is the set of its five-word shingles; texts with one set are one node. Each node has BANDS keys
of ROWS minima each. Two nodes at a Jaccard similarity of 0.8 share no key with a probability of
0.00007, above it with less. The members of a key are compared in one task, all at once, by a product
of their presence matrix with itself, and leave it as a star per group of linked members, never as
pairs. Keys that hold the same members are compared once.

A key with too many members for a task is taken apart first. Members alike to one of them, its leader,
are linked by that and need not be compared with each other. The others meet each other and those
members in blocks, so nothing is capped, and a key full of near copies takes a number of comparisons
in proportion to its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.stars import stars
from zoneflow.session import materialize, release

WORDS = 5
BANDS, ROWS = 24, 5
CHUNK = 5_000  # shingles whose minima are taken at a time
MEMBERS, TOTAL = 512, 2_000_000  # members of a block, and shingles of all its members together
CELLS = 4_000_000  # of a part of the presence matrix
_DRAWN = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
XOR, TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of all words if they are fewer; or none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled = _mix(rolled + hashes[k:k + n])
    return np.unique(rolled)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; none of an empty one."""
    if not len(shingles):
        return shingles
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), CHUNK):
        part = ((shingles[None, start:start + CHUNK] ^ XOR) * TIMES).min(1)
        least = np.minimum(least, part)
    least = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key + least[:, k])
    return key


def file_keys(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Names of the shingle sets (16 bytes), their sizes, and their keys."""
    node, n, keys = [], [], []
    for text in texts:
        shingles = shingle_set(text.as_py())
        node.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
        n.append(len(shingles))
        keys.append(band_keys(shingles).view(np.int64))
    return pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("content").cast(pa.binary())
        for start in range(0, len(texts), 500):
            part = texts.slice(start, 500)
            found = [shingle_set(t.as_py()).view(np.int64) for t in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(start, 500), pa.array(found, pa.list_(pa.int64()))],
                names=["node", "shingles"],
            )


# ---- members of one task -----------------------------------------------------------------------


def alike_pairs(sets: list[np.ndarray], jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the sets that are alike, exactly."""
    size = np.array([len(s) for s in sets], float)
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        common = np.array([[size[0], both], [both, size[1]]])
    else:
        _, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), size.astype(int))
        shared = held[place] > 1
        owner, place = owner[shared], (np.cumsum(held > 1) - 1)[place[shared]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        common, width = np.zeros((m, m)), max(1, CELLS // m)
        for start in range(0, int(place[-1]) + 1 if len(place) else 0, width):
            a, b = np.searchsorted(place, (start, start + width))
            there = np.zeros((m, width), np.float32)
            there[owner[a:b], place[a:b] - start] = 1
            common += there @ there.T
    union = size[:, None] + size[None, :] - common
    i, j = np.nonzero(common >= jaccard * union - 1e-9)
    return i[i < j], j[i < j]


def _task_links(jaccard: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over partitions sorted by task: stars (a, b) of the prints whose sets are alike."""
    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        task = table.column("task").to_numpy()
        prints = table.column("print").to_numpy()
        lists = table.column("shingles").combine_chunks()
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        left, right = [], []
        for start, end in zip(begin, np.append(begin[1:], len(task)), strict=True):
            if end - start < 2:
                continue
            i, j = alike_pairs([values[at[k]:at[k + 1]] for k in range(start, end)], jaccard)
            if len(i):
                one, other = stars(prints[start + i], prints[start + j])
                left.append(one)
                right.append(other)
        if left:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if kept is not None:
                table = pa.concat_tables([kept, table]).combine_chunks()
            task = table.column("task").to_numpy()
            cut = int(np.searchsorted(task, task[-1], "left"))  # the last one may go on
            kept = table.slice(cut)
            if cut:
                yield from links(table.slice(0, cut).combine_chunks())
        if kept is not None:
            yield from links(kept.combine_chunks())

    return link


# ---- all tasks ---------------------------------------------------------------------------------


def similar_links(rows: DataFrame, contents: DataFrame, jaccard: float) -> DataFrame:
    """Links (a, b) that join the prints of all texts alike to ``jaccard`` or more and sharing a key.

    ``rows``: id, digest (of the text), print, node, n, keys, repeats allowed; ``contents``: id, digest,
    content of the same rows. Texts without words are in no key and get no link. Prints of one node are
    linked, whatever its number of texts. An empty table has no links.
    """
    named = F.struct(F.isnull("id").alias("none"), "id", "digest").alias("text")
    nodes = materialize(rows.filter("n > 0").select("node", "n", "print", "keys", named).groupBy("node").agg(
        F.min("print").alias("print"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.min("text").alias("text")))
    same = rows.filter("n > 0").select("node", F.col("print").alias("a")).distinct().join(
        nodes.select("node", F.col("print").alias("b")), "node").filter("a <> b").select("a", "b")
    filed = nodes.select("node", "n", "print", F.explode("keys").alias("key"))
    # Keys of the same members count once; their members are told by two hashes and their number.
    held = filed.groupBy("key").agg(
        F.count("*").alias("m"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).filter("m > 1")
    chosen = held.groupBy("m", "total", "x", "y").agg(F.min("key").alias("key"))
    parts = F.greatest(_parts("m", MEMBERS), _parts("total", TOTAL))
    chosen = chosen.select("key", parts.alias("parts"))
    members = materialize(filed.join(chosen, "key").select("key", "node", "print", "parts"))
    wanted = members.select("node").distinct().join(nodes.select("node", "text.id", "text.digest"), "node")
    texts = contents.join(
        wanted.withColumnRenamed("id", "own").withColumnRenamed("digest", "sha"),
        F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("sha")))
    sets = materialize(
        texts.groupBy("node").agg(F.first("content").alias("content"))
        .mapInArrow(_sets, "node binary, shingles array<long>"))
    tasks = members.filter("parts = 1").select(F.col("key").alias("task"), "node", "print")
    links = materialize(same)
    large = members.filter("parts > 1")
    if not large.isEmpty():
        led, apart = _taken_apart(large, sets, jaccard)
        links, tasks = links.union(led), tasks.union(apart)
    found = materialize(
        tasks.join(sets, "node").select("task", "print", "shingles")
        .repartition("task").sortWithinPartitions("task").mapInArrow(_task_links(jaccard), "a long, b long"))
    release(members, sets, nodes)
    return links.union(found)


def _parts(column: str, bound: int) -> Column:
    return F.ceil(F.col(column) / bound)


def _taken_apart(large: DataFrame, sets: DataFrame, jaccard: float) -> tuple[DataFrame, DataFrame]:
    """Of keys too large for a task: links to their leaders, and (task, node, print) of what is left."""
    order = F.struct(F.xxhash64("node").alias("order"), "node", "print")
    leaders = large.groupBy("key").agg(F.min(order).alias("first")).select(
        "key", F.col("first.node").alias("node"), F.col("first.print").alias("leader"))
    led_by = materialize(leaders.join(sets, "node").select("key", "leader", F.col("shingles").alias("first")))
    both = F.size(F.array_intersect("shingles", "first"))
    union = F.size("shingles") + F.size("first") - F.col("both")
    seen = materialize(
        large.join(sets, "node").join(led_by, "key")
        .select("key", "node", "print", "leader", "shingles", "first", both.alias("both"))
        .select("key", "node", "print", "leader", F.size("shingles").alias("n"),
                (F.col("both") >= F.lit(jaccard) * union - 1e-9).alias("near")))
    links = seen.filter("near and print <> leader").select(F.col("print").alias("a"), F.col("leader").alias("b"))
    half = lambda c, bound: F.ceil(2 * F.coalesce(c, F.lit(0)) / bound)  # noqa: E731, two parts meet in a task
    sizes = seen.groupBy("key").agg(*[
        F.greatest(half(F.sum(F.when(side, 1)), MEMBERS), half(F.sum(F.when(side, F.col("n"))), TOTAL)).alias(name)
        for name, side in (("near_parts", F.col("near")), ("far_parts", ~F.col("near")))])
    placed = seen.join(sizes.filter("far_parts > 0"), "key")
    spread = F.xxhash64(F.lit(2), "node")
    own = F.pmod(spread, F.when(F.col("near"), F.col("near_parts")).otherwise(F.col("far_parts"))).alias("own")
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    far_with_far = F.transform(numbers("far_parts"), lambda k: F.xxhash64(
        F.lit("far"), "key", F.least("own", k), F.greatest("own", k)))
    far_with_near = F.when(F.col("near_parts") > 0, F.transform(numbers("near_parts"), lambda k: F.xxhash64(
        F.lit("near"), "key", "own", k))).otherwise(F.array().cast("array<long>"))
    near_with_far = F.transform(numbers("far_parts"), lambda k: F.xxhash64(F.lit("near"), "key", k, "own"))
    meets = F.when(F.col("near"), near_with_far).otherwise(F.concat(far_with_far, far_with_near))
    tasks = placed.select("*", own).select(F.explode(meets).alias("task"), "node", "print")
    release(led_by)
    return links, tasks
