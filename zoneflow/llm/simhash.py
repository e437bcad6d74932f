"""SimHash fingerprints and their near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints with at most three differing bits agree, in one half of 32 bits, up to one bit.
Each distinct fingerprint is therefore filed under 64 signatures: for each half and each of its bits,
the half with that bit deleted. Fingerprints that share a signature are compared in full. What a
bucket yields is a star per group of linked members, not their pairs, which keeps components.

A bucket with too many members to compare is filed again: the other half, of 16-bit quarters, agrees
in one quarter up to one bit; if need be a third time with 8-bit parts. A bucket of the third level
has at most 2048 different members, as only 11 bits are left free. So no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zoneflow.llm import shingles
from zoneflow.llm.components import components
from zoneflow.llm.stars import stars
from zoneflow.session import materialize

SEED = 42
SHINGLE = 3  # words
MAX_BITS = 2  # three at most: with more, no half need agree up to one bit
CHUNK = 200_000  # shingles counted at a time
SMALL = 32  # runs up to this length are compared shifted, all at once
DIRECT = 2048  # members of a bucket that are compared directly
HOLD = 1_000_000  # members of a bucket kept in a task's memory before it is passed on


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    parts = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, parts, repeat(SEED))
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        part = np.fromiter(islice(hashes, CHUNK), np.uint64, min(CHUNK, n - start))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(
    shingle: int, keys: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("content").cast(pa.binary())
            prints = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            more = shingles.file_keys(texts) if keys else ()
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(prints), *more],
                names=[*batch.schema.names[:-1], "print", *(("node", "n", "keys") if keys else ())],
            )

    return printed


# ---- signatures --------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _variants(
    prints: np.ndarray, width: int, offset: np.ndarray, bucket: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of one level: of the 2 * width bits at ``offset`` both parts, each bit deleted.

    Returns the key, the deleted bit, the offset of what stays free, and the fingerprint.
    """
    keys, deleted, free = [], [], []
    one = np.uint64(1)
    marks = np.uint64(6 if width == 32 else 5)
    for part in range(2):
        at = offset + np.uint64(part * width)
        value = (prints >> at) & np.uint64((1 << width) - 1)
        for bit in range(width):
            mark = (bucket << marks) | np.uint64(part * width + bit)
            left = value & ~(one << np.uint64(bit))
            if width == 8:  # no room for the whole key; a clash only adds comparisons
                keys.append(_mix(_mix(bucket + np.uint64(part * width + bit)) + left))
            else:
                keys.append((mark << np.uint64(width)) | left)
            deleted.append(at + np.uint64(bit))
            free.append(offset + np.uint64((1 - part) * width))
    times = 2 * width
    return tuple(map(np.concatenate, (keys, deleted, free, [prints] * times)))


SIGNED = "key long, bit short, free short, print long"
SIGNED_ARROW = pa.schema([("key", pa.int64()), ("bit", pa.int16()), ("free", pa.int16()),
                          ("print", pa.int64())])


def _signed(parts: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    key, bit, free, prints = parts
    step = 100_000
    for start in range(0, len(key), step):
        cut = slice(start, start + step)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[cut].view(np.int64)), pa.array(bit[cut].astype(np.int16)),
             pa.array(free[cut].astype(np.int16)), pa.array(prints[cut].view(np.int64))],
            schema=SIGNED_ARROW,
        )


def _file_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        zero = np.zeros(len(prints), np.uint64)
        yield from _signed(_variants(prints, 32, zero, zero))


def _file_again(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, free, prints = (
                batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for c in ("key", "free", "print")
            )
            yield from _signed(_variants(prints, width, free, key))

    return file


# ---- buckets -----------------------------------------------------------------------------


def _compared(left: np.ndarray, right: np.ndarray, same: bool, bits: int) -> list[np.ndarray]:
    """Linked pairs of two sets of fingerprints, or of one with itself, as two arrays."""
    found = [np.empty(0, np.uint64)] * 2
    rows = max(1, 4_000_000 // max(1, len(right)))
    pieces = [found]
    for start in range(0, len(left), rows):
        part = left[start:start + rows]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ right[None, :]) <= bits)
        if same:
            keep = i + start < j
            i, j = i[keep], j[keep]
        pieces.append(list(stars(part[i], right[j])) if len(i) else found)
    return [np.concatenate([p[k] for p in pieces]) for k in range(2)]


class _Links:
    """Linked members of the buckets of a partition; buckets too large are handed on."""

    def __init__(self, last: bool, bits: int) -> None:
        self.last, self.bits = last, bits

    def long_run(self, rows: dict[str, np.ndarray]):
        """Links of one bucket, or None if it must be filed again."""
        prints, bit = rows["print"], np.uint64(rows["bit"][0])
        ones = (prints >> bit) & np.uint64(1) == 1
        if rows["first"][0]:
            if len(prints) > DIRECT and not self.last:
                return None
            return _compared(prints, prints, True, self.bits)
        # Members that agree in the deleted bit meet in the bucket of the first bit as well.
        one, zero = prints[ones], prints[~ones]
        if len(one) * len(zero) > DIRECT * DIRECT and not self.last:
            return None
        return _compared(one, zero, False, self.bits)

    def batch(self, rows: dict[str, np.ndarray]):
        """Links of whole buckets; also the rows to be filed again."""
        key = rows["key"]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(begin, len(key)))
        run_of = np.repeat(length, length)
        a, b, again = [], [], []
        prints, bit, first = rows["print"], rows["bit"].astype(np.uint64), rows["first"]
        small = length[length <= SMALL]
        for d in range(1, int(small.max()) if len(small) else 0):
            i = np.flatnonzero((run_of[:-d] > d) & (run_of[:-d] <= SMALL) & (key[d:] == key[:-d]))
            if not len(i):
                continue
            differ = prints[i] ^ prints[i + d]
            ok = (np.bitwise_count(differ) <= self.bits) & (
                first[i] | ((differ >> bit[i]) & np.uint64(1) == 1)
            )
            a.append(prints[i[ok]])
            b.append(prints[i[ok] + d])
        for start, n in zip(begin[length > SMALL], length[length > SMALL], strict=True):
            run = {k: v[start:start + n] for k, v in rows.items()}
            links = self.long_run(run)
            if links is None:
                again.append(run)
            else:
                a.append(links[0])
                b.append(links[1])
        if a and sum(map(len, a)):
            left, right = stars(np.concatenate(a), np.concatenate(b))
        else:
            left = right = np.empty(0, np.uint64)
        return left, right, again


OUT = "a long, b long, key long, free short"
OUT_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()),
                       ("free", pa.int16())])


def _bucket_links(width: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over partitions sorted by key: links (a, b), and rows to file again (b is null)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links(width == 8, bits)
        kept: dict[str, np.ndarray] | None = None
        passing: int | None = None  # the key of a bucket too large to be held
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {
                c: batch.column(c).to_numpy(zero_copy_only=False)
                for c in ("key", "bit", "free", "print")
            }
            rows["print"] = rows["print"].view(np.uint64)
            # Where keys may clash, all pairs of a bucket count.
            rows["first"] = (rows["bit"] % width == 0) | (width == 8)
            if kept is not None:
                rows = {c: np.concatenate([kept[c], rows[c]]) for c in rows}
            if passing is not None:
                same = int(np.searchsorted(rows["key"], passing, "right"))
                if same:
                    yield _again([{c: v[:same] for c, v in rows.items()}])
                rows = {c: v[same:] for c, v in rows.items()}
                kept = None
                if not len(rows["key"]):
                    continue
                passing = None
            # The last bucket may go on in the next batch.
            cut = int(np.searchsorted(rows["key"], rows["key"][-1], "left"))
            whole = {c: v[:cut] for c, v in rows.items()}
            kept = {c: v[cut:] for c, v in rows.items()}
            if len(kept["key"]) > HOLD and width > 8:
                yield _again([kept])
                passing, kept = kept["key"][0], None
            if cut:
                yield from _emit(*links.batch(whole))
        if kept is not None and len(kept["key"]):
            yield from _emit(*links.batch(kept))

    return link


def _emit(a, b, again) -> Iterator[pa.RecordBatch]:
    if len(a):
        empty = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int16())
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *empty], schema=OUT_ARROW
        )
    if again:
        yield _again(again)


def _again(runs) -> pa.RecordBatch:
    join = lambda c: np.concatenate([r[c] for r in runs])
    prints, key, free = join("print").view(np.int64), join("key"), join("free")
    return pa.RecordBatch.from_arrays(
        [pa.array(prints), pa.nulls(len(prints), pa.int64()), pa.array(key), pa.array(free)],
        schema=OUT_ARROW,
    )


def near_links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column ``print``) at most ``bits`` bits apart."""
    if not 0 <= bits <= 3:
        raise ValueError("halves agree up to one bit for at most three differing bits")
    signed = prints.mapInArrow(_file_first, SIGNED)
    links = None
    for width in (32, 16, 8):
        found = materialize(
            signed.repartition("key").sortWithinPartitions("key")
            .mapInArrow(_bucket_links(width, bits), OUT)
        )
        level = found.filter("b is not null").select("a", "b")
        links = level if links is None else links.union(level)
        again = found.filter("b is null").select("key", "free", F.col("a").alias("print"))
        if width == 8 or again.isEmpty():
            return links
        signed = again.mapInArrow(_file_again(width // 2), SIGNED)
    return links


# ---- operators ---------------------------------------------------------------------------


def _labelled(rows: DataFrame, bits: int, more: DataFrame | None = None) -> DataFrame:
    """(print, component, first): each distinct fingerprint, its component, and the smallest id in
    the component. ``more``: further links of fingerprints."""
    first = materialize(rows.groupBy("print").agg(F.min("id").alias("first")))
    links = near_links(first.select("print"), bits)
    roots = components(links if more is None else links.union(more)).select(
        F.col("a").alias("print"), F.col("b").alias("root")
    )
    joined = first.join(roots, "print", "left").select(
        "print", "first", F.coalesce("root", "print").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("first").alias("first"))
    return joined.drop("first").join(least, "component")


def _printed(
    docs: DataFrame, id_column: str, text_column: str, shingle: int, digest: bool, keys: bool = False
) -> DataFrame:
    content = F.coalesce(F.col(text_column), F.lit(""))
    more = [F.sha2(content, 256).alias("digest")] if digest else []
    rows = docs.select(F.col(id_column).alias("id"), *more, content.alias("content"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {'digest string, ' if digest else ''}print long"
    if keys:
        schema += ", node binary, n long, keys array<long>"
    return materialize(rows.mapInArrow(_fingerprints(shingle, keys), schema))


def simhash_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE,
    bits: int = MAX_BITS,
) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits), ``component_id``.

    Components are joined by fingerprints at most ``bits`` (three or less) apart; ``component_id`` is the smallest
    id in it (null only if all its ids are null). Null and wordless texts have fingerprint zero,
    linked like any other. Ids may repeat; other columns are not read; an empty table gives an empty
    result.
    """
    rows = _printed(docs, id_column, text_column, shingle, digest=False)
    labels = _labelled(rows, bits).select("print", F.col("first").alias("component_id"))
    return rows.join(labels, "print").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id",
    )


def simhash_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    shingle: int = SHINGLE, bits: int = MAX_BITS, jaccard: float | None = None,
) -> DataFrame:
    """The rows of ``docs`` with one row of each component left, all columns as they were.

    Texts are linked whose fingerprints over shingles of ``shingle`` words differ in at most ``bits``
    (three or less). With ``jaccard``, texts whose sets of five-word shingles are alike to that share or
    more are linked as well, however many bits their fingerprints differ in (``shingles``; every such
    link is checked on the whole sets).

    The row with the smallest id stays (a null id is larger than any other), of equal ids the one
    with the smallest digest of its text; of rows equal in both, any one. Null and wordless texts have
    fingerprint zero and are one component. Columns may have any names; an empty table gives an empty one.
    """
    content = F.coalesce(F.col(text_column), F.lit(""))
    rows = _printed(docs, id_column, text_column, shingle, digest=True, keys=jaccard is not None)
    more = None
    if jaccard is not None:
        contents = docs.select(F.col(id_column).alias("id"), F.sha2(content, 256).alias("digest"),
                               content.alias("content"))
        more = shingles.similar_links(rows, contents, jaccard)
    labels = _labelled(rows, bits, more).select("print", "component")
    order = F.struct(F.isnull("id").alias("missing"), "id", "digest")
    keep = rows.join(labels, "print").groupBy("component").agg(F.min(order).alias("keep")).select(
        F.col("keep.id").alias("keep_id"), F.col("keep.digest").alias("keep_digest")
    )
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(id_column).alias("id"), F.sha2(content, 256).alias("digest"))
    kept = packed.join(
        keep, F.col("digest").eqNullSafe(F.col("keep_digest")) & F.col("id").eqNullSafe(F.col("keep_id")),
        "left_semi",
    )
    repeats = W.partitionBy("digest", "id").orderBy(F.lit(1))
    return kept.withColumn("repeat", F.row_number().over(repeats)).filter("repeat = 1").select("row.*")
