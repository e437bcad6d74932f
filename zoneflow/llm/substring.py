"""Repeated passages by a count-min prefilter.

Documents are dealt into blocks of a few megabytes by their id. Windows of words are hashed inside a
block with numpy; what is shuffled are packed arrays per (block, slice of the hash space):

1. Each block sends a sketch of its windows: one row of a count-min sketch whose width grows with the
   data, stored sparsely as the sorted cells in use. Merged per slice, counts are overestimates, so
   each window that occurs twice lies in a cell with a count of two or more.
2. The windows in such cells, each once per block with its first place there, are grouped exactly by
   128-bit cryptographic digests of their words, and the first place of each in all documents is found.
   A window that thousands of documents share is one entry per block.
3. Each block learns which of its entries are first, and removes all other windows in such cells that
   repeat an earlier one.

The blocks recompute their windows in each step, so nothing but bits comes back to them. A block looks
at the slices it has something in, not at all; blocks and slices grow with the root of the input, so
that what a block sends to a slice stays worth packing.
"""

from __future__ import annotations

import hashlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20
BLOCK_BYTES = 4 << 20, 256 << 20  # text of a block, least and most; a longer document is a block itself
SLICE_WINDOWS = 2 << 20, 32 << 20  # windows a slice has about, least and most
USUAL_BYTES = 32 << 30  # input beyond which blocks and slices grow
CELLS = 64  # cells of the sketch per window
PIECE = 4 << 20  # bytes hashed at a time

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)  # odd


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


def _spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[begin:end] modulo 2**64, whatever the place."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return (sums[end] - sums[begin]) * _powers(_inverse(base), len(values) + 1)[begin]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; no word goes beyond its document."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(begin), np.uint64)
    first = 0
    while first < len(begin):
        last = max(first + 1, int(np.searchsorted(end, begin[first] + PIECE, "right")))
        low, high = begin[first], end[last - 1]
        part = data[low:high]
        value = _spans(_LETTER[part], begin[first:last] - low, end[first:last] - low, int(_BASE[0]))
        out[first:last] = _mix(value + (end - begin)[first:last].astype(np.uint64))
        first = last
    return out


class Block:
    """Words and windows of the documents of a block, in the order of their ids."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.ids = np.array(
            [np.iinfo(np.int64).min if i is None else i for i in table.column("id").to_pylist()],
            np.int64,
        )
        texts = [t or b"" for t in
                 table.column("content").cast(pa.large_binary()).to_pylist()]
        order = np.argsort(self.ids, kind="stable")
        self.rows, self.ids = order, self.ids[order]
        texts = [texts[i] for i in order]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.begin, self.end = _words(self.data, self.offsets)
        self.first_word = np.searchsorted(self.begin, self.offsets)  # of each document, and the end
        self.window = window
        hashes = _word_hashes(self.data, self.begin, self.end) if len(self.begin) >= window else None
        doc = np.repeat(np.arange(len(texts)), np.diff(self.first_word))
        n = max(0, len(self.begin) - window + 1)
        self.start = np.flatnonzero(doc[:n] == doc[window - 1:window - 1 + n])  # whole windows
        self.doc = doc[self.start]
        # Says in which cell of the sketch a window counts; that two windows share it loses nothing.
        self.hash = np.empty(0, np.uint64)
        if len(self.start):
            self.hash = _mix(_spans(hashes, self.start, self.start + window, int(_BASE[1])))

    def cells(self, slices: int, per_slice: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells in use, ascending, and the cell of each window as a place in them."""
        cell = self.hash % np.uint64(slices * per_slice)
        return np.unique(cell, return_inverse=True)

    def digests(self, kept: np.ndarray) -> np.ndarray:
        """For each of some windows (ascending) two numbers of a cryptographic digest of its words."""
        first, last = (self.start[kept[0]], self.start[kept[-1]] + self.window) if len(kept) else (0, 0)
        raw = self.data.tobytes()
        words = [raw[i:j] for i, j in zip(
            self.begin[first:last].tolist(), self.end[first:last].tolist(), strict=True)]
        text = b" ".join(words)  # words hold no space, so joined they are told apart
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size)
        begin = self.start[kept] - first
        view = memoryview(text)
        out = b"".join([
            blake2b(view[i:j], digest_size=16).digest() for i, j in zip(
                (ends[begin] - size[begin]).tolist(), (ends[begin + self.window - 1] - 1).tolist(), strict=True)
        ])
        return np.frombuffer(out, np.uint64).reshape(-1, 2).T

    def entries(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows ``kept`` (places): the first of each digest, in the order of the digests, and
        these; and for each window its entry."""
        digests = self.digests(kept)
        order = np.lexsort((kept, digests[1], digests[0]))
        digests = digests[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (digests[:, 1:] != digests[:, :-1]).any(0)
        entry = np.empty(len(self.start), np.int64)
        entry[kept[order]] = np.cumsum(new) - 1
        return kept[order][new], digests[:, new], entry

    def place(self, windows: np.ndarray) -> np.ndarray:
        """Start of windows inside their document."""
        return self.start[windows] - self.first_word[self.doc[windows]]


# ---- sparse sketches ---------------------------------------------------------------------

_FILL = 65535


def pack(cells: np.ndarray) -> bytes:
    """Ascending cells as gaps of two bytes; a filler passes over 65535 cells."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    fillers, rest = np.divmod(gaps, _FILL)
    out = np.full(len(gaps) + int(fillers.sum()), _FILL, np.uint16)
    out[np.cumsum(fillers + 1) - 1] = rest
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(packed, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != _FILL]


def _parts(slices: np.ndarray) -> list[tuple[int, int, int]]:
    """The slices that occur in an ascending list, with begin and end of each."""
    begin = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1]])) if len(slices) else []
    ends = np.append(begin[1:], len(slices)) if len(slices) else []
    return [(int(slices[b]), int(b), int(e)) for b, e in zip(begin, ends, strict=True)]


def _cell_parts(cells: np.ndarray, per_slice: int) -> list[tuple[int, int, int]]:
    return _parts(cells // np.uint64(per_slice))


def _digest_parts(high: np.ndarray, slices: int) -> list[tuple[int, int, int]]:
    """Slices of ascending digests are ranges of them."""
    return _parts(high // np.uint64(min(2**64 - 1, -(-(1 << 64) // slices))))


SENT = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("once", pa.binary()),
                  ("more", pa.binary()), ("places", pa.binary())])
BITS = pa.schema([("block", pa.int64()), ("slice", pa.int64()), ("step", pa.int32()),
                  ("bits", pa.binary())])
SENT_SQL = "slice long, block long, once binary, more binary, places binary"
BITS_SQL = "block long, slice long, step int, bits binary"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _masks(table: pa.Table, step: int) -> dict[int, np.ndarray]:
    """Bits of a step by slice."""
    return {
        s: np.unpackbits(np.frombuffer(b, np.uint8))
        for s, k, b in zip(*(table.column(c).to_pylist() for c in ("slice", "step", "bits")),
                           strict=True) if k == step
    }


def _flags(masks: dict[int, np.ndarray], parts: list[tuple[int, int, int]]) -> np.ndarray:
    """Bits of the slices in a row, without the padding."""
    parts = [masks[s][:end - begin] for s, begin, end in parts]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def _sketch(window: int, slices: int, per_slice: int):
    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, window)
        cells, inverse = block.cells(slices, per_slice)
        several = np.bincount(inverse, minlength=len(cells)) > 1
        return _rows(SENT, [
            (s, key[0].as_py(), pack(cells[begin:end] - np.uint64(s * per_slice)),
             np.packbits(several[begin:end]).tobytes(), None)
            for s, begin, end in _cell_parts(cells, per_slice)
        ])

    return sketch


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """Which cells of each block are in use twice or more in all blocks together."""
    blocks = table.column("block").to_pylist()
    cells = [unpack(x) for x in table.column("once").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)).astype(bool)
               for x, c in zip(table.column("more").to_pylist(), cells, strict=True)]
    merged = np.sort(np.concatenate(cells + [c[m] for c, m in zip(cells, several, strict=True)]))
    twice = merged[1:][merged[1:] == merged[:-1]]
    rows = []
    for block, own in zip(blocks, cells, strict=True):
        at = np.searchsorted(twice, own)
        hit = at < len(twice)
        hit[hit] = twice[at[hit]] == own[hit]
        rows.append((block, key[0].as_py(), 1, np.packbits(hit).tobytes()))
    return _rows(BITS, rows)


def _entries(window: int, slices: int, per_slice: int):
    """The second step of a block: its windows in cells with a count of two or more."""

    def entries(key: tuple, docs: pa.Table, bits: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(SENT, [])
        block = Block(docs, window)
        kept = _suspects(block, bits, slices, per_slice)
        first, digests, _ = block.entries(kept)
        places = np.stack([block.ids[block.doc[first]], block.place(first)])
        return _rows(SENT, [
            (s, key[0].as_py(), digests[0, begin:end].tobytes(), digests[1, begin:end].tobytes(),
             np.ascontiguousarray(places[:, begin:end]).tobytes())
            for s, begin, end in _digest_parts(digests[0], slices)
        ])

    return entries


def _suspects(block: Block, bits: pa.Table, slices: int, per_slice: int) -> np.ndarray:
    cells, inverse = block.cells(slices, per_slice)
    flags = _flags(_masks(bits, 1), _cell_parts(cells, per_slice))
    return np.flatnonzero(flags[inverse]) if len(inverse) else np.empty(0, np.int64)


def _first(key: tuple, table: pa.Table) -> pa.Table:
    """Which entries of each block are the first of their window in all documents."""
    blocks = table.column("block").to_pylist()
    high = [np.frombuffer(x, np.uint64) for x in table.column("once").to_pylist()]
    low = [np.frombuffer(x, np.uint64) for x in table.column("more").to_pylist()]
    places = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("places").to_pylist()]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in high])])
    high, low, place = np.concatenate(high), np.concatenate(low), np.concatenate(places, axis=1)
    order = np.lexsort((place[1], place[0], low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    first = np.empty(len(order), bool)
    first[order] = (place[:, order] == place[:, lead]).all(0)
    return _rows(BITS, [
        (block, key[0].as_py(), 2, np.packbits(first[cut[k]:cut[k + 1]]).tobytes())
        for k, block in enumerate(blocks)
    ])


def _removed(window: int, slices: int, per_slice: int, texts: bool):
    """The third step of a block: one row per document."""

    def removed(key: tuple, docs: pa.Table, bits: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({c: docs.column("id").slice(0, 0).cast(pa.int64()) if c == "id"
                             else pa.array([], t) for c, t in OUT.items()})
        block = Block(docs, window)
        kept = _suspects(block, bits, slices, per_slice)
        first, digests, entry = block.entries(kept)
        leads = _flags(_masks(bits, 2), _digest_parts(digests[0], slices))
        # A window stays if its entry is first and it begins at the very place of the entry.
        own = first[entry[kept]]
        stays = leads[entry[kept]] & (block.ids[block.doc[kept]] == block.ids[block.doc[own]]) & (
            block.place(kept) == block.place(own)
        )
        begin = block.start[kept[~stays]]
        change = np.zeros(len(block.begin) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        n_words, n_gone, digests, kept_texts = [], [], [], []
        data = block.data.tobytes()
        for d in range(len(block.ids)):
            a, b = block.first_word[d], block.first_word[d + 1]
            left = b" ".join([data[i:j] for i, j, g in zip(
                block.begin[a:b].tolist(), block.end[a:b].tolist(), gone[a:b].tolist(), strict=True
            ) if not g])
            n_words.append(b - a)
            n_gone.append(int(gone[a:b].sum()))
            digests.append(hashlib.sha256(left).hexdigest())
            kept_texts.append(left.decode() if texts else None)
        back = [docs.column("id")[int(i)].as_py() for i in block.rows]
        return pa.table({
            "id": pa.array(back, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array(digests),
            "kept_text": pa.array(kept_texts, pa.string()),
        })

    return removed


OUT = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(),
       "kept_sha256": pa.string(), "kept_text": pa.string()}


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, texts: bool = True, id_column: str = "doc_id",
    text_column: str = "text", block_bytes: int | None = None, slice_windows: int | None = None,
) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``texts``,
    ``kept_text`` (the words left, joined by one space).

    A word is removed if a window of ``window`` words covers it whose words also start earlier: in a
    document with a smaller id, or earlier in a document with the same id. Windows are judged on the
    input. Rows that repeat an id are documents that begin together: of windows at the same place of
    the same id none is earlier. A null id is smaller than any other; ids are whole numbers. A null
    text has no words. Other columns are not read; an empty table gives an empty result.

    ``block_bytes`` and ``slice_windows`` follow the size of the input where they are not given; a task
    holds some twenty times the bytes of a block.
    """
    content = F.coalesce(F.col(text_column), F.lit(""))
    size, rows = docs.agg(F.sum(F.octet_length(content)), F.count("*")).first()
    growth = max(1.0, (size or 0) / USUAL_BYTES) ** 0.5
    block_bytes = block_bytes or int(min(BLOCK_BYTES[0] * growth, BLOCK_BYTES[1]))
    slice_windows = slice_windows or int(min(SLICE_WINDOWS[0] * growth, SLICE_WINDOWS[1]))
    blocks = max(1, -(-(size or 0) // block_bytes))
    slices = max(1, -(-(size or 0) // (4 * slice_windows)))  # a word and its space: four bytes or so
    per_slice = CELLS * slice_windows
    keyed = docs.select(
        F.col(id_column).cast("long").alias("id"), content.alias("content"),
        F.pmod(F.xxhash64(F.col(id_column), content), F.lit(blocks)).alias("block"),
    )
    by_block = keyed.groupBy("block")
    sketches = by_block.applyInArrow(_sketch(window, slices, per_slice), SENT_SQL)
    flagged = sketches.groupBy("slice").applyInArrow(_merge, BITS_SQL)
    entries = by_block.cogroup(flagged.groupBy("block")).applyInArrow(
        _entries(window, slices, per_slice), SENT_SQL
    )
    leads = entries.groupBy("slice").applyInArrow(_first, BITS_SQL)
    out = by_block.cogroup(flagged.union(leads).groupBy("block")).applyInArrow(
        _removed(window, slices, per_slice, texts),
        "id long, n_words long, n_removed long, kept_sha256 string, kept_text string",
    )
    out = out.withColumnRenamed("id", id_column)
    return out if texts else out.drop("kept_text")
