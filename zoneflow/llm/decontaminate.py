"""Benchmark decontamination by a set of normalised word windows.

A text is scanned in three steps, all of them DataFrame operations:

1. Blocks. Every window of L words holds a whole block of b = (L + 1) // 2 words that begins at a
   multiple of L - b + 1. So one hash per few words, met with the hashes of all b-word pieces of the
   benchmark windows, finds each text that could hold a window. That set is broadcast if its counted
   size is within ``MAX_BROADCAST``, and joined by a shuffle beyond.
2. Windows. All windows of those texts, each text once however many rows have it, are met with the
   benchmark windows by their full words.
3. The hit words and items of a text go back to all rows that have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow.llm.urls import LOWER, UPPER
from zoneflow.session import materialize

WINDOW = 10
OTHER = r"\x00-\x2F\x3A-\x60\x7B-\x7F"  # what is in no word, after A-Z are lower case
WORD = f"[^{OTHER}]++"
MAX_BROADCAST = 1_000_000  # hashes of eight bytes


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _loosely_lowered(text: Column) -> Column:
    """Cheaper than ``_lowered``, and the same for texts that are the same there.

    The capital sigma is the one letter whose lower case depends on its surroundings.
    """
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def _words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; no array is built."""
    begun = F.regexp_replace(_loosely_lowered(text), rf"\A[{OTHER}]++", "")
    return F.length(F.regexp_replace(begun, f"{WORD}[{OTHER}]*+", "x")).cast("long")


def _pieces(words: Column, length: int, step: int) -> Column:
    """Hashes of ``length`` words from every ``step``-th word on."""
    last = F.size(words) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.xxhash64(F.lit(length), F.slice(words, i + 1, length)))


def _windows(words: Column, length: int | Column) -> Column:
    last = F.size(words) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    length = F.lit(length) if isinstance(length, int) else length
    return F.transform(starts, lambda i: F.struct(
        i.alias("start"), length.cast("int").alias("length"),
        F.array_join(F.slice(words, i + 1, length), " ").alias("window"),
    ))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_hits(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per distinct text with a hit: ``digest`` (SHA-256), ``hit`` (sorted places of the hit words,
    from 0) and ``items`` (sorted, as strings)."""
    items = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"),
        _lowered(_text(item_text_column)).alias("lowered"),
    ).withColumn("words", _words(F.col("lowered"))).filter(F.size("words") > 0)
    grams = items.select(
        "item", F.inline(_windows(F.col("words"), F.least(F.lit(window), F.size("words"))))
    ).select("item", "window", F.col("length").alias("gram_length")).distinct()
    grams = materialize(grams)
    windows = grams.select("window", "gram_length").distinct()
    lengths = sorted(r[0] for r in windows.select("gram_length").distinct().collect())  # 1 to window
    block = {n: (n + 1) // 2 for n in lengths}

    loose = F.split(_loosely_lowered(F.col("window")), " ")
    anchors = [
        windows.filter(F.col("gram_length") == n).select(F.explode(_pieces(loose, block[n], 1)).alias("piece"))
        for n in lengths
    ] or [windows.select(F.lit(0).cast("long").alias("piece")).limit(0)]
    pieces = anchors[0]
    for more in anchors[1:]:
        pieces = pieces.union(more)
    pieces = pieces.distinct()
    if pieces.count() <= MAX_BROADCAST:
        pieces = F.broadcast(pieces)
    texts = docs.select(_text(text_column).alias("content"))
    scanned = texts.select(
        F.xxhash64("content").alias("key"), _words(_loosely_lowered(F.col("content"))).alias("words")
    )
    blocks = [_pieces(F.col("words"), block[n], n - block[n] + 1) for n in lengths]
    met = scanned.select(
        "key", F.explode(F.concat(F.array().cast("array<bigint>"), *blocks)).alias("piece")
    ).join(pieces, "piece", "left_semi").select("key").distinct()

    suspects = texts.withColumn("key", F.xxhash64("content")).join(met, "key", "left_semi").select(
        F.sha2("content", 256).alias("digest"), "content"
    ).dropDuplicates(["digest"]).withColumn("words", _words(_lowered(F.col("content"))))
    none = F.array().cast("array<struct<start:int,length:int,window:string>>")
    found = materialize(suspects.select(
        "digest", F.inline(F.concat(none, *[_windows(F.col("words"), n) for n in lengths]))
    ).join(windows.select("window"), "window"))
    places = F.flatten(F.transform(
        F.collect_set(F.struct("start", "length")),
        lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1),
    ))
    hit = found.groupBy("digest").agg(F.array_sort(F.array_distinct(places)).alias("hit"))
    # An item counts once per text, however many of its windows the text has.
    held = found.select("digest", "window").distinct().join(grams.select("window", "item"), "window")
    items = held.select("digest", "item").distinct().groupBy("digest").agg(
        F.array_sort(F.collect_list("item")).alias("items"))
    return hit.join(items, "digest")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_hit``, ``n_items``, ``items``,
    ``contaminated``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. A word inside any occurrence of a window is hit. Null texts have no words. A null item id
    is the empty string; rows that repeat an item id count as one item. Ids may be null or repeat;
    other columns are not read; empty tables give empty results or no hits.
    """
    hits = text_hits(docs, benchmark, text_column, item_column, item_text_column, window)
    rows = docs.select(
        F.col(id_column).alias("id"), word_count(_text(text_column)).alias("n_words"),
        F.sha2(_text(text_column), 256).alias("digest"),
    )
    # A written table: Spark can then split a digest that many rows share when it joins.
    hits = materialize(hits.select("digest", F.size("hit").cast("long").alias("n_hit"), "items"))
    return rows.join(hits, "digest", "left").select(
        F.col("id").alias(id_column), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``docs``, all columns as they were, without the rows that hold a window (``documents``) or
    without the hit words, each with what stands between it and the word before (``spans``).

    Null and wordless texts hold no window and stay as they are; rows that repeat are judged alike.
    Columns may have any names. An empty table gives an empty one, an empty benchmark changes nothing.
    """
    hits = materialize(
        text_hits(docs, benchmark, text_column, item_column, item_text_column, window).select("digest", "hit")
    )
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.sha2(_text(text_column), 256).alias("digest"))
    if remove == "documents":
        return keyed.join(hits.select("digest"), "digest", "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    text = F.col(f"row.`{text_column}`")
    upper_other = OTHER.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # the text as it is has A-Z
    chunks = F.regexp_extract_all(text, F.lit(f"[{upper_other}]*+[^{upper_other}]++"), F.lit(0))
    # Places are marked in a row as long as the words, so a long text takes one pass.
    left = F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), F.col("hit"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at(chunks, i + 1)), "")
    tail = F.regexp_extract(text, rf"[{upper_other}]*+\z", 0)
    cut = F.when(F.col("hit").isNull(), text).otherwise(F.concat(kept, tail))
    return keyed.join(hits, "digest", "left").select(*[
        (cut if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
