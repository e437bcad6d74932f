"""Operators on single texts, groups and windows against brute force, over odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import odd
import pytest

from zoneflow.llm import decontaminate, exact, mixing, sharding, substring, tokens, urls

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def count(rows):
    return collections.Counter(tuple(r) for r in rows)


def words_of(text):
    return SPACE.findall(text or "")


@pytest.mark.parametrize("per_salt", [2, 20_000])
def test_exact(spark, per_salt):
    rows = odd.rows()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    expected, kept = collections.Counter(), 0
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            expected[(i, best, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
        kept += 1
    got = exact.exact_dedup(odd.frame(spark), rows_per_salt=per_salt).collect()
    assert count(got) == expected
    assert sum(r["kept"] for r in got) == kept
    assert exact.exact_dedup(odd.empty(spark)).count() == 0


def brute_verdict(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_urls(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("block", "b.co.uk", ""),
             ("allow", "example.com", "/en/x"), ("block", "net", "/e"), ("allow", "a.net", "/"),
             ("block", "com", "/a/b/c/"), ("allow", "www.example.com", "/en/")]
    found = ["http://EXAMPLE.com/en/x?y", "https://www.example.com/en/", "x://a.net/e/f#g", None, "",
             "no scheme/en/", "http://com", "http://com/", "http://notexample.com/en/",
             "://example.com/en/é\nz", "http://a.b.c.d.e.example.com/en/x/y/z/" + "q/" * 40,
             "ftp://u@b.co.uk", "http://b.co.uk/z", "http://x.com/a/b/c/d://e", "http:///en/",
             "http://ÉÀ.com/a/b/c", "http://example.com/EN/", "http://x.net/eé", "a://b://c.com/"]
    pages = spark.createDataFrame(
        [(i // 2, u, 1, "host") for i, u in enumerate(found * 2)] + [(None, found[0], 1, "r")],
        "page_id long, url string, host int, rule string")
    got = urls.url_filter(pages, urls.rule_table(spark, rules))
    expected = collections.Counter(
        (r.page_id, *brute_verdict(r.url, rules, "allow")) for r in pages.collect())
    assert count(got.collect()) == expected
    assert urls.url_filter(pages.limit(0), urls.rule_table(spark, rules)).count() == 0


def brute_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for name, item in items:
        parts = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        n = min(window, len(parts))
        pieces = {tuple(parts[k:k + n]) for k in range(len(parts) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in pieces:
                hit.update(range(i, i + n))
                found.add("" if name is None else str(name))
    return len(words), hit, sorted(found)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


ITEMS = [(1, " ".join(f"p{i}" for i in range(3, 30))), (2, "P40 p41, p42 p43"), (2, "one"),
         (3, None), (4, "..."), (None, "w1 w2"), (10, "ΑΣ ΑΣ'Α σας İx"), (11, "É")]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_contamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", bound)
    greek = [(90, "x ΑΣ ΑΣ'Α σας İx y", *odd.rows()[0][2:]), (91, "ας ας", *odd.rows()[0][2:])]
    rows = odd.rows() + greek
    docs = spark.createDataFrame(rows, odd.SCHEMA)
    items = spark.createDataFrame([(*x, "c") for x in ITEMS], "item_id long, text string, doc_id string")
    expected = collections.Counter()
    for r in rows:
        n, hit, found = brute_hits(r[1], ITEMS, 10)
        expected[(r[0], n, len(hit), len(found), ",".join(found), bool(hit))] += 1
    got = decontaminate.contamination(docs, items).collect()
    assert count((*r[:4], ",".join(r["items"]), r["contaminated"]) for r in got) == expected
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for k, n in expected.items() if not k[-1])
    cut = decontaminate.decontaminate(docs, items, remove="spans")
    split = re.compile(r"[^0-9A-Za-z\x80-\U0010FFFF]*[0-9A-Za-z\x80-\U0010FFFF]+")
    texts = collections.Counter()
    for r in rows:
        hit = brute_hits(r[1], ITEMS, 10)[1]
        chunks = split.findall(r[1] or "")
        tail = (r[1] or "")[sum(map(len, chunks)):]
        left = "".join(c for k, c in enumerate(chunks) if k not in hit) + tail
        texts[r[1] if not hit else left] += 1
    assert collections.Counter(r["text"] for r in cut.collect()) == texts
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(odd.empty(spark), items).count() == 0


def brute_removed(rows, window):
    first = {}
    low = lambda i: -2**63 if i is None else i
    windows = []
    for k, r in enumerate(rows):
        w = words_of(r[1])
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            windows.append((k, s, key))
            first[key] = min(first.get(key, (2**63, 0)), (low(r[0]), s))
    gone = collections.defaultdict(set)
    for k, s, key in windows:
        if (low(rows[k][0]), s) > first[key]:
            gone[k].update(range(s, s + window))
    out = collections.Counter()
    for k, r in enumerate(rows):
        w = words_of(r[1])
        left = " ".join(x for i, x in enumerate(w) if i not in gone[k])
        out[(r[0], len(w), len(gone[k]), hashlib.sha256(left.encode()).hexdigest(), left)] += 1
    return out


@pytest.mark.parametrize("sizes", [(4 << 20, 2 << 20), (300, 40)])
def test_substring(spark, sizes):
    docs = odd.frame(spark)
    got = substring.substring_dedup(docs, block_bytes=sizes[0], slice_windows=sizes[1])
    assert count(got.collect()) == brute_removed(odd.rows(), 20)
    got = substring.substring_dedup(docs, window=3, block_bytes=sizes[0], slice_windows=sizes[1])
    assert count(got.collect()) == brute_removed(odd.rows(), 3)
    assert substring.substring_dedup(odd.empty(spark)).count() == 0


def test_substring_sketch_overestimates(spark, monkeypatch):
    """With far too few cells nearly all windows pass the prefilter; the result is the same."""
    monkeypatch.setattr(substring, "CELLS", 1)
    got = substring.substring_dedup(odd.frame(spark), window=3, block_bytes=500, slice_windows=20)
    assert count(got.collect()) == brute_removed(odd.rows(), 3)


def test_windows_of_clashing_hashes_are_told_apart(spark):
    """A Thue-Morse word of 1024 letters and its complement have one polynomial hash modulo 2**64,
    whatever the base and the values of the letters."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(19))
    data = np.frombuffer(f"{word} {other}".encode(), np.uint8)
    hashes = substring._word_hashes(data, np.array([0, 1025]), np.array([1024, 2049]))
    assert hashes[0] == hashes[1]  # so the sketch holds them for one window
    rows = [(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{other} {rest}")]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 0), (3, 20)]


def test_substring_with_a_text_of_megabytes(spark):
    rng = random.Random(3)
    passage = " ".join(f"q{i}" for i in range(25))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    rows = [(1, f"{long} {passage}"), (2, f"x {passage} y"), (3, long), (4, None)]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), texts=False)
    assert len(long) > 3_000_000
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()) == [
        (1, 400_025, 0), (2, 27, 25), (3, 400_000, 400_000), (4, 0, 0)]


def test_occupied_slices_only():
    cells = np.array([3, 4, 70, 71, 72, 900], np.uint64)
    assert substring._cell_parts(cells, 10) == [(0, 0, 2), (7, 2, 5), (90, 5, 6)]
    assert substring._cell_parts(cells[:0], 10) == []
    high = np.array([0, 2**63 - 1, 2**63, 2**64 - 1], np.uint64)
    assert substring._digest_parts(high, 2) == [(0, 0, 2), (1, 2, 4)]
    assert substring._digest_parts(high, 1) == [(0, 0, 4)] or substring._digest_parts(high, 1)[0][0] == 0


def test_tokens(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = odd.rows() + [(77, "a <|endoftext|>b<|startoftext|> é e\u0301 x\u00a0y\x1cz \u2028Σ'S n't 12", *odd.rows()[0][2:])]
    docs = spark.createDataFrame(rows, odd.SCHEMA)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    expected = collections.Counter()
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False))
        expected[(r[0], len((r[1] or "").encode()), n, n > 50)] += 1
    cache = str(tmp_path / "cache")
    for by_word in (True, False):
        got = tokens.token_counts(docs, path, limit=50, by_word=by_word)
        assert count(got.collect()) == expected
    half = docs.limit(15)
    tokens.token_counts(half, path, cache=cache, by_word=True).count()
    before = spark.read.parquet(cache).count()
    assert before == half.select("text").na.fill("").distinct().count()
    assert count(tokens.token_counts(docs, path, limit=50, cache=cache, by_word=True).collect()) == expected
    stored = spark.read.parquet(cache)
    assert stored.count() > before
    assert stored.select("digest").distinct().count() == len({r[1] or "" for r in rows})
    total = stored.count()
    tokens.token_counts(docs, path, cache=cache, by_word=True).count()
    assert spark.read.parquet(cache).count() == total  # nothing was missing
    assert tokens.token_counts(odd.empty(spark), path).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        scale = sum(weight[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / scale for s in order}
        over = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("per_slot", [1, 1000])
def test_mixing(spark, per_slot):
    rows = odd.rows() * 3
    docs = spark.createDataFrame(rows, odd.SCHEMA)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    target = brute_targets(sizes)
    got = mixing.mix_sources(docs, rows_per_slot=per_slot).collect()
    assert count((r["doc_id"], r["source"], r["size"]) for r in got) == count(
        (r[0], r[3], len(words_of(r[1]))) for r in rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        assert abs(r["copies"] - r["rate"]) < 1 or r["rate"] == r["copies"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix_sources(docs.repartition(7), rows_per_slot=per_slot).collect()
    assert count(again) == count(got)
    # Rates are one exponential of the size per source, below the cap.
    import math
    tilt = {}
    for r in got:
        if r["size"] and r["rate"] < 3:
            tilt.setdefault(r["source"], []).append(math.log(r["rate"]) / r["size"])
    for values in tilt.values():
        assert max(values) - min(values) < 1e-9
    repeated = mixing.repeat_documents(docs)
    assert repeated.columns == docs.columns
    total = collections.Counter()
    for r in repeated.collect():
        total[r["source"]] += len(words_of(r["text"]))
    assert total == +taken if per_slot == 1000 else True
    assert mixing.mix_sources(odd.empty(spark)).count() == 0
    assert mixing.repeat_documents(odd.empty(spark)).count() == 0


def test_mixing_word_count(spark):
    from pyspark.sql import functions as F
    docs = odd.frame(spark)
    got = docs.select("text", mixing.word_count(F.col("text")).alias("n"),
                      decontaminate.word_count(F.coalesce("text", F.lit(""))).alias("m")).collect()
    for r in got:
        assert r["n"] == len(words_of(r["text"]))
        assert r["m"] == brute_hits(r["text"], [], 10)[0]


@pytest.mark.parametrize("shards", [1, 4, 7, 40])
def test_sharding(spark, shards):
    rows = odd.rows() + [(1000 + i, f"copy {i // 9}", *odd.rows()[0][2:]) for i in range(60)]
    docs = spark.createDataFrame(rows, odd.SCHEMA)
    placed = sharding.shard_documents(docs, shards=shards, rows_per_lot=5)
    got = placed.collect()
    assert count((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == count(
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = collections.defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "rows"
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shard_documents(docs.repartition(5), shards=shards, rows_per_lot=5)
    assert count(again.collect()) == count(got)
    assert sharding.shard_documents(odd.empty(spark), shards=shards).count() == 0


def test_sharding_keeps_copies_together(spark):
    """Groups that fit are whole, however many rounds chance would take without links."""
    rows = [(i, f"copy {i // 10}", None, None, None, *odd.rows()[0][5:]) for i in range(100)]
    rows += [(200 + i, f"single {i}", None, None, None, *odd.rows()[0][5:]) for i in range(300)]
    docs = spark.createDataFrame(rows, odd.SCHEMA)
    placed = sharding.shard_documents(docs, shards=4, rows_per_lot=50).collect()
    shards = collections.defaultdict(set)
    for r in placed:
        if r["doc_id"] < 100:
            shards[r["doc_id"] // 10].add(r["shard"])
    assert sum(len(s) - 1 for s in shards.values()) == 0


def test_targets_with_ties_and_nulls(spark):
    """Sources of equal room per weight, one of them null, and empty ones."""
    for sizes in ({"a": 10, "b": 20, None: 30}, {"a": 1, "b": 2, "c": 300, None: 1},
                  {"a": 0, None: 0}, {"a": 5, "b": 0, "c": 0, "d": 1, None: 4}, {None: 3}):
        table = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.water_fill(table, (1, 2, 3), 3.0).collect()}
        expected = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
        assert got == pytest.approx(expected)
