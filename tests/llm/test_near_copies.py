"""The near-copy stage against all pairs of five-word shingle sets."""

import random

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from zoneflow.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text):
    words = text.encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def near_texts():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = ["", "one", "one two", "One  two"]
    for group in range(40):
        base = [word() for _ in range(rng.randrange(30, 200))]
        texts.append(" ".join(base))
        for _ in range(1 + 30 * (group == 0)):
            edited = list(base)
            for _ in range(1 + len(base) // 60):
                edited[rng.randrange(len(base))] = word()
            texts.append(" ".join(edited))
    return texts


def brute_kept(texts):
    """Smallest place of each group that the stage links, and how many links need the sets."""
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    held = [sets(t) for t in texts]
    root, far = {}, 0
    for i in range(len(texts)):
        if i in root:
            continue
        root[i], stack = i, [i]
        while stack:
            a = stack.pop()
            for b in range(len(texts)):
                bits = (prints[a] ^ prints[b]).bit_count()
                if b not in root and (bits <= 3 or jaccard(held[a], held[b]) >= 0.8):
                    root[b] = i
                    far += bits > 3
                    stack.append(b)
    return sorted(set(root.values())), far


def test_stage_drops_edited_copies_many_bits_apart(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    kept, far = brute_kept(texts)
    assert far > 20
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == kept


def test_alike_texts_share_a_key():
    texts = near_texts()
    held = [sets(t) for t in texts]
    keys = [set(shingles.band_keys(shingles.shingle_set(t.encode())).tolist()) for t in texts]
    assert [len(shingles.shingle_set(t.encode())) for t in texts] == [len(s) for s in held]
    for i in range(len(texts)):
        for j in range(i):
            assert jaccard(held[i], held[j]) < 0.8 or keys[i] & keys[j]


@pytest.mark.parametrize("cells", [50, 4_000_000])
def test_alike_pairs_are_exact(monkeypatch, cells):
    monkeypatch.setattr(shingles, "CELLS", cells)
    texts = near_texts()
    held = [sets(t) for t in texts]
    i, j = shingles.alike_pairs([shingles.shingle_set(t.encode()) for t in texts if t], 0.8)
    held = [h for h in held if h]
    expected = [(a, b) for a in range(len(held)) for b in range(a + 1, len(held)) if jaccard(held[a], held[b]) >= 0.8]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == expected and len(expected) > 30
    two = [np.array([1, 2, 3, 4], np.uint64), np.array([2, 3, 4, 5, 9], np.uint64)]
    assert len(shingles.alike_pairs(two, 0.5)[0]) == 1 and len(shingles.alike_pairs(two, 0.51)[0]) == 0


def crowded_texts(n=150):
    """One passage in all texts, with a tail of its own in each: every key of the passage holds many of
    them, some alike to each other and most not."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(n):
        tail = [f"t{rng.randrange(5000)}" for _ in range(rng.choice([2, 6, 14, 30]))]
        texts.append(" ".join(passage + tail))
    return texts + [texts[3].upper(), texts[3].replace(" ", "  "), " ".join(reversed(passage))]


def linked_groups(links, texts):
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    root = {signed(p): signed(p) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links.collect():
        root[find(r["a"])] = find(r["b"])
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(find(signed(p)), []).append(i)
    return sorted(groups.values())


@pytest.mark.parametrize(("members", "total"), [(1024, 4_000_000), (16, 4_000_000), (1024, 1500), (5, 300)])
def test_crowded_keys_lose_no_link(spark, monkeypatch, members, total):
    """Whatever the size of a block, also where a key is split over many, groups are those of all pairs."""
    texts = crowded_texts()
    monkeypatch.setattr(shingles, "MEMBERS", members)
    monkeypatch.setattr(shingles, "TOTAL", total)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    rows = simhash._printed(docs, "id", "content", 5, digest=True, keys=True)
    contents = docs.select("id", F.sha2("content", 256).alias("digest"), "content")
    got = linked_groups(shingles.similar_links(rows, contents, 0.8), texts)
    held = [sets(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(held[i], held[j]) >= 0.8 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(i)
    assert got == sorted(groups.values()) and 3 < len(got) < len(texts) - 20


def test_odd_rows(spark):
    docs = odd.frame(spark)
    kept = simhash.simhash_dedup(docs, shingle=5, bits=3, jaccard=0.8)
    assert kept.columns == docs.columns
    rows = [r for r in odd.rows() if r[0] is not None]
    assert {r["key"] for r in kept.collect()} <= {None} and 0 < kept.count() < len(rows)
    assert simhash.simhash_dedup(odd.empty(spark), shingle=5, bits=3, jaccard=0.8).count() == 0
