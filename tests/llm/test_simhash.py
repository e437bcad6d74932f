"""SimHash groups against brute force, on texts and on fingerprints made dense on purpose."""

import numpy as np
import pytest
import xxhash

from zoneflow.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if counts[k] * 2 > len(shingles))


def brute_groups(prints):
    """Set of groups of the distinct values, linked at two bits or fewer."""
    values = sorted(set(prints))
    array = np.array(values, np.uint64)
    seen, groups = np.zeros(len(values), bool), set()
    for start in range(len(values)):
        if seen[start]:
            continue
        seen[start], stack, group = True, [start], []
        while stack:
            i = stack.pop()
            group.append(values[i])
            near = np.flatnonzero((np.bitwise_count(array ^ array[i]) <= 2) & ~seen)
            seen[near] = True
            stack.extend(near.tolist())
        groups.add(frozenset(group))
    return groups


def found_groups(spark, prints):
    from zoneflow.llm.components import components

    frame = spark.createDataFrame(
        [(int(v),) for v in np.unique(np.array(prints, np.uint64).view(np.int64))], "print long"
    )
    root = {v: v for v in map(int, np.unique(np.array(prints, np.uint64)))}
    unsigned = lambda x: int(np.int64(x).view(np.uint64))
    for a, b in components(simhash.near_links(frame)).collect():
        root[unsigned(a)] = unsigned(b)
    groups = {}
    for value, r in root.items():
        groups.setdefault(r, set()).add(value)
    return {frozenset(g) for g in groups.values()}


def test_fingerprint_is_the_stated_one():
    for text in ["", "  ", "One", "one two", "a b c", "A  b\tc\nd " * 50, "É é ß x y z w"]:
        assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_random_and_near_values(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [int(v) ^ (1 << int(i)) ^ (1 << int(j))
            for v in values[:100] for i, j in rng.integers(0, 64, (3, 2))]
    prints = [*map(int, values), *near]
    assert found_groups(spark, prints) == brute_groups(prints)


@pytest.mark.parametrize("direct", [2048, 20])
def test_dense_buckets(spark, monkeypatch, direct):
    """Thousands of values that differ in few bits: buckets are filed a second and a third time."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    monkeypatch.setattr(simhash, "HOLD", 60 if direct == 20 else 1_000_000)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    prints = [base ^ sum(1 << int(i) for i in rng.choice(14, 4, replace=False)) << 24
              for _ in range(700)]
    prints += [base ^ (7 << int(s)) ^ (1 << int(t)) for s, t in rng.integers(0, 60, (200, 2))]
    assert found_groups(spark, prints) == brute_groups(prints)


def test_operator_on_odd_rows(spark):
    texts = ["a b c d e f g h", "A b c d e f g h", None, "", " \t", "x", "y z", "a b c d e f g h"]
    rows = [(i if i != 6 else None, t, 1) for i, t in enumerate(texts)] + [(3, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = [tuple(r) for r in simhash.simhash_components(docs).collect()]
    assert len(got) == len(rows)
    by_print = {}
    for i, text, _ in rows:
        by_print.setdefault(brute_print(text), []).append(i)
    for i, fp, component in got:
        ids = [x for group in brute_groups(by_print) if int(fp, 16) in group
               for v in group for x in by_print[v] if x is not None]
        assert i in by_print[int(fp, 16)] and component == min(ids, default=None)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(brute_groups(by_print))
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0
