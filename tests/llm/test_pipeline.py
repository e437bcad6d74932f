"""The pipeline stage by stage, and the registered queries against their SQL."""

import collections
import math
import os

import odd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_near_copies import jaccard, sets
from zoneflow.llm import queries, simhash, toxicity

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


def write_tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(
        [(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(
        [(1, " ".join(f"p{i}" for i in range(3, 30))), (2, None)], "item_id long, text string"
    ).write.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("some", [True, False])
def test_stages_on_odd_rows(spark, tmp_path, some):
    docs = (odd.frame(spark) if some else odd.empty(spark)).select(
        "doc_id", "text", "lang", "source", "n_chars")
    write_tables(spark, tmp_path, docs)
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
        kept.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
    assert kept.count() > 0 if some else kept.count() == 0


@needs_data
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "sharding"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    clean = stages[0](spark, docs, DATA).cache()
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    rows = [r for r in docs.collect() if scorer.score(r["text"] or "") < 0.5]
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in rows)

    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode(), 5) for r in rows}
    held = {r["doc_id"]: sets(r["text"] or "") for r in rows}
    root = {}
    for i in sorted(prints):
        if i in root:
            continue
        stack = [i]
        root[i] = i
        while stack:
            a = stack.pop()
            for b in prints:
                if b not in root and ((prints[a] ^ prints[b]).bit_count() <= 3
                                      or jaccard(held[a], held[b]) >= 0.8):
                    root[b] = i
                    stack.append(b)
    single = stages[1](spark, clean, DATA).cache()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(root.values()))

    found = queries.QUERIES["op2_decontamination"](spark, DATA).filter("contaminated").collect()
    bad = {r["doc_id"] for r in found}
    pure = stages[2](spark, single, DATA).cache()
    assert {r["doc_id"] for r in pure.collect()} == set(root.values()) - bad

    mixed = stages[3](spark, pure, DATA).cache()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in pure.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    for r in mixed.collect():
        taken[r["source"]] += len((r["text"] or "").split())
    assert math.isclose(sum(taken.values()), sum(sizes.values()), rel_tol=0.1)
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in pure.collect()}

    placed = stages[4](spark, mixed, DATA).collect()
    assert collections.Counter(r["doc_id"] for r in placed) == collections.Counter(
        r["doc_id"] for r in mixed.collect())
    counts = collections.Counter(r["shard"] for r in placed)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1


def test_one_query_for_each_operator():
    names = set(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = connection.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    expected = collections.Counter(tuple(r[i] for i in place) for r in cursor.fetchall())
    assert collections.Counter(tuple(r[c] for c in columns) for r in df.collect()) == expected


@needs_data
@pytest.mark.parametrize("name", ["op2_decontamination", "op4_url_filters", "op8_exact_dedup",
                                  "op5_sharding", "op10_mixing"])
def test_native_plans_have_no_python(spark, name):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        queries.QUERIES[name](spark, DATA).explain("formatted")
    assert not any(x in out.getvalue() for x in ("Python", "Pandas", "Arrow", "Cartesian"))
