"""The registered queries of this subpackage, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.llm import decontaminate, exact, language, mixing, negatives, quality, sharding, simhash
from zoneflow.llm import substring, tokens, toxicity, urls, whitening
from zoneflow.session import ship_code

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_code(spark)
            return function(spark, folder)

        QUERIES[function.__name__] = run
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_simhash(spark, folder):
    return simhash.simhash_components(table(spark, folder, "documents"))


@query(r"""with d as (select doc_id, coalesce(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
  b as (select item_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
  starts as (select item_id, w, least(10, len(w)) l, unnest(range(1, len(w) - least(10, len(w)) + 2)) i
    from b where len(w) > 0),
  g as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') win from starts),
  places as (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i
    from d, (select distinct l from g) where len(w) >= l),
  dw as (select doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') win from places),
  h as (select dw.doc_id, dw.i, dw.l, g.item_id from dw join g on g.win = dw.win and g.l = dw.l),
  covered as (select distinct doc_id, unnest(range(i, i + l)) p from h),
  n as (select doc_id, count(*) n_hit from covered group by 1),
  t as (select doc_id, count(*) n_items, sha256(string_agg(item, ',' order by item)) s
    from (select distinct doc_id, cast(item_id as varchar) item from h) group by 1)
  select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit,
    coalesce(n_items, 0) n_items, coalesce(s, sha256('')) items_sha256, n_hit is not null contaminated
  from d left join n on n.doc_id = d.doc_id left join t on t.doc_id = d.doc_id""")
def op2_decontamination(spark, folder):
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


@query(r"""with parts as (select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
  rules(rule_verdict, rule_host, rule_path) as (values ('allow', 'com', '/'),
    ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
  select page_id, host, path,
    (select rule_host || rule_path from rules where (host = rule_host or ends_with(host, '.' || rule_host))
      and starts_with(path, rule_path) order by length(rule_host || rule_path) desc limit 1) as rule,
    coalesce((select rule_verdict from rules where (host = rule_host or ends_with(host, '.' || rule_host))
      and starts_with(path, rule_path) order by length(rule_host || rule_path) desc limit 1), 'allow')
      as verdict
  from parts""")
def op4_url_filters(spark, folder):
    rules = urls.rule_table(spark, URL_RULES)
    return urls.url_filter(table(spark, folder, "pages"), rules)


@query()
def op3_quality(spark, folder):
    return quality.quality_scores(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


@query()
def op5_sharding(spark, folder):
    placed = sharding.shard_documents(table(spark, folder, "documents"), shards=40)
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


@query()
def op6_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"))
    return toxicity.toxicity_scores(docs, model)


@query()
def op7_token_counts(spark, folder):
    import public_tokenizers

    return tokens.token_counts(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_word=True
    )


@query("""select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
    doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
  from documents window g as (partition by coalesce(text, ''))""")
def op8_exact_dedup(spark, folder):
    return exact.exact_dedup(table(spark, folder, "documents"))


@query(r"""with d as (select doc_id, coalesce(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), []) w
    from documents),
  places as (select doc_id, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20),
  win as (select doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) h from places join d using (doc_id)),
  ranked as (select doc_id, i, row_number() over (partition by h order by doc_id, i) r from win),
  gone as (select distinct doc_id, unnest(range(i, i + 20)) p from ranked where r > 1),
  words as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from d),
  kept as (select doc_id, count(*) n, string_agg(x, ' ' order by p) t
    from words anti join gone using (doc_id, p) group by 1)
  select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed,
    sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)""")
def op9_substring_dedup(spark, folder):
    return substring.substring_dedup(table(spark, folder, "documents"), texts=False)


@query()
def op10_mixing(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents")).drop("source", "rate", "copies")


@query("""with v as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda c: floor(256 * cast(c as double))) x from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding)),
  s as (select a.vec_id anchor_id, o.vec_id as other, a.label = o.label as same,
      cast(list_dot_product(a.x, o.x) as bigint) score
    from v a join v o on o.vec_id <> a.vec_id where a.vec_id % 50 = 0),
  p as (select anchor_id, other positive_id, score positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
  select anchor_id, positive_id, cast(row_number() over g as integer) as rank, other negative_id,
    positive_score, score negative_score
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score
    and 100 * score <= 95 * positive_score
  window g as (partition by anchor_id, positive_id order by score desc, other)
  qualify row_number() over g <= 3""")
def op11_hard_negatives(spark, folder):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").withColumn("label", moved)
    return negatives.mine_hard_negatives(rows, F.col("id") % 50 == 0)


@query()
def op12_whitening(spark, folder):
    rows, model = whitening.whiten(table(spark, folder, "embeddings"))
    return whitening.explode_components(rows, model)


@query()
def op13_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return language.predict_languages(docs, language.fit_languages(docs))
