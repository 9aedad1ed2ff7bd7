"""The registered queries of this subpackage, with reference SQL where SQL can tell the rows."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bytegru import fit as fit_languages
from .bytegru import held_out as language_held_out
from .bytegru import languages
from .centroids import clustered
from .containment import contained_items
from .filteraudit import BIT, ORDERS, filter_audit
from .licenses import license_marks
from .mtree import top_k
from .ngram_join import ngram_components
from .packing import packed
from .pii import personal_data
from .sharding import sharded
from .suffixes import repeats_removed
from .tokencounts import token_counts
from .toxicity import fit, held_out, scored

#: The tokenizer file of the registered queries.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rows(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A supplied table, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_ngram_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(rows(spark, sf_dir, "documents"))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(rows(spark, sf_dir, "documents"), VOCABULARY)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows(spark, sf_dir, "documents")
    weights = fit(docs, rows(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), weights, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_marks(rows(spark, sf_dir, "documents"))


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(rows(spark, sf_dir, "documents"))


@query("op6_decontamination", r"""
with words as (
  select 'd' as kind, doc_id as id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
  union all
  select 'b', item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  from benchmark
), item as (
  select id, least(5, len(w)) as width, w from words where kind = 'b' and len(w) > 0
), item_set as (
  select distinct id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) as g
  from item
), width as (
  select distinct width from item
), doc_set as (
  select distinct id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) as g
  from words cross join width where kind = 'd' and len(w) >= width
), size as (
  select id, count(*) as n from item_set group by id
)
select d.id as doc_id, i.id as item_id, any_value(s.n) as n_item, count(*) as n_shared, count(*) / any_value(s.n) as containment
from doc_set d join item_set i on d.width = i.width and d.g = i.g join size s on s.id = i.id
group by d.id, i.id
having 100 * count(*) >= 75 * any_value(s.n)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(rows(spark, sf_dir, "documents"), rows(spark, sf_dir, "benchmark"))


@query("op8_exact_topk", """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s
)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 5
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = rows(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(rows(spark, sf_dir, "documents"), VOCABULARY)


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(rows(spark, sf_dir, "documents"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(rows(spark, sf_dir, "documents"))


def _rounds_sql(k: int = 16, rounds: int = 3) -> str:
    """The clustering as one SELECT per round."""
    far = "cast(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"
    parts = [f"""v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and len(embedding) = 64 and list_count(embedding) = 64
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by h) - 1 as cluster, e
  from (select e, sha256('1:' || cast(vec_id as varchar)) as h from v) order by h limit {k}
)"""]
    for t in range(rounds + 1):
        parts.append(f"""a{t} as (
  select vec_id, any_value(e) as e, min(o).d as distance, min(o).c as cluster
  from (select v.vec_id, v.e, {{'d': {far}, 'c': c.cluster}} as o from v cross join c{t} c) group by vec_id
)""")
        if t < rounds:
            parts.append(f"""m{t} as (
  select cluster, list((s - ((s % n) + n) % n) // n order by p) as e
  from (select cluster, p, cast(sum(x) as bigint) as s, count(*) as n
        from (select cluster, unnest(e) as x, unnest(range(1, len(e) + 1)) as p from a{t}) group by cluster, p)
  group by cluster
), c{t + 1} as (
  select c.cluster, coalesce(m.e, c.e) as e from c{t} c left join m{t} m on m.cluster = c.cluster
)""")
    return f"""with {", ".join(parts)}
select a.vec_id, cast(a.cluster as integer) as cluster, a.distance,
  cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(a.distance) over () as bigint) as inertia,
  sha256(array_to_string(c.e, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.cluster = a.cluster"""


STEPS_SQL = ", ".join(f"('{o}', {i + 1}, {BIT[o[i]]}, {sum(BIT[c] for c in o[:i])})" for o in ORDERS for i in range(5))


@query("op11_filter_audit", rf"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad
  from labels group by doc_id
), m as (
  select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad,
    case when len(w) < 200 then {BIT['A']} else 0 end
    + case when 100 * len(list_distinct(w)) < 50 * len(w) then {BIT['B']} else 0 end
    + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then {BIT['C']} else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then {BIT['D']} else 0 end
    + case when min(d.doc_id) over (partition by t) < d.doc_id then {BIT['E']} else 0 end as mask
  from d left join l on l.doc_id = d.doc_id
), s as (
  select part, mask, count(*) as n, sum(good) as good, sum(bad) as bad from m group by part, mask
), o as (
  select * from (values {STEPS_SQL}) t(filter_order, step, b, p)
), r as (
  select part, filter_order, step, b,
    sum(case when mask & (p | b) = 0 then n else 0 end) as kept,
    sum(case when mask & b <> 0 and mask & p = 0 then n else 0 end) as removed,
    sum(case when mask & b <> 0 and mask & p <> 0 then n else 0 end) as redundant,
    sum(case when mask = b then n else 0 end) as unique_fails,
    sum(case when mask & b <> 0 and mask & p = 0 then good else 0 end) as good_lost,
    sum(case when mask & b <> 0 and mask & p = 0 then bad else 0 end) as toxic_lost
  from s cross join o group by part, filter_order, step, b
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, b) as bigint) as shapley
from r
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark, f"{sf_dir}/documents.parquet", rows(spark, sf_dir, "labels"))


@query("op12_centroid_clustering", _rounds_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(rows(spark, sf_dir, "embeddings")).drop("scans")


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows(spark, sf_dir, "documents")
    found = languages(docs.select("doc_id", "text"), fit_languages(docs), ["doc_id"])
    return found.select("doc_id", language_held_out().alias("held_out"), "lang_pred", "score")
