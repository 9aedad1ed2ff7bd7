"""Runs, health, activity, evaluation, provenance, export and search queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..lineage import cut_lineage, scratch_path
from ..operators import metrics, provenance, reports, resolve, search
from ..sources import sinks
from .inputs import ctes, derived, table
from .q_entities import ENTITY_UUID, HITS, hits, stored_hits
from .q_text import uuid5_sql
from .registry import query

RUNS = ctes("runs")

# --- collection runs and health ------------------------------------------------
WIN = "over (partition by source order by run_at, run_id rows unbounded preceding)"


@query("win_cumulative", RUNS + f"""
select source, run_id, row_number() over (partition by source order by run_at, run_id) as run_count, cast(sum(items) {WIN} as bigint) as cumulative_items,
  case when items > 0 then 'success' else 'empty' end as status from runs""")
def win_cumulative(spark, sf):
    return metrics.run_history(derived(spark, sf, "runs")).select("source", "run_id", "run_count", "cumulative_items", "status")


@query("agg_sources", RUNS + """
select source, count(*) as run_count, cast(sum(items) as bigint) as cumulative_items, max(run_at) as completed_at, arg_max(items, run_at) as total_items,
  case when arg_max(items, run_at) > 0 then 'success' else 'empty' end as status from runs group by source""")
def agg_sources(spark, sf):
    return metrics.source_summary(derived(spark, sf, "runs"))


@query("agg_runs", RUNS + """
, s as (select source, arg_max(items, run_at) as t from runs group by source) select count(*) as total_sources_run, cast(sum(t) as bigint) as total_items_collected from s""")
def agg_runs(spark, sf):
    return metrics.run_totals(metrics.source_summary(derived(spark, sf, "runs")))


@query("agg_events_daily", """
with d as (select unnest(generate_series(date '2024-01-27', date '2024-02-02', interval 1 day))::date as day),
c as (select ts::date as day, count(*) as n from events group by 1) select cast(d.day as varchar) as day, coalesce(n, 0) as n from d left join c on d.day = c.day""")
def agg_events_daily(spark, sf):
    events = table(spark, sf, "events").select(F.col("ts").alias("observed_at"))
    return metrics.daily_events(events, F.lit("2024-02-02").cast("date")).withColumn("day", F.col("day").cast("string"))


@query("agg_health", ctes("requests") + """
, t as (select source_id, max(seq) filter (ok) as last_ok, count(*) as total_requests, count(*) filter (ok) as total_successes, count(*) filter (not ok) as total_failures from requests group by source_id),
s as (select r.source_id, count(*) as f, count(*) filter (http_status = 429) as l from requests r join t using (source_id) where not ok and (last_ok is null or seq > last_ok) group by r.source_id)
select t.source_id, total_requests, total_successes, total_failures, coalesce(f, 0) as consecutive_failures, coalesce(l, 0) as consecutive_429s,
  case when coalesce(f, 0) >= 5 then 'offline' when coalesce(f, 0) > 0 then 'degraded' else 'online' end as status,
  case when coalesce(l, 0) > 0 then least(pow(2, l) * 60, 3600) when coalesce(f, 0) > 0 then least(pow(2, f) * 10, 600) else 0.0 end as backoff_seconds
from t left join s using (source_id)""")
def agg_health(spark, sf):
    return metrics.source_health(derived(spark, sf, "requests")).drop("last_success", "last_failure")


@query("agg_entity_totals", ctes("posts") + r"""
select 'emails' as entity_type, cast(sum(len(list_distinct(regexp_extract_all(text, '[\pL\p{Nd}_.+-]+@[\pL\p{Nd}_-]+\.[\pL\p{Nd}_.-]+')))) as bigint) as n from posts
union all select 'pgp_key_hashes', cast(sum(len(regexp_extract_all(text, '(?s)-----BEGIN PGP PUBLIC KEY BLOCK-----.*?-----END PGP PUBLIC KEY BLOCK-----'))) as bigint) from posts
union all select 'btc_addresses', cast(sum(len(list_distinct(regexp_extract_all(text, '\b((?:1|3)[1-9A-HJ-NP-Za-km-z]{25,34})\b', 1)))) as bigint) from posts""")
def agg_entity_totals(spark, sf):
    from ..functions.identifiers import archive_entities

    rows = derived(spark, sf, "posts").select(archive_entities(F.col("text")).alias("entities"))
    return metrics.entity_totals(rows).select("entity_type", F.col("n").cast("long").alias("n"))


# --- activity -------------------------------------------------------------------
@query("agg_circadian", "select user_id as actor_id, " + ", ".join(f"count(*) filter (hour(ts) = {h}) as h{h:02d}" for h in range(24)) + ", "
       + ", ".join(f"count(*) filter (dayofweek(ts) + 1 = {d}) as d{d}" for d in range(1, 8)) + " from events group by user_id")
def agg_circadian(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("actor_id"), F.col("ts").alias("posted_at"))
    return metrics.activity_profile(ev)


@query("win_gap", """
select user_id as actor_id, event_id as post_id, cast(floor(epoch(ts)) - lag(floor(epoch(ts))) over w as bigint) as gap_before,
  cast(lead(floor(epoch(ts))) over w - floor(epoch(ts)) as bigint) as gap_after from events window w as (partition by user_id order by ts, event_id)""")
def win_gap(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("actor_id"), F.col("event_id").alias("post_id"), F.col("ts").alias("posted_at"))
    return metrics.posting_gaps(ev).drop("posted_at")


SCORED = "select doc_id, quality as label, n_chars % 97 + quality * 20 as score from labels join documents using (doc_id)"


@query("agg_auc", f"""
with s as ({SCORED}), r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from s),
n as (select count(*) filter (label = 1) as p, count(*) filter (label <> 1) as q from s),
th as (select t.score, (select count(*) from s where label = 1 and score < t.score) / (select p from n)::double as miss,
  (select count(*) from s where label <> 1 and score >= t.score) / (select q from n)::double as fl from (select distinct score from s) t)
select round((sum(rk) filter (label = 1) - p * (p + 1) / 2.0) / (p::double * q), 6) as auc,
  (select round((miss + fl) / 2, 6) from th order by abs(miss - fl), score limit 1) as eer, p as n_pos, q as n_neg from r, n group by p, q""")
def agg_auc(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    scored = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") % 97 + F.col("quality") * 20).alias("score")
    )
    return metrics.roc_auc(scored).select(F.round("auc", 6).alias("auc"), F.round("eer", 6).alias("eer"), "n_pos", "n_neg")


TRUTH_SQL = """
, truth as (select cast(doc_id as varchar) as event_id, 'pgp' as kind, upper(substr(sha256('pgp' || cast(doc_id // 6 as varchar)), 1, 40)) as normalized, doc_id % 4 in (0, 3) as in_text from documents
 union all select cast(doc_id as varchar), 'handle', 'user' || doc_id // 4, true from documents
 union all select cast(doc_id as varchar), 'wallet', 'T' || translate(substr(sha256('trx' || cast(doc_id // 5 as varchar)), 1, 33), '0', 'x'), doc_id % 4 = 3 from documents
 union all select cast(doc_id as varchar), 'contact_id', '@missing' || doc_id, true from documents)"""


@query("agg_eval_extract", HITS + TRUTH_SQL + """
, c as (select t.kind, count(*) filter (h.event_id is not null) as tp, count(*) filter (h.event_id is null and in_text) as fn from truth t
  left join hits h on t.event_id = h.event_id and t.kind = h.kind and t.normalized = h.normalized group by t.kind)
select kind, tp, cast(0 as bigint) as fp, fn, case when tp > 0 then 1.0 else 0.0 end::double as "precision", round(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end, 6) as recall,
  round(case when tp > 0 then 2.0 * tp / (2 * tp + fn) else 0 end, 6) as f1 from c""")
def agg_eval_extract(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")

    def tag(name: str, k: int):
        return F.sha2(F.concat(F.lit(name), s(F.floor(F.col("doc_id") / k))), 256)

    k = F.col("doc_id") % 4
    items = F.array(
        F.struct(F.lit("pgp").alias("kind"), F.upper(F.substring(tag("pgp", 6), 1, 40)).alias("normalized"), k.isin(0, 3).alias("in_text")),
        F.struct(F.lit("handle").alias("kind"), F.concat(F.lit("user"), s(F.floor(F.col("doc_id") / 4))).alias("normalized"), F.lit(True).alias("in_text")),
        F.struct(F.lit("wallet").alias("kind"), F.concat(F.lit("T"), F.translate(F.substring(tag("trx", 5), 1, 33), "0", "x")).alias("normalized"), (k == 3).alias("in_text")),
        F.struct(F.lit("contact_id").alias("kind"), F.concat(F.lit("@missing"), s("doc_id")).alias("normalized"), F.lit(True).alias("in_text")),
    )
    truth = d.select(s("doc_id").alias("actor_id"), F.explode(items).alias("t")).select("actor_id", "t.*")
    found = hits(spark, sf).select(F.col("event_id").alias("actor_id"), "kind", "normalized")
    out = metrics.evaluate_extraction(truth, found)
    return out.select("kind", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# --- provenance --------------------------------------------------------------------
EVID = f"""with ev as (select doc_id, 'sha256:' || sha256(text) as content_hash, make_timestamp((1704067200 + doc_id // 3) * 1000000) as collected_at,
 {uuid5_sql("'sha256:' || sha256(text) || ':' || cast(doc_id as varchar)")} as evidence_id from documents),
 num as (select *, row_number() over (order by collected_at, evidence_id) - 1 as n from ev)"""


def evidence(spark, sf, seconds=None) -> DataFrame:
    """Documents as evidence, collected ``seconds`` after a fixed time: three a second by default."""
    seconds = F.floor(F.col("doc_id") / 3) if seconds is None else seconds
    d = table(spark, sf, "documents").select(
        "doc_id", hashing.content_hash(F.col("text")).alias("content_hash"),
        F.timestamp_seconds(F.lit(1_704_067_200) + seconds).alias("collected_at"),
    )
    return d.withColumn("evidence_id", hashing.evidence_id(F.col("content_hash"), F.col("doc_id").cast("string")))


@query("win_batch", EVID + " select doc_id, n // 100 as batch_no, cast(n % 100 as bigint) as pos from num")
def win_batch(spark, sf):
    return provenance.assign_batches(evidence(spark, sf)).select("doc_id", "batch_no", F.col("pos").cast("long").alias("pos"))


def merkle_levels_sql() -> str:
    """Seven rounds of pairing by position, as rows."""
    out = "l0 as (select n // 100 as b, n % 100 as p, substr(content_hash, 8) as h from num)"
    for i in range(7):
        out += (
            f", l{i + 1} as (select b, p // 2 as p, case when (select count(*) from l{i} y where y.b = x.b) = 1 then any_value(h) "
            f"else sha256(string_agg(h, '' order by p) || case when count(*) = 1 then any_value(h) else '' end) end as h from l{i} x group by b, p // 2)"
        )
    return out


@query("prov_merkle", EVID + ", " + merkle_levels_sql() + """
, c as (select n // 100 as b, count(*) as leaf_count from num group by 1) select l7.b as batch_no, leaf_count, 'sha256:' || h as root_hash from l7 join c on l7.b = c.b""")
def prov_merkle(spark, sf):
    return provenance.merkle_batches(provenance.assign_batches(evidence(spark, sf)))


#: Evidence that comes at one item a second, with pauses of 400 seconds: batches close by size and by time.
PAUSES = EVID.replace("1704067200 + doc_id // 3", "1704067200 + doc_id + 400 * (doc_id // 350)").replace("with ev as", "with recursive ev as")


@query("prov_batches", PAUSES + """
, s as (select n, evidence_id, collected_at, coalesce(lag(collected_at) over (order by n), collected_at) as began from num),
e as (select i.n, min(j.n) as last from s i join s j on j.n between i.n and i.n + 99 and (j.n = i.n + 99 or epoch(j.collected_at) - epoch(i.began) >= 300) group by i.n),
b as (select 0 as batch_no, cast(0 as bigint) as first union all select batch_no + 1, last + 1 from b join e on e.n = b.first where last + 1 <= (select max(n) from s)),
c as (select batch_no, first, coalesce(e.last, (select max(n) from s)) as last, e.last is not null as closed from b left join e on e.n = b.first)
select cast(batch_no as bigint) as batch_no, count(*) as leaf_count, closed, min(evidence_id) as first_id from c join s on s.n between c.first and c.last group by batch_no, closed""")
def prov_batches(spark, sf):
    """Batches by size and time; with ranges of a few hundred rows, so that chains cross many of them."""
    ev = evidence(spark, sf, F.col("doc_id") + 400 * F.floor(F.col("doc_id") / 350))
    a = provenance.assign_timed_batches(ev, range_rows=256)
    return a.groupBy("batch_no", "closed").agg(F.count(F.lit(1)).alias("leaf_count"), F.min("evidence_id").alias("first_id"))


@query("prov_verify", EVID + " select distinct n // 100 as batch_no, (n // 100) % 2 = 0 as ok from num")
def prov_verify(spark, sf):
    """Stored roots against recomputed ones; the roots of odd batches are altered on purpose."""
    a = provenance.assign_batches(evidence(spark, sf))
    stored = provenance.merkle_batches(a).withColumn(
        "root_hash", F.when(F.col("batch_no") % 2 == 0, F.col("root_hash")).otherwise(F.concat(F.lit("sha256:"), F.sha2("root_hash", 256)))
    )
    return provenance.verify(a, stored)


@query("jn_provenance", EVID + " , c as (select n // 100 as b, count(*) as leaf_count from num where n // 100 % 3 <> 2 group by 1) select evidence_id, content_hash, n // 100 as batch_no, leaf_count from num left join c on n // 100 = b")
def jn_provenance(spark, sf):
    """Batches that are not anchored yet have no row, and their evidence keeps NULLs."""
    a = provenance.assign_batches(evidence(spark, sf))
    anchored = a.filter(F.col("batch_no") % 3 != 2).groupBy("batch_no").agg(F.count(F.lit(1)).alias("leaf_count"))
    return provenance.lookup(a, anchored).select("evidence_id", "content_hash", "batch_no", "leaf_count")


# --- exports ---------------------------------------------------------------------------
ACT = HITS + f"""
, act as (select event_id, {uuid5_sql("'actor|' || normalized")} as actor_id, normalized as label, observed_at from hits where kind = 'handle'),
actors as (select actor_id, label, min(observed_at) as first_seen, max(observed_at) as last_seen from act group by actor_id, label),
lk as (select distinct actor_id, {ENTITY_UUID} as entity_id, kind, normalized from act join hits using (event_id)),
entities as (select distinct {ENTITY_UUID} as entity_id, kind, normalized from hits)"""
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


def _actor_tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(actors, links, entities) with the normalised form as value, which does not depend on order."""
    h = stored_hits(spark, sf)
    entities = resolve.entity_spans(h).withColumn("value", F.col("normalized"))
    return resolve.actors_from_handles(h), resolve.actor_entities(h), entities


@query("snk_batch_export", ACT + f"""
select a.actor_id, label as handle, 'unknown' as category, 'active' as status, {ISO.format('first_seen')} as first_seen, {ISO.format('last_seen')} as last_seen, count(*) as entity_count
from actors a join lk using (actor_id) group by all""")
def snk_batch_export(spark, sf):
    actors, links, _ = _actor_tables(spark, sf)
    return reports.actor_counts(actors, links, "active").orderBy("handle")


@query("snk_intel_export", ACT + f"""
select 'actor' as type, actor_id as id, label as handle_or_value, 'unknown' as category_or_kind, 'active' as status, '' as confidence, {ISO.format('first_seen')} as first_seen, {ISO.format('last_seen')} as last_seen from actors
union all select 'entity', entity_id, normalized, kind, '', '', '', '' from entities""")
def snk_intel_export(spark, sf):
    actors, _, entities = _actor_tables(spark, sf)
    return reports.intel_package(actors, entities)


@query("snk_dossier_flat", ACT + f"""
, c as (select actor_id, count(*) as n from lk group by 1)
select actor_id, 'handle' as field, label as value from actors union all select actor_id, 'category', 'unknown' from actors union all select actor_id, 'status', 'active' from actors
union all select actor_id, 'first_seen', {ISO.format('first_seen')} from actors union all select actor_id, 'last_seen', {ISO.format('last_seen')} from actors
union all select actor_id, 'entity_count', cast(n as varchar) from c union all select actor_id, 'entity:' || kind, normalized from lk""")
def snk_dossier_flat(spark, sf):
    return reports.dossier_fields(*_actor_tables(spark, sf))


def _json_list(kind: str) -> str:
    item = "'{\"entity_id\":\"' || entity_id || '\",\"value\":\"' || normalized || '\"}'"
    return f"'[' || coalesce(string_agg({item}, ',' order by normalized) filter (kind = '{kind}'), '') || ']'"


GROUPS_SQL = " || ',' || ".join(f"'\"{g}\":' || {_json_list(k)}" for g, k in reports.IDENTITY_GROUPS.items())


@query("snk_dossier_json", ACT + f"""
, j as (select a.actor_id, '{{"report_type":"actor_dossier","classification":"RESTRICTED","actor":{{"actor_id":"' || a.actor_id || '","label":"' || label || '","category":"unknown","status":"active","first_seen":"'
  || {ISO.format('first_seen')} || '","last_seen":"' || {ISO.format('last_seen')} || '"}},"known_identities":{{' || {GROUPS_SQL} || '}}}}' as report_json from actors a join lk using (actor_id) group by a.actor_id, label, first_seen, last_seen)
select actor_id, cast(0 as int) as part, report_json, 'sha256:' || sha256(report_json) as export_hash from j""")
def snk_dossier_json(spark, sf):
    return reports.dossiers(*_actor_tables(spark, sf))


@query("snk_stix", ACT + """
select actor_id, 'threat-actor--' || actor_id as object_id, 'threat-actor' as type, label as name, cast(null as varchar) as currency from actors
union all select actor_id, t || '--' || entity_id, t, normalized, case when kind <> 'wallet' then null when regexp_matches(normalized, '^([13]|(?i)bc1)') then 'BTC'
  when starts_with(normalized, '0x') then 'ETH' when starts_with(normalized, 'T') then 'TRON' else 'XMR' end from (select *, case kind when 'email' then 'email-addr' when 'wallet' then 'x-cryptocurrency-wallet' when 'onion' then 'domain-name' when 'ip' then 'ipv4-addr' end as t from lk) x where t is not null""")
def snk_stix(spark, sf):
    objects = reports.stix_objects(*_actor_tables(spark, sf))
    field = lambda n: F.get_json_object("object_json", f"$.{n}")
    name = F.coalesce(field("name"), field("value"), field("address"))
    return objects.select("actor_id", "object_id", field("type").alias("type"), name.alias("name"), field("currency").alias("currency"))


@query("snk_stix_bundle", ACT + """
select actor_id, 1 + count(*) filter (kind in ('email', 'wallet', 'onion', 'ip')) as n_objects from lk group by actor_id""")
def snk_stix_bundle(spark, sf):
    bundles = reports.stix_bundles(reports.stix_objects(*_actor_tables(spark, sf)))
    return bundles.groupBy("actor_id").agg(
        F.sum(F.json_array_length(F.get_json_object("bundle_json", "$.objects"))).alias("n_objects")
    )


def _as_csv(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as CSV and read back."""
    path = scratch_path(df.sparkSession, f"csv-{label}")
    sinks.csv(df, path)
    return sinks.read_csv(df.sparkSession, df.schema, path)


@query("snk_csv_evidence", EVID + """
select evidence_id, 'document' as type, cast(null as varchar) as value, cast(null as varchar) as source_id, 'C' as reliability, cast(3 as bigint) as credibility, content_hash,
  collected_at, cast(n // 100 as varchar) as merkle_batch_id from num""")
def snk_csv_evidence(spark, sf):
    a = provenance.assign_batches(evidence(spark, sf)).withColumns({
        "type": F.lit("document"), "reliability": F.lit("C"), "credibility": F.lit(3).cast("long"), "merkle_batch_id": F.col("batch_no").cast("string"),
    })
    return _as_csv(reports.with_columns(a, reports.EVIDENCE_COLUMNS), "evidence")


@query("snk_csv_entities", HITS + f"""
select {ENTITY_UUID} as entity_id, kind, normalized, min(observed_at) as first_seen, max(observed_at) as last_seen from hits group by kind, normalized""")
def snk_csv_entities(spark, sf):
    # which spelling of an entity is kept as its value depends on the order of rows
    return _as_csv(reports.with_columns(resolve.entity_spans(hits(spark, sf)), reports.ENTITY_COLUMNS), "entities").drop("value")


@query("snk_csv_timeline", """
select ts as timestamp, event_type, 's' || user_id % 5 as source, 'u' || user_id as handle, cast(null as varchar) as market, event_type || ' ' || event_id as summary from events""")
def snk_csv_timeline(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("ts").alias("timestamp"), "event_type", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("handle"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("summary"), "value",
    )
    return _as_csv(reports.with_columns(ev, reports.TIMELINE_COLUMNS), "timeline")


# --- search ---------------------------------------------------------------------------
TOK = r"""posts0 as (select doc_id as post_id, regexp_extract_all(lower(text), '[\pL\pN_]+') as t from documents)"""


def _search_sql(terms: list[str]) -> str:
    tf = " + ".join(f"len(list_filter(t, lambda x: x = '{w}'))" for w in terms)
    every = " and ".join(f"list_contains(t, '{w}')" for w in terms)
    return f"""with {TOK} select post_id, round(({tf}) / (1.0 + ln(len(t))), 6) as rank from posts0 where {every} order by ({tf}) / (1.0 + ln(len(t))) desc, post_id limit 50"""


def _hits_sql(terms: list[str]) -> str:
    """The best posts with handle, market and snippet; a text is rebuilt from its words and gaps, with the hits marked."""
    listed = ", ".join(f"'{w}'" for w in terms)
    tf = f"len(list_filter(t, lambda x: x in ({listed})))"
    every = " and ".join(f"list_contains(t, '{w}')" for w in terms)
    word = r"[\pL\pN_]+"
    return ctes("posts") + rf""", k as (select post_id, handle, market, text, regexp_extract_all(lower(text), '{word}') as t from posts),
r as (select *, {tf} / (1.0 + ln(len(t))) as rank from k where {every} order by rank desc, post_id limit 50),
g as (select *, regexp_split_to_array(lower(text), '{word}') as gaps, list_position(list_transform(t, lambda x: x in ({listed})), true) as i from r),
p as (select *, 1 + list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:i - 1], lambda x: length(x))), 0) as first from g),
c as (select *, substring(text, cast(greatest(first - 80, 1) as bigint), 160) as cut from p),
w as (select *, list_zip(regexp_split_to_array(cut, '{word}'), regexp_extract_all(cut, '{word}')) as parts from c)
select post_id, handle, market, round(rank, 6) as rank,
  array_to_string(list_transform(parts, lambda x: x[1] || case when lower(x[2]) in ({listed}) then '<b>' || x[2] || '</b>' else coalesce(x[2], '') end), '') as snippet from w"""


def _hit_rows(found: DataFrame) -> DataFrame:
    return found.select("post_id", "handle", "market", F.round("rank", 6).alias("rank"), "snippet")


@query("txt_search", _hits_sql(["thble", "attion"]))
def txt_search(spark, sf):
    return _hit_rows(search.posts(derived(spark, sf, "posts"), "attion THBLE"))


@query("txt_search_blocks", _hits_sql(["ering", "thing"]))
def txt_search_blocks(spark, sf):
    """The same from blocks of postings, most of which are never read."""
    posts = derived(spark, sf, "posts")
    index = cut_lineage(search.block_index(posts.select("post_id", "text"), block=16), "blocks")
    return _hit_rows(search.best_posts(index, posts, "thing ering", seeds=3)[0])


@query("txt_search_index", _search_sql(["de", "la", "que"]))
def txt_search_index(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), "text")
    return search.search_index(search.token_index(docs), "que la de").select("post_id", F.round("rank", 6).alias("rank"))


@query("txt_index", f"with {TOK}, w as (select post_id, unnest(t) as token from posts0) select token, count(distinct post_id) as df, count(*) as cf from w group by token")
def txt_index(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), "text")
    return search.token_index(docs).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("gr_search", ctes("vertices") + r"""
, t as (select id, label, regexp_extract_all(lower(concat_ws(' ', value, label, id)), '[\pL\pN_]+') as t from vertices where label in ('Actor', 'Handle', 'Wallet', 'PGPKey', 'Email', 'Onion', 'Domain'))
select id, label, round((len(list_filter(t, lambda x: x = 'red')) + len(list_filter(t, lambda x: x = 'ring'))) / (1.0 + ln(len(t))), 6) as score from t
where list_contains(t, 'red') or list_contains(t, 'ring') order by (len(list_filter(t, lambda x: x = 'red')) + len(list_filter(t, lambda x: x = 'ring'))) / (1.0 + ln(len(t))) desc, id limit 20""")
def gr_search(spark, sf):
    labels = ["Actor", "Handle", "Wallet", "PGPKey", "Email", "Onion", "Domain"]
    out = search.nodes(derived(spark, sf, "vertices"), "red ring", labels, ["value", "label", "id"])
    return out.select("id", "label", F.round("score", 6).alias("score"))


