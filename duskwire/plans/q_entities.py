"""Entities, observations, infrastructure, skew, wallet and listing joins."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage, scratch_path
from ..operators import clocks, infra, listings, metrics, overlap, resolve, wallets
from ..operators.ordering import newest_per_key
from ..sources.entity_table import EntityTable
from .inputs import ctes, derived, table
from .q_extract import all_hits_sql
from .q_feeds import SDN_CTES, sanction_list
from .q_text import uuid5_sql
from .registry import query

HITS = ctes("posts") + all_hits_sql() + """
, hits as (select distinct cast(post_id as varchar) as event_id, kind, normalized, observed_at, source_id from all_hits join posts using (post_id))"""
ENTITY_UUID = uuid5_sql("'entity|' || kind || '|' || normalized")


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """First hit per identity of every post."""
    return resolve.extract_hits(derived(spark, sf, "posts"))


def stored_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a written table, for queries that use the hits more than once."""
    return cut_lineage(hits(spark, sf), "hits")


@query("agg_entity_span", HITS + """
select kind, normalized, min(observed_at) as first_seen, max(observed_at) as last_seen, count(*) as sightings from hits group by kind, normalized""")
def agg_entity_span(spark, sf):
    return resolve.entity_spans(hits(spark, sf)).select("kind", "normalized", "first_seen", "last_seen", "sightings")


@query("agg_entity_kind", HITS + """
, e as (select distinct kind, normalized from hits) select coalesce(kind, 'total') as kind, count(*) as n from e group by rollup (kind)""")
def agg_entity_kind(spark, sf):
    spans = resolve.entity_spans(hits(spark, sf))
    return metrics.kinds(spans).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


@query("jn_observation", HITS + f"""
select event_id, {ENTITY_UUID} as entity_id, 'extracted' as role, observed_at from hits""")
def jn_observation(spark, sf):
    return resolve.observations(hits(spark, sf)).select("event_id", "entity_id", "role", "observed_at")


@query("jn_observation_table", HITS + f"""
select event_id, {ENTITY_UUID} as entity_id, 'extracted' as role, observed_at from hits""")
def jn_observation_table(spark, sf):
    """The same against an entity table, as an equi join on the identity."""
    h = stored_hits(spark, sf)
    return resolve.observations(h, resolve.entity_spans(h)).select("event_id", "entity_id", "role", "observed_at")


@query("win_first_hit", HITS + """
select event_id, count(*) as identities, count(distinct kind) as kinds from hits group by event_id""")
def win_first_hit(spark, sf):
    return hits(spark, sf).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("identities"), F.count_distinct("kind").alias("kinds")
    )


CUT = "2024-01-22 00:00:00"


@query("snk_entities", HITS + f"""
select kind, normalized, min(observed_at) as first_seen, max(observed_at) as last_seen, {ENTITY_UUID} as entity_id, true as repeated_batch_changed_nothing
  from hits group by kind, normalized""")
def snk_entities(spark, sf):
    """Three batches of posts by time, merged into a stored table one after the other; the second one comes twice."""
    h = stored_hits(spark, sf)
    stored = EntityTable(spark, scratch_path(spark, "entities"), buckets=16)
    cuts = ["1970-01-01", "2024-01-12", CUT, "9999-01-01"]
    day = lambda d: F.lit(d).cast("timestamp")
    parts = [h.filter((F.col("observed_at") >= day(a)) & (F.col("observed_at") < day(b))) for a, b in zip(cuts, cuts[1:])]
    same = True
    for number, part in enumerate(parts):
        spans = cut_lineage(resolve.entity_spans(part), "spans")
        stored.upsert(spans, number)
        if number == 1:
            same = stored.upsert(spans, number) == [] and len(stored.versions()) == 2
    return stored.read().select("kind", "normalized", "first_seen", "last_seen", "entity_id", F.lit(same).alias("repeated_batch_changed_nothing"))


@query("agg_cooccur", HITS + f"""
, e as (select distinct event_id, {ENTITY_UUID} as id, kind from hits)
select a.id as item_a, b.id as item_b, count(distinct a.event_id) as cooccurrences, least(1.0::double, count(distinct a.event_id) / 10.0::double) as strength
from e a join e b on a.event_id = b.event_id and a.id < b.id and a.kind <> b.kind
group by a.id, b.id having count(distinct a.event_id) >= 3 order by cooccurrences desc, item_a, item_b limit 100""")
def agg_cooccur(spark, sf):
    rel = hits(spark, sf).select("event_id", resolve.entity_id(F.col("kind"), F.col("normalized")).alias("id"), "kind")
    pairs = overlap.shared_groups(rel, "id", "event_id", 3, different="kind")
    top = pairs.orderBy(F.desc("shared"), "item_a", "item_b").limit(100)
    return top.select(
        "item_a", "item_b", F.col("shared").alias("cooccurrences"), F.least(F.lit(1.0), F.col("shared") / 10.0).alias("strength")
    )


@query("agg_merge", """
with u as (select distinct o_custkey as a, l_partkey as e from lineitem join orders on l_orderkey = o_orderkey)
select x.a as item_a, y.a as item_b, count(*) as shared_count, case when count(*) >= 3 then 'merge' else 'review' end as recommendation
from u x join u y on x.e = y.e and x.a < y.a group by x.a, y.a having count(*) >= 2""")
def agg_merge(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    uses = li.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = overlap.shared_groups(uses.select("o_custkey", "l_partkey"), "o_custkey", "l_partkey", 2)
    return pairs.select(
        "item_a", "item_b", F.col("shared").alias("shared_count"),
        F.when(F.col("shared") >= 3, "merge").otherwise("review").alias("recommendation"),
    )


@query("gr_build", HITS + f"""
, v as (select distinct {ENTITY_UUID} as id, case kind when 'pgp' then 'PGPKey' when 'wallet' then 'Wallet' when 'email' then 'Email' when 'domain' then 'Domain' when 'onion' then 'Onion'
  when 'contact_id' then 'ContactID' when 'handle' then 'Handle' when 'ip' then 'IP' end as label, normalized, case when kind = 'pgp' then normalized end as fingerprint from hits)
select * from v""")
def gr_build(spark, sf):
    v = resolve.vertices(resolve.entity_spans(hits(spark, sf)))
    return v.select("id", "label", F.col("props")["normalized"].alias("normalized"), F.try_element_at("props", F.lit("fingerprint")).alias("fingerprint"))


@query("gr_actor_from_handle", HITS + f"""
select {uuid5_sql("'actor|' || normalized")} as actor_id, normalized as label, min(observed_at) as first_seen, max(observed_at) as last_seen from hits where kind = 'handle' group by normalized""")
def gr_actor_from_handle(spark, sf):
    return resolve.actors_from_handles(hits(spark, sf)).select("actor_id", "label", "first_seen", "last_seen")


@query("jn_actor_entities", HITS + f"""
, act as (select event_id, {uuid5_sql("'actor|' || normalized")} as actor_id from hits where kind = 'handle'),
l as (select distinct actor_id, kind, normalized from act join hits using (event_id))
select actor_id, {ENTITY_UUID} as entity_id, kind, normalized from l""")
def jn_actor_entities(spark, sf):
    h = stored_hits(spark, sf)
    links = resolve.actor_entities(h)
    return listings.entities_of_actors(links, resolve.entity_spans(h)).select("actor_id", "entity_id", "kind", "normalized")


@query("gr_uses", HITS + f"""
, act as (select event_id, {uuid5_sql("'actor|' || normalized")} as src from hits where kind = 'handle')
select distinct src, {ENTITY_UUID} as dst, 'USES' as type from act join hits using (event_id)""")
def gr_uses(spark, sf):
    """The edges from actors to the entities of their events."""
    return resolve.edges_uses(resolve.actor_entities(stored_hits(spark, sf)))


# --- persona links, evidence, provenance ----------------------------------------
LINKS_SQL = "select o_orderkey as link_id, o_custkey as actor_a, o_custkey + 1 + o_orderkey % 5 as actor_b, round(o_totalprice / 5000.0, 1) as score from orders"


def links(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("link_id"), F.col("o_custkey").alias("actor_a"),
        (F.col("o_custkey") + 1 + F.col("o_orderkey") % 5).alias("actor_b"), F.round(F.col("o_totalprice") / 5000.0, 1).alias("score"),
    )


@query("jn_actor_links", f"""
with l as ({LINKS_SQL}) select actor_a as actor_id, actor_b as other_id, link_id, score from l union all select actor_b, actor_a, link_id, score from l""")
def jn_actor_links(spark, sf):
    return listings.undirected_links(links(spark, sf)).select("actor_id", "other_id", "link_id", "score")


LINE_TYPE = "case l_linenumber when 1 then 'pgp_fingerprint' when 2 then 'contact_id' when 3 then 'favicon' when 4 then 'stylometry' else 'odd_' || l_linenumber end"


@query("jn_link_evidence", f"""
with l as ({LINKS_SQL}), e as (select l_orderkey as link_id, {LINE_TYPE} as t, l_linenumber from lineitem)
select l.link_id, score, count(t) as n_evidence, coalesce(array_to_string(list_sort(list(case t when 'pgp_fingerprint' then 'Same PGP fingerprint' when 'contact_id' then 'Same contact identifier'
  when 'favicon' then 'Same favicon hash' when 'stylometry' then 'Similar writing profile' else 'Evidence: ' || t end) filter (t is not null)), '; '), '') as why
from l left join e on l.link_id = e.link_id group by l.link_id, score""")
def jn_link_evidence(spark, sf):
    ev = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("link_id"), F.expr(LINE_TYPE).alias("evidence_type"), F.col("l_discount").alias("llr"),
        F.lit("C").alias("reliability"), F.lit(3).alias("credibility"),
    )
    out = listings.link_evidence(links(spark, sf), ev)
    return out.select(
        "link_id", "score", F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("n_evidence"),
        F.array_join(F.array_sort("why"), "; ").alias("why"),
    )


# --- sanctions, exit lists, watch lists ---------------------------------------
ADDR = "(select c_custkey, '1' || translate(substr(sha256('btc' || cast(c_custkey as varchar)), 1, 33), '0', 'x') as address from customer)"


def _addresses(spark, sf) -> DataFrame:
    tag = F.sha2(F.concat(F.lit("btc"), F.col("c_custkey").cast("string")), 256)
    return table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("1"), F.translate(F.substring(tag, 1, 33), "0", "x")).alias("address")
    )


@query("jn_sanctions", f"with {SDN_CTES} select c_custkey, address from {ADDR} a where lower(address) in (select lower(address) from listed)")
def jn_sanctions(spark, sf):
    return wallets.sanctioned(_addresses(spark, sf), sanction_list(spark, sf))


@query("jn_sanctions_summary", f"""with {SDN_CTES} select count(*) as checked, count(*) filter (lower(address) in (select lower(address) from listed)) as flagged from {ADDR} a""")
def jn_sanctions_summary(spark, sf):
    return wallets.sanction_summary(_addresses(spark, sf), sanction_list(spark, sf))


@query("jn_exit_noise", """
select event_id, '10.1.' || user_id || '.0' as ip from events where user_id not in (select s_suppkey from supplier)""")
def jn_exit_noise(spark, sf):
    def ip(key: str):
        return F.concat(F.lit("10.1."), F.col(key).cast("string"), F.lit(".0")).alias("ip")

    seen = table(spark, sf, "events").select("event_id", ip("user_id"))
    return infra.without_exits(seen, table(spark, sf, "supplier").select(ip("s_suppkey")))


WATCH_SQL = f"""
, w as (select 'item' || item_id as item_id, {uuid5_sql("'entity|handle|user' || item_id")} as entity_id from benchmark)
select h.event_id, w.item_id, w.entity_id, 'watchlist_hit' as alert_type from (select event_id, {ENTITY_UUID} as entity_id from hits) h join w using (entity_id)"""


def watchlist(spark, sf) -> DataFrame:
    user = F.concat(F.lit("user"), F.col("item_id").cast("string"))
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("item_id"),
        resolve.entity_id(F.lit("handle"), user).alias("entity_id"), F.lit("analyst").alias("created_by"),
    )


@query("jn_watchlist", HITS + WATCH_SQL)
def jn_watchlist(spark, sf):
    obs = resolve.observations(hits(spark, sf))
    return listings.watch_hits(obs, watchlist(spark, sf)).select("event_id", "item_id", "entity_id", "alert_type")


@query("al_new_actor", HITS + f"""
select normalized as label, min(observed_at) as first_seen, 'new_actor' as alert_type from hits where kind = 'handle' group by normalized having min(observed_at) >= timestamp '{CUT}'""")
def al_new_actor(spark, sf):
    spans = resolve.actors_from_handles(hits(spark, sf))
    return listings.new_actors(spans, F.lit(CUT).cast("timestamp")).select("label", "first_seen", "alert_type")


@query("jn_sslbl", """
with onions as (select s_suppkey, substr(sha256('crt' || cast(s_suppkey as varchar)), 1, 40) as fp from supplier),
l as (select substr(sha256('crt' || cast(c_custkey as varchar)), 1, 40) as sha1, c_name as subject, case when c_custkey % 2 = 0 then 'C&C' else 'spam' end as reason from customer)
select s_suppkey, fp, subject, reason from onions join l on fp = sha1""")
def jn_sslbl(spark, sf):
    def fp(key: str):
        return F.substring(F.sha2(F.concat(F.lit("crt"), F.col(key).cast("string")), 256), 1, 40)

    certs = table(spark, sf, "supplier").select("s_suppkey", fp("s_suppkey").alias("fp"))
    listed = table(spark, sf, "customer").select(
        fp("c_custkey").alias("fp"), F.col("c_name").alias("subject"), F.when(F.col("c_custkey") % 2 == 0, "C&C").otherwise("spam").alias("reason")
    )
    return certs.join(listed, "fp").select("s_suppkey", "fp", "subject", "reason")


# --- infrastructure detectors -----------------------------------------------------
SIDES = ctes("onions", "hosts")
COLS = "select '{d}' as detector_id, address as onion_address, {m} as clearnet_match, '{k}' as kind, {c}::double as confidence"
D_SQL = {
    "d1_cert_san": COLS.format(d="D1", m="lower(host)", k="cert_san", c="0.95") + """ from (select address, lower(unnest(tls_cert_sans)) as san from onions) o join (select distinct lower(host) as host from hosts) h on san = host
union all """ + COLS.format(d="D1", m="host", k="cert_san", c="0.9") + """ from (select address, substr(san, 3) as base from (select address, lower(unnest(tls_cert_sans)) as san from onions) x where starts_with(san, '*.')) o
 join (select distinct lower(host) as host from hosts) h on ends_with(host, base)""",
    "d2_favicon": COLS.format(d="D2", m="host", k="favicon", c="0.7") + " from onions o join hosts h on o.favicon_hash = h.favicon_hash",
    "d3_banner": COLS.format(d="D3", m="host", k="banner", c="0.45") + """ from onions o join hosts h on trim(lower(o.server_banner)) = trim(lower(h.server_banner))
 where trim(lower(o.server_banner)) not in ('nginx','apache','cloudflare','microsoft-iis','nginx/1.18.0','apache/2.4.41')""",
    "d4_status_leak": COLS.format(d="D4", m="host", k="server_status", c="0.85") + r""" from (
 select address, lower(unnest(list_concat(list_concat(regexp_extract_all(status_page_text, '(?i)ServerName:\s*(\S+)', 1),
   regexp_extract_all(status_page_text, '(?i)hostname["'']?\s*[:=]\s*["'']?(\S+)', 1)), regexp_extract_all(status_page_text, 'server_name\s+(\S+);', 1)))) as leak from onions) o
 join (select distinct lower(host) as host from hosts) h on leak = host""",
    "d5_ssh": COLS.format(d="D5", m="host", k="ssh_key", c="0.98") + " from onions o join hosts h on o.ssh_host_key = h.ssh_host_key",
    "d6_header_order": COLS.format(d="D6", m="host", k="header_order", c="0.4") + """ from onions o join hosts h on lower(array_to_string(o.header_order, ',')) = lower(array_to_string(h.header_order, ','))
 where len(o.header_order) >= 4""",
    "d7_error_page": COLS.format(d="D7", m="host", k="error_page", c="0.55") + " from onions o join hosts h on o.error_page_hash = h.error_page_hash",
}


def _detector(name: str):
    @query(name, SIDES + D_SQL[name])
    def run(spark, sf):
        return infra.findings(derived(spark, sf, "onions"), derived(spark, sf, "hosts"), [name[:2].upper()]).drop("evidence")

    return run


for _name in D_SQL:
    _detector(_name)


@query("infra_groups", SIDES + ", f as (" + "\nunion all\n".join(D_SQL.values()) + """),
p as (select detector_id, confidence, onion_address, count(distinct clearnet_match) as n from f group by 1, 2, 3)
select detector_id, confidence, count(*) as onions, cast(sum(n) as bigint) as pairs from p group by 1, 2""")
def infra_groups(spark, sf):
    """Findings as values with members, counted back into onions and pairs of each detector and form."""
    groups = infra.shared_values(derived(spark, sf, "onions"), derived(spark, sf, "hosts"))
    confidence = F.create_map(*[F.lit(x) for d, w, _, c in infra.FORMS for x in (f"{d} {w}", c)])
    onions = groups.filter("side = 'onion'").select("detector_id", confidence[F.concat_ws(" ", "detector_id", "what")].alias("confidence"), "member", "n_hosts")
    return onions.groupBy("detector_id", "confidence").agg(F.count_distinct("member").alias("onions"), F.sum("n_hosts").alias("pairs"))


@query("infra_all", SIDES + "\nunion all\n".join(D_SQL.values()))
def infra_all(spark, sf):
    found = infra.all_findings(derived(spark, sf, "onions"), derived(spark, sf, "hosts"))
    return infra.ranked_findings(found).drop("evidence")


@query("al_infra", SIDES + "select onion_address, clearnet_match, kind, confidence, 'infra_leak' as alert_type from (" + "\nunion all\n".join(D_SQL.values()) + ") t where confidence >= 0.7")
def al_infra(spark, sf):
    found = infra.all_findings(derived(spark, sf, "onions"), derived(spark, sf, "hosts"))
    return listings.infra_leaks(found).select("onion_address", "clearnet_match", "kind", "confidence", "alert_type")




@query("flt_findings", SIDES + """
select onion_entity, matched_clearnet, kind, confidence, detected_at from (select onion_address as onion_entity, clearnet_match as matched_clearnet, kind, confidence, detector_id,
  make_timestamp(cast((1704067200 + confidence * 100000) * 1000000 as bigint)) as detected_at from (""" + "\nunion all\n".join(D_SQL.values()) + """) t) u
order by detected_at desc, onion_entity || detector_id || matched_clearnet limit 50""")
def flt_findings(spark, sf):
    found = infra.all_findings(derived(spark, sf, "onions"), derived(spark, sf, "hosts"))
    rows = found.select(
        F.concat("onion_address", "detector_id", "clearnet_match").alias("finding_id"), F.col("onion_address").alias("onion_entity"),
        F.col("clearnet_match").alias("matched_clearnet"), "kind", "confidence",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("confidence") * 100_000).alias("detected_at"),
    )
    return listings.findings(rows).drop("finding_id")


@query("favicon_groups", """
with n as (select 'n' || c_custkey as id, md5('fav' || cast(c_custkey // 5 as varchar)) as favicon_hash from customer)
select favicon_hash, id, members from (select *, count(*) over (partition by favicon_hash) as members from n) t where members > 1""")
def favicon_groups(spark, sf):
    """The linear form of ``jn_favicon_graph``: each favicon with its nodes."""
    c = table(spark, sf, "customer")
    group = F.floor(F.col("c_custkey") / 5).cast("string")
    return infra.favicon_groups(c.select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("id"), F.md5(F.concat(F.lit("fav"), group)).alias("favicon_hash")))


@query("jn_favicon_graph", """
with n as (select 'n' || c_custkey as id, md5('fav' || cast(c_custkey // 5 as varchar)) as h from customer),
k as (select 'n' || c_custkey as a, 'n' || (c_custkey + 1) as b from customer where c_custkey % 3 = 0)
select x.id as src, y.id as dst, x.h as favicon_hash from n x join n y on x.h = y.h and x.id < y.id
where not exists (select 1 from k where (a = x.id and b = y.id) or (a = y.id and b = x.id))""")
def jn_favicon_graph(spark, sf):
    c = table(spark, sf, "customer")
    node = F.concat(F.lit("n"), F.col("c_custkey").cast("string"))
    group = F.floor(F.col("c_custkey") / 5).cast("string")
    nodes = c.select(node.alias("id"), F.md5(F.concat(F.lit("fav"), group)).alias("favicon_hash"))
    known = c.filter(F.col("c_custkey") % 3 == 0).select(node.alias("src"), F.concat(F.lit("n"), (F.col("c_custkey") + 1).cast("string")).alias("dst"))
    return infra.shared_favicons(nodes, known).select("src", "dst", "favicon_hash")


# --- clock skew ---------------------------------------------------------------------
SKEW = ctes("probes") + """
, last as (select * from (select *, row_number() over (partition by url order by probed_at desc, clock_skew desc) as rn from probes) t where rn <= 20),
prof as (select url, count(*) as samples, avg(clock_skew) as a, max(clock_skew) - min(clock_skew) as s from last group by url having count(*) >= 3)"""


@query("win_last20", SKEW + "select url, probed_at, clock_skew from last")
def win_last20(spark, sf):
    return clocks.recent_samples(derived(spark, sf, "probes")).select("url", "probed_at", "clock_skew")


@query("agg_skew", SKEW + "select url, samples, round(a, 6) as avg_skew, round(s, 6) as spread from prof")
def agg_skew(spark, sf):
    return clocks.skew_profiles(derived(spark, sf, "probes")).select(
        "url", "samples", F.round("avg_skew", 6).alias("avg_skew"), F.round("spread", 6).alias("spread")
    )


PAIRS = SKEW + """
, pairs as (select x.url as url_a, y.url as url_b, x.samples as samples_a, y.samples as samples_b, abs(x.a - y.a) as d,
  least(1.0, (1.0 - abs(x.a - y.a) / 0.5) * (1.0 - least(x.s, 5.0) / 5.0) * (1.0 - least(y.s, 5.0) / 5.0) * least(least(x.samples, y.samples) / 10.0, 1.0)) as c
  from prof x join prof y on x.url < y.url and abs(x.a - y.a) <= 0.5)"""


@query("jn_skew", PAIRS + "select url_a, url_b, round(d, 3) as skew_diff, samples_a, samples_b, round(c, 4) as confidence from pairs")
def jn_skew(spark, sf):
    pairs = clocks.skew_pairs(clocks.skew_profiles(derived(spark, sf, "probes")))
    return pairs.select("url_a", "url_b", "skew_diff", "samples_a", "samples_b", "confidence")


@query("jn_new_graph_edge", PAIRS + """
, nodes as (select 'n' || min(event_id) as id, 'site' || user_id || '.example.com' as host from events group by user_id)
select a.id as src, b.id as dst, samples_a, samples_b from pairs join nodes a on a.host = regexp_extract(url_a, '//([^/]+)', 1) join nodes b on b.host = regexp_extract(url_b, '//([^/]+)', 1)""")
def jn_new_graph_edge(spark, sf):
    pairs = clocks.skew_pairs(clocks.skew_profiles(derived(spark, sf, "probes")))
    nodes = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("e")).select(
        F.concat(F.lit("n"), F.col("e").cast("string")).alias("id"),
        F.concat(F.lit("site"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("host"),
    )
    return clocks.skew_edges(pairs, nodes).select("src", "dst", "samples_a", "samples_b")


# --- lists -----------------------------------------------------------------------------
@query("flt_actors", ctes("actors") + """
select actor_id, label, category, status, first_seen, last_seen from actors where label ilike '%00001%' and category = 'BUILDING'
order by last_seen desc, actor_id limit 50""")
def flt_actors(spark, sf):
    out = listings.actors(derived(spark, sf, "actors"), query="00001", category="BUILDING")
    return out.select("actor_id", "label", "category", "status", "first_seen", "last_seen")


@query("flt_actors_min_score", ctes("actors") + f"""
, l as ({LINKS_SQL}), strong as (select cast(actor_a as varchar) as actor_id from l where score >= 95 union select cast(actor_b as varchar) from l where score >= 95)
select actor_id, label, last_seen from actors where status = 'active' and actor_id in (select actor_id from strong) order by last_seen desc, actor_id limit 50 offset 10""")
def flt_actors_min_score(spark, sf):
    l = links(spark, sf).withColumns({"actor_a": F.col("actor_a").cast("string"), "actor_b": F.col("actor_b").cast("string")})
    out = listings.actors(derived(spark, sf, "actors"), status="active", min_score=95.0, links=l, offset=10)
    return out.select("actor_id", "label", "last_seen")


@query("flt_alerts", """
select 'al' || event_id as alert_id, event_type as alert_type, value as score, ts as created_at from events where event_type = 'error' and value > 20
order by ts desc, 'al' || event_id limit 50""")
def flt_alerts(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("al"), F.col("event_id").cast("string")).alias("alert_id"), F.col("event_type").alias("alert_type"),
        F.col("value").alias("score"), F.when(F.col("value") > 20, "open").otherwise("resolved").alias("status"), F.col("ts").alias("created_at"),
    )
    return listings.alerts(rows, status="open", alert_type="error").drop("status")


@query("flt_timeline", ctes("posts") + f"""
select event_id, source_id, observed_at, language from posts where observed_at >= timestamp '2024-01-05 00:00:00' and observed_at <= timestamp '{CUT}'
order by observed_at desc, event_id limit 200""")
def flt_timeline(spark, sf):
    events = derived(spark, sf, "posts").select("event_id", "source_id", "observed_at", "language")
    return listings.timeline(events, F.lit("2024-01-05").cast("timestamp"), F.lit(CUT).cast("timestamp"))


@query("flt_timeline_entity", HITS + """
select event_id, observed_at from hits where kind = 'handle' and normalized = 'user7' order by observed_at desc, event_id limit 200""")
def flt_timeline_entity(spark, sf):
    obs = resolve.observations(hits(spark, sf))
    target = str(uuid.uuid5(uuid.NAMESPACE_URL, "entity|handle|user7"))
    events = derived(spark, sf, "posts").select("event_id", "observed_at")
    return listings.timeline(events, observations=obs, entity_id=target)


@query("top_k", "select event_id, ts, value from events order by ts desc, event_id limit 500")
def top_k(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(500).select("event_id", "ts", "value")


@query("page", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def page(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


@query("win_recent_n", """
select event_id, event_type, ts from (select *, row_number() over (partition by event_type order by ts desc, event_id) as rn from events) t where rn <= 50""")
def win_recent_n(spark, sf):
    return newest_per_key(table(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.col("event_id")], 50).select("event_id", "event_type", "ts")


@query("win_domain_cap", """
select page_id, domain from (select page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) as domain,
  row_number() over (partition by lower(regexp_extract(url, '://([^/:?#]+)', 1)) order by page_id) as rn from pages) t where rn <= 3""")
def win_domain_cap(spark, sf):
    from ..functions.pages import host

    visited = table(spark, sf, "pages").select("page_id", host(F.col("url")).alias("domain"))
    return newest_per_key(visited, ["domain"], [F.col("page_id")], 3)


# --- sets ------------------------------------------------------------------------------
@query("set_urls", """select 'http://' || regexp_extract(url, '://(.*)', 1) as url from pages union select 'http://m.' || regexp_extract(url, '://(.*)', 1) from pages""")
def set_urls(spark, sf):
    rest = F.regexp_extract("url", "://(.*)", 1)
    p = table(spark, sf, "pages")
    return p.select(F.concat(F.lit("http://"), rest).alias("url")).union(p.select(F.concat(F.lit("http://m."), rest))).distinct()


@query("set_new", "select distinct o_custkey from orders where o_custkey not in (select user_id from events)")
def set_new(spark, sf):
    seen = table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_custkey").distinct().join(seen.distinct(), "o_custkey", "left_anti")


@query("set_invalid", """
select distinct 'src' || s_suppkey as source from supplier where 'src' || s_suppkey not in (select source from documents)""")
def set_invalid(spark, sf):
    wanted = table(spark, sf, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"))
    return listings.unknown_sources(wanted, table(spark, sf, "documents")).distinct()


@query("set_dispatch", """
select g as "group", min_by(source, s_suppkey) as source from (select 'src' || s_suppkey as source, s_suppkey, 'g' || s_suppkey % 6 as g from supplier) t
where source in (select source from documents) group by g""")
def set_dispatch(spark, sf):
    wanted = table(spark, sf, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"), F.col("s_suppkey").alias("pos"))
    known = table(spark, sf, "documents").select("source").distinct().select(
        "source", F.concat(F.lit("g"), (F.substring("source", 4, 9).cast("int") % 6).cast("string")).alias("group")
    )
    return listings.dispatch_groups(wanted, known)


