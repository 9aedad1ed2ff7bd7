"""Streaming queries: file streams over the supplied tables, drained with an available-now trigger.

Reference SQL gives the batch result. Windows, sessions and batches that are open after the last
input are closed by an end mark.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..lineage import scratch_path
from ..operators import listings, resolve
from ..sources import readers
from ..sources.bus import FileBus
from ..streaming import jobs, stateful
from ..streaming.replay import replayed
from ..streaming.run import drain, drain_closed, drain_updates, fan_out, table_stream
from .inputs import BUILDERS, Spark, ctes, table, utc_schema
from .q_entities import ENTITY_UUID, HITS, watchlist
from .q_extract import all_hits_sql
from .q_text import SQL_SUMMARY, redaction_ctes, uuid5_sql
from .registry import query


def events_stream(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return table_stream(spark, path, utc_schema(spark, path))


def posts_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The derived posts as a stream: a projection of the documents."""
    body = BUILDERS["posts"](Spark).strip()
    columns = body[len("select "): body.rindex("from documents")]
    docs = events_stream(spark, sf, "documents")
    return spark.sql("select " + columns.replace("{", "{{").replace("}", "}}") + " from {documents}", documents=docs)


REDACTED = ctes("posts") + "," + redaction_ctes()


@query("st_ingest", REDACTED + f"""
select event_id, 'allow' as decision, 'sha256:' || sha256(text) as content_hash, {SQL_SUMMARY} as redactions from redacted""")
def st_ingest(spark, sf):
    out = jobs.ingest(posts_stream(spark, sf)).select("event_id", "decision", "content_hash", F.array_join("redactions", ",").alias("redactions"))
    return drain(out, "ingest")


PIPE = REDACTED + all_hits_sql("redacted") + """
, hits as (select distinct cast(post_id as varchar) as event_id, kind, normalized, observed_at, source_id from all_hits join posts using (post_id))"""


@query("st_span", PIPE + " select kind, normalized, min(observed_at) as first_seen, max(observed_at) as last_seen from hits group by 1, 2")
def st_span(spark, sf):
    hits = jobs.hits_of(jobs.ingest(posts_stream(spark, sf)))
    return drain_updates(jobs.spans(hits), "span", ["kind", "normalized"])


ROUTED = PIPE + """
, q as (select event_id, case when kind = 'ip' then 'ip' when kind = 'onion' then 'onion' when kind = 'wallet' and regexp_matches(normalized, '^(1|3|bc1)') then 'btc' when kind = 'wallet' and starts_with(normalized, '0x') then 'eth' end as queue, normalized as value from hits)
"""


@query("st_route", ROUTED + "select queue, count(*) as n, count(distinct value) as n_values from q where queue is not null group by queue")
def st_route(spark, sf):
    """Each batch goes to one table per queue."""
    ingested = jobs.ingest(posts_stream(spark, sf)).select("event_id", "decision", "hits")

    def of(queue: str):
        return lambda batch: jobs.lookup_requests(batch).filter(F.col("queue") == queue)

    tables = fan_out(ingested, "route", {q: of(q) for q in jobs.QUEUES})
    out = None
    for t in tables.values():
        out = t if out is None else out.unionByName(t)
    return out.groupBy("queue").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


@query("al_route", ROUTED + "select event_id, queue, value from q where queue is not null")
def al_route(spark, sf):
    """Lookup requests of all posts as a batch."""
    from .inputs import derived

    return jobs.lookup_requests(jobs.ingest(derived(spark, sf, "posts")))


@query("ingest_batch", PIPE + " select event_id, kind, normalized from hits")
def ingest_batch(spark, sf):
    """The main path as a batch: gate, redact, extract."""
    from .inputs import derived

    return jobs.hits_of(jobs.ingest(derived(spark, sf, "posts"))).select("event_id", "kind", "normalized")


DUP = "cast(event_id // 2 as varchar)"


@query("st_dedup", f"select distinct md5({DUP}) as content_hash from events")
def st_dedup(spark, sf):
    ev = events_stream(spark, sf).select(
        F.md5(F.floor(F.col("event_id") / 2).cast("string")).alias("content_hash"), F.col("ts").alias("observed_at")
    )
    return drain(jobs.dedup(ev, delay="1 day"), "dedup").select("content_hash")


BUS = """case event_id % 7 when 0 then '{broken' when 1 then '{"event_id": "' || event_id || '", "adapter_type": "replay"}'
  when 2 then '{"event_id": "' || event_id || '", "source_id": "s", "adapter_type": "pigeon", "mode": "live", "content_type": "json", "observed_at": "2024-01-01T00:00:00Z", "content_hash": "x"}'
  else '{"event_id": "' || event_id || '", "source_id": "s' || user_id % 5 || '", "adapter_type": "replay", "mode": "replay", "content_type": "text", "observed_at": "2024-01-01T00:00:00Z", "content_hash": "sha256:' || event_id || '"}' end"""


def _bus(spark, sf) -> DataFrame:
    return events_stream(spark, sf).select(F.expr(BUS).alias("value"))


@query("st_dlq", f"""
select case event_id % 7 when 0 then 'invalid json' when 1 then 'missing source_id' when 2 then 'unknown adapter_type' end as error, {BUS} as event_data from events where event_id % 7 < 3""")
def st_dlq(spark, sf):
    tables = fan_out(readers.decode_events(_bus(spark, sf)), "dlq", {
        "good": lambda b: readers.good_events(b).select("event_id", "source_id"),
        "bad": lambda b: readers.dead_letters(b, "events.raw").drop("failed_at"),
    })
    return tables["bad"].select("error", "event_data")


@query("src_bus", """
with e as (select event_id, 's' || user_id % 5 as key, event_id % 3 as batch from events where event_id % 7 >= 3),
g as (select 'archive' as group_id, 0 as least union all select 'alerts', 1)
select group_id, cast(event_id as varchar) as event_id, key as source_id, 'sha256:' || event_id as content_hash, true as gapless from e join g on batch >= least""")
def src_bus(spark, sf):
    """Three published batches and two groups: one from the beginning, one from the latest offset after the first batch.

    Each group restarts for every batch; ``gapless``: the offsets of each partition of the topic run from 0 on.
    """
    events = table(spark, sf, "events").select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("key"), F.expr(BUS).alias("value"))
    topic = FileBus(spark, scratch_path(spark, "bus"))
    taken = {}
    for batch in range(3):
        topic.publish(events.filter(F.col("event_id") % 3 == batch), "events.raw", batch)
        taken["archive"] = topic.consume("events.raw", "archive", from_beginning=True)
        taken["alerts"] = topic.consume("events.raw", "alerts")
    sizes = topic.log("events.raw").groupBy("partition").agg((F.max("offset") + 1 == F.count_distinct("offset")).alias("ok"), (F.count(F.lit(1)) == F.count_distinct("offset")).alias("once"))
    gapless = sizes.agg(F.min(F.col("ok") & F.col("once")).alias("gapless")).first()["gapless"]
    out = None
    for group, rows in taken.items():
        good = readers.good_events(readers.decode_events(rows)).select(
            F.lit(group).alias("group_id"), "event_id", "source_id", "content_hash", F.lit(gapless).alias("gapless")
        )
        out = good if out is None else out.unionByName(good)
    return out


@query("snk_events", "select 's' || user_id % 5 as key, count(*) as n, min(event_id) as first_id from events group by 1")
def snk_events(spark, sf):
    """Events keyed by source and appended to files, then read back."""
    ev = events_stream(spark, sf).select(
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("key"), "event_id", F.to_json(F.struct("*")).alias("value")
    )
    return drain(ev, "publish").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("snk_dlq", f"select 'events.raw' as original_topic, count(*) as n from events where event_id % 7 < 3")
def snk_dlq(spark, sf):
    bad = readers.dead_letters(readers.decode_events(_bus(spark, sf)), "events.raw").drop("failed_at")
    return drain(bad, "letters").groupBy("original_topic").agg(F.count(F.lit(1)).alias("n"))


def _rate_sql(width: str, slide: str) -> str:
    """Windows of ``width`` seconds every ``slide`` seconds."""
    return f"""
with e as (select event_type as source_id, epoch_us(ts) as us from events), k as (select unnest(range(0, {width} // {slide})) as k),
w as (select source_id, (us // ({slide} * 1000000) - k) * {slide} as s from e, k)
select make_timestamp(s * 1000000) as window_start, make_timestamp((s + {width}) * 1000000) as window_end, source_id, count(*) as n from w
group by s, source_id"""


def _typed(spark, sf) -> DataFrame:
    return events_stream(spark, sf).select(F.col("event_type").alias("source_id"), F.col("ts").alias("observed_at"))


@query("st_rate", _rate_sql("300", "300"))
def st_rate(spark, sf):
    return drain_closed(_typed(spark, sf), "observed_at", jobs.rate, "rate")


@query("st_rate_sliding", _rate_sql("3600", "300"))
def st_rate_sliding(spark, sf):
    return drain_closed(_typed(spark, sf), "observed_at", lambda e: jobs.rate(e, width="1 hour", slide="5 minutes"), "sliding")


@query("st_session", """
with e as (select user_id as actor_id, epoch_us(ts) as us from events),
g as (select *, case when us - lag(us) over (partition by actor_id order by us) < 1800 * 1000000 then 0 else 1 end as fresh from e),
s as (select *, sum(fresh) over (partition by actor_id order by us rows unbounded preceding) as n from g)
select make_timestamp(min(us)) as session_start, make_timestamp(max(us) + 1800 * 1000000) as session_end, actor_id, count(*) as n from s group by actor_id, s.n""")
def st_session(spark, sf):
    ev = events_stream(spark, sf).select(F.col("user_id").alias("actor_id"), F.col("ts").alias("observed_at"))
    return drain_closed(ev, "observed_at", jobs.sessions, "session")


@query("st_watchlist", HITS + f"""
, w as (select 'item' || item_id as item_id, {uuid5_sql("'entity|handle|user' || item_id")} as entity_id from benchmark)
select h.event_id, w.item_id, 'watchlist_hit' as alert_type from (select event_id, {ENTITY_UUID} as entity_id from hits where kind = 'handle') h join w using (entity_id)""")
def st_watchlist(spark, sf):
    """Handles of a stream of posts against the static watch list."""
    posts = posts_stream(spark, sf)
    seen = posts.select("event_id", resolve.entity_id(F.lit("handle"), F.lower("handle")).alias("entity_id"))
    return drain(listings.watch_hits(seen, watchlist(spark, sf)).select("event_id", "item_id", "alert_type"), "watch")


CERTS = """case when doc_id % 5 = 0 then 'LOCKBIT' || doc_id || '.net' when doc_id % 5 = 1 then 'a-leak' || doc_id || '.org' else 'x' || doc_id || '.io' end as d1,
  case when doc_id % 3 = 0 then 'abc' || doc_id || '.onion' else 'z.example.org' end as d2"""


@query("st_cert", f"""
with c as (select doc_id, {CERTS} from documents)
select doc_id, case when contains(lower(d1), 'lockbit') then 'lockbit' when contains(d1, 'leak') then 'leak' else '.onion' end as matched_pattern, d2 like '%.onion' as has_onion, true as has_clearnet, d2 like '%.onion' as is_san_leak
from c where contains(lower(d1), 'lockbit') or contains(d1, 'leak') or d2 like '%.onion'""")
def st_cert(spark, sf):
    d1, d2 = CERTS.split(" as d1,")
    docs = events_stream(spark, sf, "documents").select("doc_id", F.array(F.expr(d1), F.expr(d2.replace(" as d2", ""))).alias("all_domains"))
    out = jobs.certificates(docs).select("doc_id", "matched_pattern", "has_onion", "has_clearnet", "is_san_leak")
    return drain(out, "cert")


@query("st_skew", ctes("probes") + """
select url, probed_at, clock_skew from (select *, row_number() over (partition by url order by probed_at desc, clock_skew desc) as rn from probes) t where rn <= 20""")
def st_skew(spark, sf):
    ev = events_stream(spark, sf)
    probes = ev.select(
        F.concat(F.lit("http://site"), F.col("user_id").cast("string"), F.lit(".example.com/")).alias("url"), F.col("ts").alias("probed_at"),
        F.round(F.col("user_id") * F.lit(0.4).cast("decimal(2,1)") + F.col("value") * F.lit(0.001), 3).cast("double").alias("clock_skew"),
    )
    with stateful.rocksdb(spark):
        latest = drain_updates(stateful.last_samples(probes), "skew", ["url", "rn"])
    return latest.select("url", "probed_at", "clock_skew")


def _merkle_sql(size: int, seconds: int, shards: int) -> str:
    """Greedy batches of each shard by recursion, and their roots level by level."""
    levels = ""
    for i in range(size.bit_length()):
        levels += (
            f", l{i + 1} as (select shard, batch_no, p // 2 as p, case when (select count(*) from l{i} y where y.shard = x.shard and y.batch_no = x.batch_no) = 1 then any_value(h) "
            f"else sha256(string_agg(h, '' order by p) || case when count(*) = 1 then any_value(h) else '' end) end as h from l{i} x group by shard, batch_no, p // 2)"
        )
    return f"""with recursive ev as (select cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 2) as int) % {shards} as shard, cast(doc_id as varchar) as evidence_id,
  sha256(text) as h, 1704067200 + doc_id + 400 * (doc_id // 350) as sec from documents),
num as (select *, row_number() over (partition by shard order by sec, evidence_id) as n from ev),
e as (select i.shard, i.n, min(j.n) as nxt from num i join num j on j.shard = i.shard and j.n > i.n and j.n <= i.n + {size} and (j.n = i.n + {size} or j.sec >= i.sec + {seconds}) group by i.shard, i.n),
b as (select shard, cast(0 as bigint) as batch_no, cast(1 as bigint) as first from ev group by shard union all select b.shard, batch_no + 1, nxt from b join e on e.shard = b.shard and e.n = b.first),
c as (select b.shard, batch_no, first, coalesce(nxt, (select max(n) + 1 from num where num.shard = b.shard)) as nxt from b left join e on e.shard = b.shard and e.n = b.first),
l0 as (select c.shard, batch_no, n - first as p, h from c join num on num.shard = c.shard and n >= first and n < nxt){levels},
k as (select c.shard, batch_no, count(*) as leaf_count, min(sec) as began from c join num on num.shard = c.shard and n >= first and n < nxt group by 1, 2)
select k.shard, k.batch_no, leaf_count, make_timestamp(began * 1000000) as began, case when leaf_count = {size} then 'size' else 'time' end as closed_by, 'sha256:' || l.h as root_hash
from k join l{size.bit_length()} l on l.shard = k.shard and l.batch_no = k.batch_no"""


#: Merkle batches depend on the order of leaves alone, so slices land together up to so many rows.
TOGETHER = 50_000


@query("st_merkle", _merkle_sql(20, 150, 4))
def st_merkle(spark, sf):
    """Leaves replayed in slices of 500 seconds; batches of 20 leaves or 150 seconds in each of 4 shards."""
    leaves = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("evidence_id"), content_hash(F.col("text")).alias("content_hash"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") + 400 * F.floor(F.col("doc_id") / 350)).alias("at"),
    )
    with stateful.rocksdb(spark):
        return replayed(leaves, "at", 500, "merkle", lambda s: stateful.merkle_stream(s, 20, 150, 4), end=True, rows_together=TOGETHER)


#: Every 40th event is delivered half a day late.
DELIVERED = "case when event_id % 40 = 0 then 43200 else 0 end"


@query("st_late", f"""
with e as (select event_type as source_id, epoch_us(ts) // 1000 as ms, epoch(ts) + {DELIVERED} as delivered from events),
s as (select *, cast(floor((delivered - (select min(delivered) from e)) / 518400) as bigint) as slice, ms // 3600000 * 3600000 as w from e),
m as (select source_id, slice, max(ms) as latest from s group by 1, 2),
k as (select source_id, slice, max(latest) over (partition by source_id order by slice rows between unbounded preceding and 1 preceding) as mark from m)
select s.source_id, make_timestamp(w * 1000) as window_start, count(*) filter (not coalesce(w + 3600000 <= mark - 7200000, false)) as on_time,
  count(*) filter (coalesce(w + 3600000 <= mark - 7200000, false)) as late
from s join k on k.source_id = s.source_id and k.slice = s.slice group by 1, 2""")
def st_late(spark, sf):
    """Hourly counts per event type in slices of six days, two hours of patience: on time and late together are all rows."""
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("source_id"), F.col("event_id").cast("string").alias("row_id"), F.col("ts").alias("at"),
        (F.col("ts") + F.expr(f"make_dt_interval(0, 0, 0, {DELIVERED})")).alias("delivered"),
    )
    with stateful.rocksdb(spark):
        counts = replayed(ev, "delivered", 518_400, "late", lambda s: stateful.late_aware_windows(s, 3600, 7200), end=["delivered", "at"])
    return stateful.settled(counts)
