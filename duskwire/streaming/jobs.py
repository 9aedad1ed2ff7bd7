"""Streaming forms of the pipeline: stateless expressions, windows and joins."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, evidence_id
from ..functions.identifiers import extract_all
from ..operators.gates import content_allowed, redact, watch_match
from ..sources.feeds import has_clearnet, has_onion


def ingest(events: DataFrame, text: str = "text", author: str | None = "handle") -> DataFrame:
    """Gate, redact, hash and extract. Every step is an expression on the row.

    Blocked rows keep their ids and the decision, and lose their text.
    """
    gated = events.withColumn("decision", F.when(content_allowed(F.col(text)), "allow").otherwise("block"))
    gated = gated.withColumn(text, F.when(F.col("decision") == "allow", F.col(text)))
    out = redact(gated, text)
    out = out.withColumn("content_hash", content_hash(F.col(text)))
    out = out.withColumn("evidence_id", evidence_id(F.col("content_hash"), F.col("source_id")))
    return out.withColumn("hits", extract_all(F.col(text), F.col(author) if author else None))


def hits_of(ingested: DataFrame) -> DataFrame:
    # the outer form keeps Spark from repeating the extraction in a filter on its result
    rows = ingested.filter("decision = 'allow'").select(
        "event_id", "source_id", "observed_at", F.posexplode_outer("hits").alias("hit_pos", "hit")
    )
    return rows.filter("hit_pos is not null").select("event_id", "source_id", "observed_at", "hit_pos", "hit.*")


def dedup(events: DataFrame, key: str = "content_hash", at: str = "observed_at", delay: str = "10 minutes") -> DataFrame:
    """First event per content hash while the watermark remembers it."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def rate(
    events: DataFrame, key: str = "source_id", at: str = "observed_at",
    width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes",
) -> DataFrame:
    """Events per source and window; windows close with the watermark."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return (
        events.withWatermark(at, delay).groupBy(window.alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")
    )


def sessions(
    events: DataFrame, key: str = "actor_id", at: str = "observed_at", gap: str = "30 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Activity sessions per actor, split by gaps."""
    return (
        events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), key, "n")
    )


def spans(hits: DataFrame) -> DataFrame:
    """First and last sighting per entity, in update mode."""
    return hits.groupBy("kind", "normalized").agg(
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen")
    )


def certificates(certs: DataFrame, domains: str = "all_domains") -> DataFrame:
    """Certificates with a watched name, and whether they tie an onion to a clearnet name."""
    names = F.col(domains)
    return (
        certs.withColumn("matched_pattern", watch_match(names))
        .filter("matched_pattern is not null")
        .withColumn("has_onion", has_onion(names))
        .withColumn("has_clearnet", has_clearnet(names))
        .withColumn("is_san_leak", F.col("has_onion") & F.col("has_clearnet"))
    )


QUEUES = ("btc", "eth", "onion", "ip")


def lookup_requests(ingested: DataFrame, caps: Mapping[str, int] | None = None) -> DataFrame:
    """(event_id, queue, value): lookups that the hits of an event ask for, in hit order.

    ``caps``: for a queue named there, so many lookups of an event at most.
    """

    def of(kind: str, currency: str | None = None) -> Column:
        kept = F.filter(
            "hits",
            lambda h: (h["kind"] == kind) & ((h["metadata"]["currency"] == currency) if currency else F.lit(True)),
        )
        return F.transform(kept, lambda h: h["normalized"])

    values = (of("wallet", "BTC"), of("wallet", "ETH"), of("onion"), of("ip"))

    def requests(name: str, found: Column) -> Column:
        chosen = F.slice(found, 1, caps[name]) if caps and name in caps else found
        return F.transform(chosen, lambda v: F.struct(F.lit(name).alias("queue"), v.alias("value")))

    wanted = F.concat(*[requests(name, found) for name, found in zip(QUEUES, values)])
    return ingested.filter("decision = 'allow'").select(
        "event_id", F.explode_outer(wanted).alias("q")
    ).filter("q is not null").select("event_id", "q.*")
