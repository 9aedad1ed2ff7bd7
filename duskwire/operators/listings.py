"""Analyst lists: filters, newest-first pages and detail joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def actors(
    df: DataFrame,
    query: str | None = None,
    category: str | None = None,
    status: str | None = None,
    min_score: float | None = None,
    links: DataFrame | None = None,
    offset: int = 0,
    limit: int = 50,
) -> DataFrame:
    """Actors, latest activity first. ``min_score`` asks for a link of at least that score."""
    out = df
    if query:
        out = out.filter(F.ilike("label", F.lit("%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")))
    if category:
        out = out.filter(F.col("category") == category)
    if status:
        out = out.filter(F.col("status") == status)
    if min_score is not None:
        if links is None:
            raise ValueError("min_score needs links")
        strong = undirected_links(links).filter(F.col("score") >= min_score).select("actor_id")
        out = out.join(strong, "actor_id", "left_semi")
    return out.orderBy(F.desc("last_seen"), "actor_id").offset(offset).limit(limit)


def alerts(df: DataFrame, status: str | None = None, alert_type: str | None = None, limit: int = 50) -> DataFrame:
    out = df.filter(F.col("status") == status) if status else df
    out = out.filter(F.col("alert_type") == alert_type) if alert_type else out
    return out.orderBy(F.desc("created_at"), "alert_id").limit(limit)


def timeline(
    events: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    observations: DataFrame | None = None,
    entity_id: str | None = None,
    limit: int = 200,
) -> DataFrame:
    """Events of a period, newest first, of one entity if given."""
    out = events.filter(F.col("observed_at") >= start) if start is not None else events
    out = out.filter(F.col("observed_at") <= end) if end is not None else out
    if entity_id is not None:
        if observations is None:
            raise ValueError("entity_id needs observations")
        of_entity = observations.filter(F.col("entity_id") == entity_id).select("event_id")
        out = out.join(of_entity, "event_id", "left_semi")
    return out.orderBy(F.desc("observed_at"), "event_id").limit(limit)


def findings(df: DataFrame, onion: str | None = None, limit: int = 50) -> DataFrame:
    out = df.filter(F.col("onion_entity") == onion) if onion else df
    return out.orderBy(F.desc("detected_at"), "finding_id").limit(limit)


def entities_of_actors(links: DataFrame, entities: DataFrame) -> DataFrame:
    return links.select("actor_id", "entity_id").join(entities, "entity_id")


def undirected_links(links: DataFrame) -> DataFrame:
    """Each persona link once per end, with the other end: an OR condition becomes an equi join."""
    out = links.select(F.col("actor_a").alias("actor_id"), F.col("actor_b").alias("other_id"), "*")
    back = links.select(F.col("actor_b").alias("actor_id"), F.col("actor_a").alias("other_id"), "*")
    return out.unionByName(back)


def link_evidence(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Links with their evidence rows and reasons."""
    from ..functions.scores import why_text

    per_link = evidence.groupBy("link_id").agg(
        F.array_sort(F.collect_list(F.struct("evidence_type", "llr", "reliability", "credibility"))).alias("evidence"),
    )
    joined = links.join(per_link, "link_id", "left")
    return joined.withColumn(
        "why", F.coalesce(F.transform("evidence", lambda e: why_text(e["evidence_type"])), F.array().cast("array<string>"))
    )


def watch_hits(observations: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Alerts for observations of watched entities; also works on a stream of observations."""
    watched = watchlist.select("entity_id", "item_id", "created_by").distinct()
    return observations.join(watched, "entity_id").withColumn("alert_type", F.lit("watchlist_hit"))


def new_actors(spans: DataFrame, since: Column) -> DataFrame:
    """Alerts for actors first seen at or after ``since``."""
    return spans.filter(F.col("first_seen") >= since).withColumn("alert_type", F.lit("new_actor"))


def infra_leaks(found: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Alerts for findings at or above a confidence."""
    return found.filter(F.col("confidence") >= min_confidence).withColumn("alert_type", F.lit("infra_leak"))


def unknown_sources(requested: DataFrame, known: DataFrame) -> DataFrame:
    return requested.join(known.select("source").distinct(), "source", "left_anti")


def dispatch_groups(requested: DataFrame, known: DataFrame) -> DataFrame:
    """One request per group: the first by request position."""
    joined = requested.join(known, "source")
    return joined.groupBy("group").agg(F.min_by("source", "pos").alias("source"))
