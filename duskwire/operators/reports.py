"""Report tables behind the exports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lookup
from ..functions.hashing import content_hash
from .ordering import split_parts

EVIDENCE_COLUMNS = [
    "evidence_id", "type", "value", "source_id", "reliability", "credibility", "content_hash",
    "collected_at", "merkle_batch_id",
]
ENTITY_COLUMNS = ["entity_id", "kind", "value", "normalized", "first_seen", "last_seen"]
TIMELINE_COLUMNS = ["timestamp", "event_type", "source", "handle", "market", "summary"]
IDENTITY_GROUPS = {
    "handles": "handle", "pgp_keys": "pgp", "wallets": "wallet", "contact_ids": "contact_id",
    "emails": "email", "onion_addresses": "onion",
}


def with_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns``: others are dropped, missing ones are NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


PART_SIZE = 5000


def _entries_of(entries: Column, kind: str) -> Column:
    return F.transform(
        F.filter(entries, lambda e: e["kind"] == kind),
        lambda e: F.struct(e["entity_id"].alias("entity_id"), e["value"].alias("value")),
    )


def dossiers(actors: DataFrame, links: DataFrame, entities: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """(actor_id, part, report_json, export_hash): nested reports.

    ``links``: actor_id, entity_id. An actor with more than ``part_size`` entities gets several
    parts, so no report outgrows a row. The hash covers the report as serialised.
    """
    owned = split_parts(links.join(entities, "entity_id"), ["actor_id"], "entity_id", part_size)
    entry = F.struct("kind", "value", "entity_id")
    per_actor = owned.groupBy("actor_id", "part").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    joined = actors.join(per_actor, "actor_id", "left")
    empty = F.array().cast("array<struct<kind:string,value:string,entity_id:string>>")
    entries = F.coalesce(F.col("_e"), empty)
    groups = [
        _entries_of(entries, kind).alias(name)
        for name, kind in IDENTITY_GROUPS.items()
    ]
    report = F.struct(
        F.lit("actor_dossier").alias("report_type"),
        F.lit("RESTRICTED").alias("classification"),
        F.struct(
            "actor_id", "label", "category", "status",
            iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"),
        ).alias("actor"),
        F.struct(*groups).alias("known_identities"),
    )
    return joined.select(
        "actor_id", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(report).alias("report_json")
    ).withColumn("export_hash", content_hash(F.col("report_json")))


def dossier_fields(actors: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Dossiers as (actor_id, field, value) rows with one row per entity."""
    counts = links.groupBy("actor_id").agg(F.count(F.lit(1)).alias("entity_count"))
    wide = actors.join(counts, "actor_id", "left").select(
        "actor_id", F.col("label").alias("handle"), "category", "status",
        iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"),
        F.coalesce("entity_count", F.lit(0)).cast("string").alias("entity_count"),
    )
    names = ["handle", "category", "status", "first_seen", "last_seen", "entity_count"]
    fields = wide.unpivot("actor_id", names, "field", "value")
    owned = links.join(entities, "entity_id").select(
        "actor_id", F.concat(F.lit("entity:"), "kind").alias("field"), "value"
    )
    return fields.unionByName(owned)


def actor_counts(actors: DataFrame, links: DataFrame, status: str | None = None) -> DataFrame:
    """Actors with their entity count: one aggregate in place of a query per actor."""
    chosen = actors.filter(F.col("status") == status) if status else actors
    counts = links.groupBy("actor_id").agg(F.count(F.lit(1)).alias("entity_count"))
    return chosen.join(counts, "actor_id", "left").select(
        "actor_id", F.col("label").alias("handle"), "category", "status",
        iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"),
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"),
    )


def intel_package(actors: DataFrame, entities: DataFrame, entity_limit: int | None = None) -> DataFrame:
    """Actors and entities in one eight-column layout; ``entity_limit`` bounds the entities by id."""
    chosen = entities.orderBy("entity_id").limit(entity_limit) if entity_limit else entities
    blank = F.lit("")
    left = actors.select(
        F.lit("actor").alias("type"), F.col("actor_id").alias("id"), F.col("label").alias("handle_or_value"),
        F.col("category").alias("category_or_kind"), "status", blank.alias("confidence"),
        iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"),
    )
    right = chosen.select(
        F.lit("entity").alias("type"), F.col("entity_id").alias("id"), F.col("value").alias("handle_or_value"),
        F.col("kind").alias("category_or_kind"), blank.alias("status"), blank.alias("confidence"),
        blank.alias("first_seen"), blank.alias("last_seen"),
    )
    return left.unionByName(right)


STIX_TYPES = {"email": "email-addr", "wallet": "x-cryptocurrency-wallet", "onion": "domain-name", "ip": "ipv4-addr"}


def stix_objects(actors: DataFrame, links: DataFrame, entities: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """(actor_id, object_id, object_json): the objects of each actor's bundle, one row each.

    ``entities`` may carry ``currency``. Kinds without an observable type are left out. An actor
    with more than ``part_size`` handles has further actor objects for the rest of its aliases.
    """
    owned = links.join(entities, "entity_id")
    handles = split_parts(owned.filter("kind = 'handle'"), ["actor_id"], "entity_id", part_size)
    aliases = handles.groupBy("actor_id", "part").agg(F.array_sort(F.collect_list("value")).alias("aliases"))
    actor = actors.join(aliases, "actor_id", "left").select(
        "actor_id",
        F.concat(F.lit("threat-actor--"), "actor_id").alias("object_id"),
        F.to_json(F.struct(
            F.lit("threat-actor").alias("type"), F.lit("2.1").alias("spec_version"),
            F.concat(F.lit("threat-actor--"), "actor_id").alias("id"),
            iso(F.col("first_seen")).alias("created"), iso(F.col("last_seen")).alias("modified"),
            F.col("label").alias("name"), F.array(F.lit("unknown")).alias("threat_actor_types"),
            F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        )).alias("object_json"),
    )
    stix_type = lookup(F.col("kind"), STIX_TYPES)
    typed = owned.withColumn("_type", stix_type).filter(F.col("_type").isNotNull())
    is_wallet = F.col("kind") == "wallet"
    currency = F.coalesce("currency", F.lit("unknown")) if "currency" in entities.columns else F.lit("unknown")
    object_id = F.concat(F.col("_type"), F.lit("--"), F.col("entity_id"))
    observables = typed.select(
        "actor_id",
        object_id.alias("object_id"),
        F.to_json(F.struct(
            F.col("_type").alias("type"), F.lit("2.1").alias("spec_version"),
            object_id.alias("id"),
            F.when(is_wallet, F.col("value")).alias("address"),
            F.when(is_wallet, currency).alias("currency"),
            F.when(~is_wallet, F.col("value")).alias("value"),
        )).alias("object_json"),
    )
    return actor.unionByName(observables)


def stix_bundles(objects: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """(actor_id, part, bundle_json) from the objects of an actor; the actor object comes first."""
    ordered = F.array_sort(F.collect_list(F.struct(
        (~F.startswith("object_id", F.lit("threat-actor"))).alias("later"), "object_id", "object_json"
    )))
    body = F.array_join(F.transform(ordered, lambda o: o["object_json"]), ",")
    return split_parts(objects, ["actor_id"], "object_id", part_size).groupBy("actor_id", "part").agg(
        F.concat(
            F.lit('{"type":"bundle","id":"bundle--'), F.col("actor_id"), F.lit('","objects":['), body, F.lit("]}")
        ).alias("bundle_json")
    )
