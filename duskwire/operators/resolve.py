"""Entity resolution, observations and graph tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import name_uuid
from ..functions.identifiers import extract_all
from ..functions.scores import kind_label
from ..lineage import cut_lineage


def extract_hits(events: DataFrame, text: str = "text", author: str | None = "handle") -> DataFrame:
    """One row per (event, kind, normalized) with the first hit in extractor order."""
    who = F.col(author) if author else None
    keep = [c for c in ("event_id", "source_id", "observed_at") if c in events.columns]
    # the outer form keeps Spark from repeating the extraction in a filter on its result
    rows = events.select(*keep, F.posexplode_outer(extract_all(F.col(text), who)).alias("hit_pos", "hit"))
    return rows.filter("hit_pos is not null").select(*keep, "hit_pos", "hit.*")


def entity_id(kind: Column, normalized: Column) -> Column:
    """The identity of an entity is (kind, normalized), so its id is derived from that."""
    return name_uuid(F.concat_ws("|", F.lit("entity"), kind, normalized))


def entity_spans(hits: DataFrame) -> DataFrame:
    """First and last sighting per (kind, normalized); the value is that of the earliest event.

    Hits with ``metadata`` give their ``currency`` too, which the address form decides.
    """
    currency = [F.max(F.col("metadata")["currency"]).alias("currency")] if "metadata" in hits.columns else []
    return (
        hits.groupBy("kind", "normalized")
        .agg(
            F.min("observed_at").alias("first_seen"),
            F.max("observed_at").alias("last_seen"),
            F.min_by("value", F.struct("observed_at", "event_id", "hit_pos")).alias("value"),
            F.count(F.lit(1)).alias("sightings"),
            *currency,
        )
        .withColumn("entity_id", entity_id(F.col("kind"), F.col("normalized")))
    )


def merge_entities(existing: DataFrame, spans: DataFrame) -> DataFrame:
    """Upsert by (kind, normalized): known entities keep id, value and first_seen."""
    old, new = existing.alias("old"), spans.alias("new")
    cols = ["entity_id", "kind", "normalized", "value"]
    joined = old.join(new, ["kind", "normalized"], "full_outer")
    return joined.select(
        *[
            F.col(c) if c in ("kind", "normalized") else F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")).alias(c)
            for c in cols
        ],
        F.coalesce("old.first_seen", "new.first_seen").alias("first_seen"),
        F.greatest("old.last_seen", "new.last_seen").alias("last_seen"),
        F.col("old.entity_id").isNull().alias("is_new"),
    )


def observations(hits: DataFrame, entities: DataFrame | None = None, role: str = "extracted") -> DataFrame:
    """Event-entity links, one per (event, entity, role).

    Ids follow from the identity, so no join is needed. Pass ``entities`` only for a table whose
    older ids were given otherwise.
    """
    if entities is None:
        linked = hits.withColumn("entity_id", entity_id(F.col("kind"), F.col("normalized")))
    else:
        linked = hits.join(entities.select("kind", "normalized", "entity_id"), ["kind", "normalized"], "left")
    return (
        linked.groupBy("event_id", "entity_id")
        .agg(F.min("observed_at").alias("observed_at"))
        .withColumn("role", F.lit(role))
    )


def vertices(entities: DataFrame) -> DataFrame:
    """Entity nodes with the properties of their kind."""
    kind, value = F.col("kind"), F.col("value")
    props = F.map_filter(
        F.create_map(
            F.lit("kind"), kind,
            F.lit("value"), value,
            F.lit("normalized"), F.col("normalized"),
            F.lit("fingerprint"), F.when(kind == "pgp", F.col("normalized")),
            F.lit("address"), F.when(kind == "onion", value),
            F.lit("name"), F.when(kind == "domain", value),
        ),
        lambda k, v: v.isNotNull(),
    )
    return entities.select(F.col("entity_id").alias("id"), kind_label(kind).alias("label"), props.alias("props"))


def actors_from_handles(hits: DataFrame) -> DataFrame:
    """One actor per handle with a derived id and its activity span."""
    return (
        hits.filter("kind = 'handle'")
        .groupBy("normalized")
        .agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
        .select(
            name_uuid(F.concat_ws("|", F.lit("actor"), "normalized")).alias("actor_id"),
            F.col("normalized").alias("label"),
            F.lit("unknown").alias("category"),
            F.lit("active").alias("status"),
            "first_seen",
            "last_seen",
        )
    )


def actor_entities(hits: DataFrame) -> DataFrame:
    """Entities seen in events that carry the handle of an actor: the USES edges."""
    handles = hits.filter("kind = 'handle'").select(
        "event_id", name_uuid(F.concat_ws("|", F.lit("actor"), "normalized")).alias("actor_id")
    )
    return (
        handles.join(hits.select("event_id", "kind", "normalized"), "event_id")
        .select("actor_id", entity_id(F.col("kind"), F.col("normalized")).alias("entity_id"))
        .distinct()
    )


def edges_uses(links: DataFrame) -> DataFrame:
    return links.select(F.col("actor_id").alias("src"), F.col("entity_id").alias("dst"), F.lit("USES").alias("type"))


def sharing_pairs(actors: DataFrame, keep: Sequence[str] = (), chunk: int = 256) -> DataFrame:
    """(a, b, pgp, contacts, wallets) with a < b: how many identifiers of each kind two actors share, where they share any.

    Actors (one row each) with the same identifiers form a class. Classes are paired by an equi join on exploded
    identifiers; pairs of actors are made of their members, ``chunk`` by ``chunk``, and never shuffled. Columns of ``keep``
    come along as a_<column> and b_<column>.
    """
    kinds = {"pgp": "pgp_fingerprints", "contacts": "contact_ids", "wallets": "wallet_addresses"}

    def of(kind: str, column: str) -> Column:
        values = F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda v: v != "")
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    def count_of(kind: str) -> Column:
        return F.size(F.filter("listed", lambda i: i["kind"] == kind)).cast("long")

    listed = F.array_sort(F.array_distinct(F.concat(*[of(k, c) for k, c in kinds.items()])))
    rows = actors.select(listed.alias("listed"), F.struct("actor_id", *keep).alias("member")).filter(F.size("listed") > 0)
    classes = rows.groupBy("listed").agg(F.collect_list("member").alias("members"))
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    items = classes.select("id", F.explode("listed").alias("i")).select("id", "i.kind", "i.value")
    left, right = items.withColumnRenamed("id", "x"), items.withColumnRenamed("id", "y")
    met = left.join(right, ["kind", "value"]).filter("x < y").groupBy("x", "y").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    own = classes.select(
        F.col("id").alias("x"), F.col("id").alias("y"),
        *[count_of(k).alias(k) for k in kinds],
    )
    starts = F.sequence(F.lit(1), F.size("members"), F.lit(chunk))
    parts = classes.select("id", "members", F.explode(starts).alias("at")).select("id", F.slice("members", F.col("at"), chunk).alias("m"))
    pairs = met.unionByName(own).join(parts.select(F.col("id").alias("x"), F.col("m").alias("mx")), "x")
    pairs = pairs.join(parts.select(F.col("id").alias("y"), F.col("m").alias("my")), "y")
    # two members of different classes meet once, in either order; those of one class meet in both
    sides = pairs.select("*", F.explode("mx").alias("s")).select("*", F.explode("my").alias("t"))
    kept = sides.filter((F.col("s.actor_id") < F.col("t.actor_id")) | ((F.col("x") != F.col("y")) & (F.col("s.actor_id") > F.col("t.actor_id"))))
    swap = F.col("s.actor_id") > F.col("t.actor_id")
    both = kept.select(*kinds, F.when(swap, F.col("t")).otherwise(F.col("s")).alias("s"), F.when(swap, F.col("s")).otherwise(F.col("t")).alias("t"))
    return both.select(
        F.col("s.actor_id").alias("a"), F.col("t.actor_id").alias("b"), *kinds,
        *[F.col(f"{side}.{c}").alias(f"{name}_{c}") for name, side in (("a", "s"), ("b", "t")) for c in keep],
    )
