"""Readers for landed files, payloads and the event bus."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import pages
from ..functions.hashing import content_hash, name_uuid
from ..functions.identifiers import archive_entities
from ..operators.gates import redact


def bus(spark: SparkSession, servers: str, topic: str, from_beginning: bool = False) -> DataFrame:
    """Event stream from a Kafka topic; needs the Kafka package on the cluster."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest" if from_beginning else "latest")
        .load()
        .select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "timestamp")
    )


def decode_events(raw: DataFrame) -> DataFrame:
    """Event envelopes from JSON text, with ``error`` set where a message is unusable."""
    parsed = F.from_json(
        "value", schemas.RAW_EVENT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    out = raw.withColumn("e", parsed)
    error = (
        F.when(F.col("e").isNull() | F.col("e._bad").isNotNull(), "invalid json")
        .when(F.coalesce(F.col("e.source_id"), F.lit("")) == "", "missing source_id")
        .when(~F.coalesce(F.col("e.adapter_type").isin(schemas.ADAPTER_TYPES), F.lit(False)), "unknown adapter_type")
        .when(~F.coalesce(F.col("e.mode").isin(schemas.MODES), F.lit(False)), "unknown mode")
        .when(~F.coalesce(F.col("e.content_type").isin(schemas.CONTENT_TYPES), F.lit(False)), "unknown content_type")
        .when(F.col("e.observed_at").isNull(), "missing observed_at")
        .when(F.col("e.content_hash").isNull(), "missing content_hash")
    )
    return out.withColumn("error", error)


def good_events(decoded: DataFrame) -> DataFrame:
    return decoded.filter("error is null").select("e.*").drop("_bad")


def dead_letters(decoded: DataFrame, topic: str) -> DataFrame:
    """Unusable messages as they arrived, with the reason."""
    return decoded.filter("error is not null").select(
        F.lit(topic).alias("original_topic"), "error", F.col("value").alias("event_data"),
        F.current_timestamp().alias("failed_at"),
    )


def with_payload(events: DataFrame, payloads: DataFrame) -> DataFrame:
    """Text of each event: the stored payload, else the inline text; empty ones are dropped.

    ``payloads``: payload_ref, content (binary).
    """
    stored = payloads.select("payload_ref", F.decode("content", "UTF-8").alias("_stored"))
    inline = F.get_json_object("raw_metadata", "$.text")
    joined = events.join(stored, "payload_ref", "left").withColumn("text", F.coalesce("_stored", inline))
    return joined.filter(F.length("text") > 0).drop("_stored")


def payload_files(spark: SparkSession, path: str, marker: str = "payload/") -> DataFrame:
    """Payload files as (payload_ref, content); the reference is the path from ``marker`` on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ref = F.concat(F.lit(marker), F.substring_index("path", marker, -1))
    return files.select(ref.alias("payload_ref"), "content")


def replay(posts: DataFrame, source_id: str = "src_replay", keep: Sequence[str] = ()) -> DataFrame:
    """Posts as replay events: redact, hash, wrap. ``keep``: columns that stay beside the event's."""
    out = redact(posts, "text")
    out = out.withColumn("content_hash", content_hash(F.col("text")))
    meta = F.to_json(F.struct("handle", "market", F.col("actor_id").cast("string").alias("actor_id"), F.col("post_id").cast("string").alias("post_id")))
    return out.select(
        name_uuid(F.concat_ws("|", F.lit(source_id), F.col("post_id").cast("string"))).alias("event_id"),
        F.lit(source_id).alias("source_id"), F.lit("replay").alias("adapter_type"), F.lit("replay").alias("mode"),
        F.col("posted_at").alias("observed_at"), F.lit("text").alias("content_type"),
        F.concat(F.lit("payload/replay/"), F.col("post_id").cast("string"), F.lit(".txt")).alias("payload_ref"),
        "content_hash", F.lit("replay-auto-allow").alias("policy_decision_id"),
        F.coalesce("language", F.lit("en")).alias("language"), meta.alias("raw_metadata"), "redactions", "text", *keep,
    )


def archive(files: DataFrame, root: str = "", min_chars: int = 50) -> DataFrame:
    """Archived pages with identifiers: path, category, text, entities.

    ``files``: path, html. Short pages and pages without any identifier are dropped.
    """
    # paths come with a scheme in front of the root
    relative = F.col("path") if not root else F.ltrim(
        F.substring("path", F.instr("path", root) + F.lit(len(root)), F.length("path")), F.lit("/")
    )
    # each value is made once: a filter on it would otherwise make it again for every use of its condition
    out = files.select(relative.alias("path"), F.explode_outer(F.array(pages.strip_html(F.col("html")))).alias("text"))
    out = out.filter(F.length("text") >= min_chars)
    out = out.select("path", "text", F.explode_outer(F.array(archive_entities(F.col("text")))).alias("entities"))
    names = ["btc_addresses", "pgp_key_hashes", "emails", "vendor_handles"]
    found: Column = F.size(f"entities.{names[0]}")
    for n in names[1:]:
        found = found + F.size(f"entities.{n}")
    return out.filter(found > 0).select(
        "path", F.substring_index("path", "/", 1).alias("category"), F.length("text").alias("text_length"), "text", "entities"
    )


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """All HTML files below ``path`` as (path, html)."""
    files = (
        spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.html").text(path)
    )
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
