"""Feed normalisation: landed JSON or text lines become events of one layout.

A feed reader takes a frame with one landed record per row in column ``value`` and returns
typed fields plus the event envelope: observed_at, content, content_hash, redactions.
Records that are not valid JSON are dropped here and kept by ``bad_records``.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import ranked
from ..functions.hashing import content_hash
from ..functions.identifiers import attack_tags, contact_field
from ..functions.scores import normalize_group
from ..operators.gates import redact


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(f"r.{name}"), F.lit(default))


def _array(name: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(f"r.{name}"), F.array().cast(f"array<{kind}>"))


def _time(*names: str) -> Column:
    """First given field as a timestamp; blanks between date and time and a final Z are accepted."""
    raw = F.coalesce(*[F.col(f"r.{n}") for n in names])
    return F.try_to_timestamp(raw)


@dataclass(frozen=True)
class Feed:
    """How one feed maps to event fields."""

    name: str
    record_type: str
    schema: str
    fields: Callable[[], dict[str, Column]]
    time_fields: tuple[str, ...] = ()
    redacts: bool = False
    adapter_type: str = "osint_feed"
    keep: Callable[[], Column] | None = None



def parse(landed: DataFrame, schema: str) -> DataFrame:
    """Valid records as struct ``r`` beside the landed text."""
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return landed.withColumn("r", parsed).filter(F.col("r").isNotNull() & F.col("r._bad").isNull())


def bad_records(landed: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return landed.withColumn("r", parsed).filter(F.col("r").isNull() | F.col("r._bad").isNotNull()).drop("r")


def normalize(landed: DataFrame, feed: Feed, now: Column | None = None) -> DataFrame:
    """Event rows of one feed. ``now`` stands in for a missing or unreadable time."""
    now = F.current_timestamp() if now is None else now
    records = parse(landed, feed.schema)
    if feed.keep is not None:
        records = records.filter(feed.keep())
    observed = F.coalesce(_time(*feed.time_fields), now) if feed.time_fields else now
    out = records.select(
        *[c for c in landed.columns if c != "value"],
        F.col("value").alias("content"),
        observed.alias("observed_at"),
        F.lit(feed.record_type).alias("record_type"),
        F.lit(feed.adapter_type).alias("adapter_type"),
        F.lit("live").alias("mode"),
        *[c.alias(n) for n, c in feed.fields().items()],
    )
    if feed.redacts:
        out = redact(out, "content")
    else:
        out = out.withColumn("redactions", F.array().cast("array<string>"))
    return out.withColumn("content_hash", content_hash(F.col("content")))


def _group(*names: str) -> Column:
    return normalize_group(F.coalesce(*[F.col(f"r.{n}") for n in names], F.lit("unknown")))


def _relay_ips() -> Column:
    ips = F.transform(
        _array("or_addresses"),
        lambda a: F.btrim(F.regexp_replace(a, F.lit(r":[^:]*$"), F.lit("")), F.lit("[]")),
    )
    return F.filter(ips, lambda ip: ip != "")


def _sans() -> Column:
    names = F.transform(F.split(_text("name_value"), "\n"), lambda d: F.btrim(d, F.lit(" \t\r\n")))
    return F.filter(names, lambda d: (d != "") & ~F.startswith(d, F.lit("*")))


def has_onion(domains: Column) -> Column:
    return F.exists(domains, lambda d: F.contains(d, F.lit(".onion")))


def has_clearnet(domains: Column) -> Column:
    return F.exists(domains, lambda d: ~F.endswith(d, F.lit(".onion")) & F.contains(d, F.lit(".")))


def _advisory_kept() -> Column:
    use = F.lower(_text("knownRansomwareCampaignUse"))
    text = F.concat_ws(" ", use, F.lower(_text("shortDescription")))
    hit = use == "known"
    for word in fixed.ADVISORY_KEYWORDS:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _co_spent() -> Column:
    address = F.col("r.address")
    many = F.filter(_array_of("transactions"), lambda t: F.size(t["vin"]) > 1)
    inputs = F.flatten(F.transform(many, lambda t: F.transform(t["vin"], lambda v: v["prevout"]["scriptpubkey_address"])))
    return F.filter(inputs, lambda a: (a != "") & (a != address))


def _array_of(name: str) -> Column:
    return F.coalesce(F.col(f"r.{name}"), F.filter(F.col(f"r.{name}"), lambda x: F.lit(False)))


def _counterparties() -> Column:
    address = F.lower("r.address")
    ends = F.flatten(F.transform(_array_of("transactions"), lambda t: F.array(t["from"], t["to"])))
    return ranked(F.filter(ends, lambda a: (a != "") & (F.lower(a) != address)))


FEEDS: dict[str, Feed] = {
    f.name: f
    for f in [
        Feed(
            "feed_ransom_group", "ransomware_group", "name string, locations array<string>, description string, url string",
            lambda: {
                "group_name": _group("name"), "original_name": F.col("r.name"), "onion_urls": _array("locations"),
                "description": _text("description"), "profile_url": _text("url"),
            },
            redacts=True,
        ),
        Feed(
            "feed_ransom_victim", "ransomware_victim", "group_name string, victim string, website string, discovered string",
            lambda: {
                "group_name": _group("group_name"), "victim_name": _text("victim"), "website": _text("website"),
                "discovered": _text("discovered"),
            },
            ("discovered",), redacts=True,
        ),
        Feed(
            "feed_ransom_post", "ransomware_post",
            "group_name string, `group` string, post_title string, post_url string, discovered string",
            lambda: {
                "group_name": _group("group_name", "group"), "post_title": _text("post_title"),
                "post_url": _text("post_url"), "discovered": _text("discovered"),
            },
            redacts=True,
        ),
        Feed(
            "feed_ransom_recent", "ransomware_post",
            "group_name string, `group` string, post_title string, post_url string, discovered string, date string",
            lambda: {
                "group_name": _group("group_name", "group"), "post_title": _text("post_title"),
                "post_url": _text("post_url"), "discovered": F.coalesce("r.discovered", "r.date"),
            },
            ("discovered", "date"), keep=lambda: _time("discovered", "date").isNotNull(),
        ),
        Feed(
            "feed_url", "malicious_url",
            "url string, url_status string, threat string, tags array<string>, reporter string, date_added string",
            lambda: {
                "url": _text("url"), "url_status": _text("url_status"), "threat": _text("threat"), "tags": _array("tags"),
                "reporter": _text("reporter"), "is_onion": F.contains(_text("url"), F.lit(".onion")),
            },
            ("date_added",), redacts=True,
        ),
        Feed(
            "feed_ioc", "ioc",
            "ioc_type string, ioc string, threat_type string, malware string, malware_alias string, "
            "confidence_level int, reporter string, tags array<string>, first_seen string",
            lambda: {
                "ioc_type": _text("ioc_type"), "ioc_value": _text("ioc"), "threat_type": _text("threat_type"),
                "malware": _text("malware"), "malware_alias": _text("malware_alias"),
                "confidence_level": F.coalesce("r.confidence_level", F.lit(0)), "reporter": _text("reporter"),
                "tags": _array("tags"),
            },
            ("first_seen",), redacts=True,
        ),
        Feed(
            "feed_sample", "malware_sample_metadata",
            "sha256_hash string, md5_hash string, file_type string, signature string, tags array<string>, "
            "reporter string, delivery_method string, first_seen string",
            lambda: {
                "sha256_hash": _text("sha256_hash"), "md5_hash": _text("md5_hash"), "file_type": _text("file_type"),
                "signature": _text("signature"), "tags": _array("tags"), "reporter": _text("reporter"),
                "delivery_method": _text("delivery_method"),
            },
            ("first_seen",),
        ),
        Feed(
            "feed_c2", "c2_ip",
            "ip_address string, dst_ip string, dst_port string, port string, malware string, status string, "
            "as_number string, as_name string, country string, first_seen string",
            lambda: {
                "ip_address": F.coalesce("r.ip_address", "r.dst_ip", F.lit("")),
                "port": F.coalesce("r.dst_port", "r.port", F.lit("")), "malware": _text("malware"),
                "status": _text("status"), "as_number": _text("as_number"), "as_name": _text("as_name"),
                "country": _text("country"),
            },
            ("first_seen",),
        ),
        Feed(
            "feed_relay", "tor_relay",
            "fingerprint string, nickname string, contact string, platform string, flags array<string>, `as` string, "
            "as_name string, country string, or_addresses array<string>, bandwidth_rate bigint, "
            "consensus_weight bigint, first_seen string, last_seen string, running boolean",
            lambda: {
                "fingerprint": _text("fingerprint"), "nickname": _text("nickname"), "contact": _text("contact"),
                "contact_entities": contact_field(_text("contact")), "platform": _text("platform"),
                "flags": _array("flags"), "as_number": _text("as"), "as_name": _text("as_name"),
                "country": _text("country"), "relay_ips": _relay_ips(),
                "bandwidth_rate": F.coalesce("r.bandwidth_rate", F.lit(0)),
                "consensus_weight": F.coalesce("r.consensus_weight", F.lit(0)),
                "last_seen": _text("last_seen"), "running": F.coalesce("r.running", F.lit(False)),
            },
            ("first_seen",),
        ),
        Feed(
            "feed_advisory", "cert_advisory",
            "cveID string, vendorProject string, product string, vulnerabilityName string, "
            "knownRansomwareCampaignUse string, shortDescription string, dateAdded string",
            lambda: {
                "source_reliability": F.lit("A"), "information_credibility": F.lit("1"), "cve_id": _text("cveID"),
                "vendor": _text("vendorProject"), "product": _text("product"),
                "vulnerability_name": _text("vulnerabilityName"),
                "ransomware_use": _text("knownRansomwareCampaignUse"), "description": _text("shortDescription"),
            },
            ("dateAdded",), keep=_advisory_kept,
        ),
        Feed(
            "feed_cert", "certificate",
            "common_name string, name_value string, issuer_name string, serial_number string, not_before string, "
            "not_after string, entry_timestamp string",
            lambda: {
                "common_name": _text("common_name"), "san_domains": _sans(), "issuer_name": _text("issuer_name"),
                "serial_number": _text("serial_number"), "has_onion": has_onion(_sans()),
                "has_clearnet": has_clearnet(_sans()), "is_san_leak": has_onion(_sans()) & has_clearnet(_sans()),
            },
            ("entry_timestamp",), adapter_type="clearnet_intel",
        ),
        Feed(
            "feed_ip_intel", "ip_intelligence",
            "ip string, ports array<int>, hostnames array<string>, cpes array<string>, tags array<string>, vulns array<string>",
            lambda: {
                "ip": F.col("r.ip"), "ports": _array("ports", "int"), "hostnames": _array("hostnames"),
                "cpes": _array("cpes"), "tags": _array("tags"), "vulns": _array("vulns"),
            },
            adapter_type="clearnet_intel", keep=lambda: F.col("r.ip").isNotNull(),
        ),
        Feed(
            "feed_pulse", "otx_pulse",
            "id string, name string, description string, tags array<string>, targeted_countries array<string>, "
            "malware_families array<string>, attack_ids array<string>, adversary string, created string, "
            "indicators array<struct<type:string,indicator:string>>",
            lambda: {
                "pulse_id": _text("id"), "name": _text("name"), "description": _text("description"),
                "tags": _array("tags"), "adversary": _text("adversary"),
                "indicators": _array_of("indicators"), "ioc_count": F.coalesce(F.size("r.indicators"), F.lit(0)),
            },
            ("created",),
        ),
        Feed(
            "feed_ip_rep", "ip_reputation",
            "ip string, noise boolean, riot boolean, classification string, name string, link string, last_seen string, message string",
            lambda: {
                "ip": F.col("r.ip"), "noise": F.coalesce("r.noise", F.lit(False)), "riot": F.coalesce("r.riot", F.lit(False)),
                "classification": _text("classification"), "name": _text("name"), "link": _text("link"),
                "last_seen": _text("last_seen"),
            },
            adapter_type="clearnet_intel",
            keep=lambda: F.coalesce(F.col("r.message") != "IP not found", F.lit(True)),
        ),
        Feed(
            "feed_sslbl", "ssl_blacklist", "sha1 string, subject string, issuer string, reason string",
            lambda: {
                "sha1": _text("sha1"), "subject": _text("subject"), "issuer": _text("issuer"), "reason": _text("reason"),
            },
        ),
        Feed(
            "feed_rule", "detection_rule",
            "title string, id string, status string, level string, tags array<string>, author string, "
            "description string, `references` array<string>",
            lambda: {
                "rule_title": _text("title"), "rule_id": _text("id"), "status": _text("status"), "level": _text("level"),
                "tags": F.col("r.tags"), "actors": attack_tags(F.col("r.tags"))["actors"],
                "techniques": attack_tags(F.col("r.tags"))["techniques"], "author": _text("author"),
                "description": _text("description"),
            },
            keep=lambda: F.coalesce(F.size("r.tags") > 0, F.lit(False)),
        ),
        Feed(
            "feed_key", "pgp_key_lookup", "fingerprint string, email string, found boolean",
            lambda: {"fingerprint": _text("fingerprint"), "email": _text("email"), "found": F.col("r.found")},
            keep=lambda: F.coalesce(F.col("r.found"), F.lit(False)),
        ),
        Feed(
            "feed_btc", "btc_address",
            "address string, chain_stats struct<tx_count:bigint,funded_txo_sum:bigint,spent_txo_sum:bigint>, utxo_count bigint, "
            "transactions array<struct<txid:string,vin:array<struct<prevout:struct<scriptpubkey_address:string>>>>>",
            lambda: {
                "address": F.col("r.address"), "tx_count": F.coalesce("r.chain_stats.tx_count", F.lit(0)),
                "funded_sum": F.coalesce("r.chain_stats.funded_txo_sum", F.lit(0)),
                "spent_sum": F.coalesce("r.chain_stats.spent_txo_sum", F.lit(0)),
                "utxo_count": F.coalesce("r.utxo_count", F.lit(0)), "co_spent_addresses": _co_spent(),
            },
            adapter_type="blockchain",
        ),
        Feed(
            "feed_eth", "eth_address",
            "address string, transactions array<struct<`from`:string,`to`:string>>, token_transfers array<struct<`from`:string,`to`:string>>",
            lambda: {
                "address": F.col("r.address"), "tx_count": F.coalesce(F.size("r.transactions"), F.lit(0)),
                "token_tx_count": F.coalesce(F.size("r.token_transfers"), F.lit(0)),
                "interacting_addresses": _counterparties(),
            },
            adapter_type="blockchain",
        ),
    ]
}


def recent(events: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Rows observed within the last ``days`` days before ``now``."""
    return events.filter(F.col("observed_at") >= now - F.expr(f"interval {days} days"))


def pulse_types(pulses: DataFrame) -> DataFrame:
    """(pulse_id, type, n): indicators per pulse and type."""
    types = F.transform("indicators", lambda i: F.coalesce(i["type"], F.lit("unknown")))
    return pulses.select("pulse_id", F.explode(types).alias("type")).groupBy("pulse_id", "type").agg(
        F.count(F.lit(1)).alias("n")
    )


def exit_list(lines: DataFrame) -> DataFrame:
    """Distinct addresses of a text list without blanks and comments."""
    ip = F.btrim("value", F.lit(" \t\r\n"))
    return lines.select(ip.alias("ip")).filter((F.col("ip") != "") & ~F.startswith("ip", F.lit("#"))).distinct()


def sanctions(lines: DataFrame) -> DataFrame:
    """Distinct wallet addresses named in a sanctions text list."""
    marked = lines.filter(
        F.contains("value", F.lit("Digital Currency Address")) | F.contains("value", F.lit("XBT")) | F.contains("value", F.lit("ETH"))
    )
    parts = marked.select(F.explode(F.split("value", ";")).alias("p")).select(F.btrim("p", F.lit(" \t\r\n")).alias("p"))
    btc = parts["p"].rlike("^(?:1|3|bc1)") & (F.length("p") >= 26)
    eth = F.startswith("p", F.lit("0x")) & (F.length("p") == 42)
    address = F.when(btc, F.col("p")).when(eth, F.lower("p"))
    return parts.select(address.alias("address")).filter(F.col("address").isNotNull()).distinct()


def envelope(events: DataFrame, source_id: str, language: str = "en") -> DataFrame:
    """The 13-field event layout with the typed fields packed into ``raw_metadata``."""
    from ..functions.hashing import name_uuid

    fixed_cols = {"content", "observed_at", "adapter_type", "mode", "redactions", "content_hash"}
    meta = F.to_json(F.struct(*[c for c in events.columns if c not in fixed_cols], F.col("content").alias("text")))
    return events.select(
        name_uuid(F.concat_ws("|", F.lit(source_id), "content_hash", F.unix_micros("observed_at").cast("string"))).alias("event_id"),
        F.lit(source_id).alias("source_id"),
        "adapter_type", "mode", "observed_at",
        F.current_timestamp().alias("collected_at"),
        F.lit("json").alias("content_type"),
        F.concat(F.lit("payload/"), F.substring("content_hash", 8, 2), F.lit("/"), F.substring("content_hash", 8, 32)).alias("payload_ref"),
        "content_hash",
        F.lit("live-approved-feed").alias("policy_decision_id"),
        F.lit(language).alias("language"),
        meta.alias("raw_metadata"),
        "redactions",
    )
