"""Infrastructure detectors: onion profiles against clearnet hosts.

Every detector compares keys. Each side is read once and exploded into its keys, (what, key), and one equi join on
them gives the findings of all detectors: detector_id, onion_address, clearnet_match, kind, confidence, evidence.
A stock value that many hosts share makes as many pairs; ``shared_values`` gives the same finding as the value with
its members, which stays linear.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

MIN_HEADERS = 4
#: detector: (what is compared, kind, confidence); D1 has two forms.
FORMS = [
    ("D1", "name", "cert_san", 0.95), ("D1", "ending", "cert_san", 0.90), ("D2", "favicon_hash", "favicon", 0.70),
    ("D3", "server_banner", "banner", 0.45), ("D4", "name", "server_status", 0.85), ("D5", "ssh_host_key", "ssh_key", 0.98),
    ("D6", "header_order", "header_order", 0.40), ("D7", "error_page_hash", "error_page", 0.55),
]
ALL = ("D1", "D2", "D3", "D4", "D5", "D6", "D7")
_KEY = "array<struct<what:string,key:string,detector_id:string,kind:string,confidence:double,evidence:string>>"


def _value_key(what: str) -> Column:
    """The compared form of a fingerprint column; null where there is nothing to compare."""
    if what == "header_order":
        names = F.array_join(F.transform(what, lambda h: F.lower(h)), "\n")
        return F.when(F.size(what) >= MIN_HEADERS, names)
    if what == "server_banner":
        plain = F.trim(F.lower(what))
        return F.when((F.col(what) != "") & (plain != "") & ~plain.isin(fixed.NOISE_BANNERS), plain)
    return F.when(F.col(what) != "", F.col(what))


def _evidence(what: str) -> Column:
    if what == "header_order":
        return F.array_join(F.transform(what, lambda h: F.lower(h)), ",")
    return F.substring(what, 1, 32) if what == "ssh_host_key" else F.col(what)


def onion_keys(onions: DataFrame, detectors: Sequence[str] = ALL) -> DataFrame:
    """(address, what, key, detector_id, kind, confidence, evidence): one row for each thing that can be compared."""

    def key(form: tuple, value: Column, evidence: Column) -> Column:
        detector, what, kind, confidence = form
        return F.struct(
            F.lit(what).alias("what"), value.alias("key"), F.lit(detector).alias("detector_id"), F.lit(kind).alias("kind"),
            F.lit(confidence).alias("confidence"), evidence.alias("evidence"),
        )

    parts = []
    for form in FORMS:
        if form[0] not in detectors:
            continue
        what = form[1]
        if form[0] == "D4":
            leaks = F.concat(*[
                F.transform(F.regexp_extract_all("status_page_text", F.lit(p), F.lit(1)), lambda h: F.lower(h)) for p in fixed.STATUS_PATTERNS
            ])
            parts.append(F.when(F.col("status_page_text") != "", _listed(leaks, form, key)))
        elif what == "name":
            parts.append(_listed(F.col("tls_cert_sans"), form, lambda f, v, e: key(f, F.lower(v), e)))
        elif what == "ending":
            wild = F.filter("tls_cert_sans", lambda v: F.startswith(v, F.lit("*.")))
            parts.append(_listed(wild, form, lambda f, v, e: key(f, F.substring(F.lower(v), 3, 1 << 30), e)))
        else:
            parts.append(F.array(key(form, _value_key(what), _evidence(what))))
    none = F.from_json(F.lit("[]"), _KEY)
    every = F.concat(*[F.coalesce(p, none) for p in parts])
    return onions.select("address", F.explode(every).alias("k")).select("address", "k.*").filter("key <> ''")


def _listed(values: Column, form: tuple, key) -> Column:
    return F.transform(values, lambda v: key(form, v, v))


def host_keys(hosts: DataFrame, detectors: Sequence[str] = ALL, endings: Sequence[int] = (), dot_boundary: bool = False) -> DataFrame:
    """(what, key, match): the keys of all hosts; ``endings``: the lengths of name endings that are asked for.

    Names count once however many rows have them, fingerprints as often as there are rows.
    """
    wanted = {what for detector, what, _, _ in FORMS if detector in detectors}
    pair = lambda what, key, match: F.struct(F.lit(what).alias("what"), key.alias("key"), match.alias("match"))
    name = F.lower("host")
    parts = []
    if "name" in wanted:
        parts.append(F.array(pair("name", name, name)))
    if "ending" in wanted and endings:
        size = F.length(name)
        fits = F.filter(F.array(*[F.lit(n) for n in endings]), lambda n: n <= size)
        if dot_boundary:
            fits = F.filter(fits, lambda n: (n == size) | (F.substr(name, size - n, F.lit(1)) == "."))
        parts.append(F.transform(fits, lambda n: pair("ending", F.substr(name, size - n + 1, n), name)))
    parts += [F.array(pair(what, _value_key(what), F.col("host"))) for what in sorted(wanted - {"name", "ending"})]
    # hosts are spread by name first: equal names meet in one task, which then counts its share without another shuffle
    tasks = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = hosts.withColumn("_name", name).repartition(tasks, "_name")
    rows = spread.select("_name", F.explode(F.concat(*parts)).alias("k")).select("_name", "k.*").filter("key <> ''")
    once = F.col("what").isin("name", "ending")
    names = rows.filter(once).dropDuplicates(["_name", "what", "key", "match"]).select("what", "key", "match")
    return rows.filter(~once).select("what", "key", "match").unionByName(names)


def _ending_lengths(onions: DataFrame, detectors: Sequence[str]) -> list[int]:
    """Lengths of the endings that wildcard names cover: a few numbers."""
    if "D1" not in detectors:
        return []
    wild = onions.select(F.explode("tls_cert_sans").alias("v")).filter("v like '*.%'")
    return sorted(r["n"] for r in wild.select((F.length("v") - 2).alias("n")).distinct().collect() if r["n"] > 0)


def findings(onions: DataFrame, hosts: DataFrame, detectors: Sequence[str] = ALL, dot_boundary: bool = False) -> DataFrame:
    """Findings of the detectors named: one join of all keys.

    D1: a certificate name is a known host (0.95) or a wildcard over its ending (0.90), without a dot before the ending
    unless ``dot_boundary``. D3 leaves common banners out. D4: a status page names a known host. D6 needs four headers.
    """
    left = onion_keys(onions, detectors)
    right = host_keys(hosts, detectors, _ending_lengths(onions, detectors), dot_boundary)
    return left.join(right, ["what", "key"]).select(
        "detector_id", F.col("address").alias("onion_address"), F.col("match").alias("clearnet_match"), "kind", "confidence", "evidence"
    )


def all_findings(onions: DataFrame, hosts: DataFrame) -> DataFrame:
    """Findings of all detectors."""
    return findings(onions, hosts)


def cert_san(onions: DataFrame, hosts: DataFrame, dot_boundary: bool = False) -> DataFrame:
    """D1 alone."""
    return findings(onions, hosts, ["D1"], dot_boundary)


def shared_values(onions: DataFrame, hosts: DataFrame, detectors: Sequence[str] = ALL) -> DataFrame:
    """(detector_id, what, key, side, member): every finding as a value with its members on both sides.

    A value on one side alone is no finding. Rows are linear in the members, also for a value that a third of all hosts
    has; the findings of a value are the pairs of its two sides.
    """
    left = onion_keys(onions, detectors)
    right = host_keys(hosts, detectors, _ending_lengths(onions, detectors))
    forms = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w, _, _ in FORMS if d in detectors])
    members = left.select("detector_id", "what", "key", F.lit("onion").alias("side"), F.col("address").alias("member")).unionByName(
        right.select(F.inline(F.filter(forms, lambda f: f["w"] == F.col("what"))), "key", F.col("match").alias("member"))
        .select(F.col("d").alias("detector_id"), F.col("w").alias("what"), "key", F.lit("host").alias("side"), "member")
    ).distinct()
    # values with both sides, counted before the shuffle
    both = members.groupBy("detector_id", "what", "key").agg(F.count_if(F.col("side") == "onion").alias("n_onions"), F.count_if(F.col("side") == "host").alias("n_hosts"))
    return members.join(both.filter("n_onions > 0 and n_hosts > 0"), ["detector_id", "what", "key"])


def ranked_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("confidence"), "detector_id", "onion_address", "clearnet_match")


def without_exits(seen: DataFrame, exits: DataFrame) -> DataFrame:
    """Rows whose ``ip`` is no known exit address."""
    return seen.join(exits.select("ip").distinct(), "ip", "left_anti")


def favicon_groups(nodes: DataFrame) -> DataFrame:
    """(favicon_hash, id, members): the nodes of every favicon that two or more have; linear in the nodes."""
    kept = nodes.filter("favicon_hash is not null").select("favicon_hash", "id")
    sizes = kept.groupBy("favicon_hash").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return kept.join(sizes, "favicon_hash")


def shared_favicons(nodes: DataFrame, known_edges: DataFrame) -> DataFrame:
    """New SHARES_FINGERPRINT edges between nodes with the same favicon.

    ``nodes``: id, favicon_hash. ``known_edges``: src, dst of edges that exist in either direction.
    """
    a = nodes.filter("favicon_hash is not null")
    b = a.select(F.col("id").alias("dst"), "favicon_hash")
    pairs = a.select(F.col("id").alias("src"), "favicon_hash").join(b, "favicon_hash").filter("src < dst")
    known = known_edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.join(known, ["src", "dst"], "left_anti").withColumn("type", F.lit("SHARES_FINGERPRINT"))
