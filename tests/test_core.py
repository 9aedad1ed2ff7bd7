import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from duskwire.functions import hashing, pages, scores, style, vectors
from duskwire.operators import gates, provenance
from duskwire.streaming.stateful import merkle_root


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


SOURCE = dict(
    source_id="s", source_type="forum", authorization_status="approved", authorization_ref=None, enabled=True,
    retention_days=30, pii_policy="keep", reliability_grade="B",
)


@pytest.mark.parametrize("source,ref,decision,rule", [
    ({}, {}, "allow", None),
    ({"pii_policy": "REDACT_all"}, {}, "redact_allow", None),
    ({"enabled": False}, {}, "block", "source_disabled"),
    ({"authorization_status": "pending"}, {}, "block", "unauthorized"),
    ({"authorization_status": "authorized"}, {}, "block", "missing_auth_ref"),
    ({"authorization_status": "authorized", "authorization_ref": "r"}, {}, "allow", None),
    ({}, {"content_type": "image/jpeg"}, "block", "content_type_blocked"),
    ({}, {"content_type": " Text/HTML ; charset=x"}, "allow", None),
    ({}, {"size_bytes": 100 * 1024 * 1024}, "block", "size_exceeded"),
    ({}, {"url": "http://Bad.example/x"}, "block", "domain_denied"),
    ({"retention_days": 0}, {}, "block", "no_retention"),
])
def test_policy(spark, source, ref, decision, rule):
    from duskwire.schemas import SOURCES

    src = spark.createDataFrame([tuple({**SOURCE, **source}.values())], SOURCES)
    r = {"source_id": "s", "url": "http://ok.example/x", "content_type": "text/plain", "size_bytes": 10, **ref}
    refs = spark.createDataFrame([tuple(r.values())], "source_id string, url string, content_type string, size_bytes long")
    deny = spark.createDataFrame([("bad.example",)], "host string")
    row = gates.policy(refs, src, deny).first()
    assert (row["decision"], row["rule_hit"]) == (decision, rule)
    assert (row["event_id"] is None) == (decision == "block")


@pytest.mark.parametrize("kind,ok", [("text/html", True), ("image/png", False), ("video/mp4", False), ("application/zip", False)])
def test_mime(spark, kind, ok):
    assert one(spark, kind, gates.mime_allowed) is ok


def test_content_gate(spark):
    assert one(spark, "A perfectly clean text about children.", gates.content_allowed) is True
    assert one(spark, "x RECRUITMENT  for terror y", gates.content_allowed) is False
    assert one(spark, "prerecruiting for terror", gates.content_allowed) is True


@pytest.mark.parametrize("text,redacted,summary", [
    ("ID 1234 5678 9012", "ID [AADHAAR_REDACTED]", ["aadhaar:1"]),
    ("tax ABCDE1234F", "tax [PAN_REDACTED]", ["pan:1"]),
    ("call 9876543210", "call [PHONE_REDACTED]", ["phone:1"]),
    ("a@gmail.com b@gmail.com", "[EMAIL_REDACTED] [EMAIL_REDACTED]", ["victim_email:2"]),
    ("v@protonmail.com", "v@protonmail.com", []),
    ("A clean text.", "A clean text.", []),
])
def test_redaction(spark, text, redacted, summary):
    row = gates.redact(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["text"], row["redactions"]) == (redacted, summary)


@pytest.mark.parametrize("url,ok", [
    ("https://example.com/x", True), ("http://abc.onion/", True), ("http://localhost/x", False), ("http://10.0.0.5/", False),
    ("http://127.0.0.1:80/", False), ("http://169.254.169.254/latest", False), ("", False), ("http://172.32.0.1/", True),
])
def test_url_targets(spark, url, ok):
    assert one(spark, url, pages.allowed_target) is ok


def test_url_join(spark):
    from urllib.parse import urljoin

    base = "http://a.onion/x/y/z.html?q=1"
    for href in ["p", "/p/q", "../p", "./p/./q", "//b.onion/r", "http://C.onion/s", "?n=1", "../../../k/", "a/../b"]:
        df = spark.createDataFrame([(base, href)], "b string, h string")
        got = df.select(pages.join_url(F.col("b"), F.col("h"))).first()[0]
        want = urljoin(base, href).split("?")[0].replace("C.onion", "c.onion")
        assert got == want, href


def test_links_keep_suffix(spark):
    html = '<a href="/a/">x</a><A HREF=\'http://b.onion/c?d#e\'>y</A><a href="http://c.example.com">z</a>'
    df = spark.createDataFrame([(html, "http://a.onion/")], "h string, u string")
    assert df.select(pages.links(F.col("h"), F.col("u"))).first()[0] == ["http://a.onion/a", "http://b.onion/c"]


def test_hashes_and_ids(spark):
    assert one(spark, "abc", hashing.content_hash) == "sha256:" + hashlib.sha256(b"abc").hexdigest()
    assert one(spark, "sha256:x:src", hashing.name_uuid) == str(uuid.uuid5(uuid.NAMESPACE_URL, "sha256:x:src"))


@pytest.mark.parametrize("data,value", [(b"", 0), (b"hello", 613153351), (b"hello, world", 345750399), (b"The quick brown fox jumps over the lazy dog", 776992547)])
def test_murmur_known_values(spark, data, value):
    df = spark.createDataFrame([(data,), (b"padding to a longer row than the others",), (None,)], "b binary")
    got = [r[0] for r in df.select(hashing.favicon_hash32("b")).collect()]
    assert got[0] == value and got[2] is None


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 100, 101, 250])
def test_merkle(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    rows = [("sha256:" + h, f"{i:04d}", i) for i, h in enumerate(leaves)]
    ev = spark.createDataFrame(rows, "content_hash string, evidence_id string, t long").withColumn("collected_at", F.timestamp_seconds("t"))
    assigned = provenance.assign_batches(ev)
    batches = provenance.merkle_batches(assigned)
    got = {r["batch_no"]: (r["leaf_count"], r["root_hash"]) for r in batches.collect()}
    want = {b: (len(leaves[b * 100:b * 100 + 100]), "sha256:" + merkle_root(leaves[b * 100:b * 100 + 100])) for b in range((n + 99) // 100)}
    assert got == want
    assert all(r["ok"] for r in provenance.verify(assigned, batches).collect())
    tampered = assigned.withColumn("content_hash", F.when(F.col("pos") == 0, "sha256:00").otherwise(F.col("content_hash")))
    assert not any(r["ok"] for r in provenance.verify(tampered, batches).collect())


def plain_batches(times, size, timeout):
    """(first, after, closed): the clock of a batch starts when the one before it closed."""
    out, i, began = [], 0, times[0]
    while i < len(times):
        j = i
        while j < len(times) and j - i + 1 < size and times[j] < began + timeout:
            j += 1
        out.append((i, min(j + 1, len(times)), j < len(times)))
        began = times[min(j, len(times) - 1)]
        i = j + 1
    return out


@pytest.mark.parametrize("range_rows", [5, 16, 1000])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_batches_by_size_and_time(spark, range_rows, seed):
    """Chains cross ranges of any size; equal times, long pauses and a rest that stays open."""
    import random

    r = random.Random(seed)
    times = sorted(r.choice([r.randrange(300), 400 + r.randrange(40), 900 + 2 * r.randrange(500)]) for _ in range(150))
    ev = spark.createDataFrame([(t, f"{i:04d}") for i, t in enumerate(times)], "t long, evidence_id string").withColumn("collected_at", F.timestamp_seconds("t"))
    rows = provenance.assign_timed_batches(ev, 5, 20, range_rows=range_rows).orderBy("evidence_id").collect()
    want = []
    for n, (a, b, closed) in enumerate(plain_batches(times, 5, 20)):
        want += [(n, i - a, closed) for i in range(a, b)]
    assert [(x["batch_no"], x["pos"], x["closed"]) for x in rows] == want


def test_timed_batches_of_nothing(spark):
    ev = spark.createDataFrame([], "evidence_id string, collected_at timestamp")
    assert provenance.assign_timed_batches(ev).collect() == []


def test_root_of_peaks(spark):
    for n in range(1, 22):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        peaks, lo = [], 0
        for bit in range(n.bit_length() - 1, -1, -1):
            if n >> bit & 1:
                peaks.append(merkle_root(leaves[lo : lo + (1 << bit)]))
                lo += 1 << bit
        df = spark.createDataFrame([(n, peaks)], "n long, p array<string>")
        assert df.select(provenance.root_of_peaks(F.col("n"), F.col("p"), 21)).first()[0] == merkle_root(leaves)


def test_single_leaf_is_root():
    assert merkle_root(["sha256:ab"]) == "ab"


@pytest.mark.parametrize("score,band", [(95, "VERY_HIGH"), (80, "HIGH"), (60, "MODERATE"), (30, "LOW"), (10, "WEAK")])
def test_bands(spark, score, band):
    assert spark.range(1).select(scores.band(F.lit(score))).first()[0] == band


def test_cosine_of_zero_vector(spark):
    assert spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] == 0.0


def test_style_features(spark):
    text = "The cat! The dog... Is it 42? Yes"
    v = spark.createDataFrame([(text,)], "t string").select(style.feature_vector(F.col("t"))).first()[0]
    at = lambda n: v[style.slot(n)]
    assert len(v) == len(style.FEATURES) == 89
    assert at("fw_the") == 2 / 8 and at("excl_density") == 1 / len(text) and at("ellipsis_count") == 1 / len(text)
    assert at("avg_sentence_length") == 2.0 and at("uppercase_ratio") == 4 / len(text) and at("digit_ratio") == 2 / len(text)


def test_char_grams(spark):
    got = spark.range(1).select(style.char_grams(F.lit("ab"))).first()[0]
    assert got == [" ab", "ab ", " ab "]
    assert spark.range(1).select(style.char_grams(F.lit("a"))).first()[0] == [" a "]


def test_robots(spark):
    text = "User-agent: other\nDisallow: /x\nUser-agent: *\nDisallow: /private\nDisallow:\n"
    rules = gates.robots_rules(spark.createDataFrame([("a.onion", text)], "domain string, text string"), "ours")
    urls = spark.createDataFrame([("http://a.onion/x",), ("http://a.onion/private/1",), ("http://b.onion/private",)], "url string")
    assert {r["url"] for r in gates.robots_allowed(urls, rules).collect()} == {"http://a.onion/x", "http://b.onion/private"}


def test_prohibited_text_far_into_a_page_is_found(spark):
    from pyspark.sql import functions as F

    from duskwire.operators import gates

    df = spark.createDataFrame([("x " * 300_000 + "recruiting for terror",), ("x " * 300_000,)], "text string")
    assert [r.ok for r in df.select(gates.content_allowed(F.col("text")).alias("ok")).collect()] == [False, True]


def test_unregistered_source_keeps_its_decision(spark):
    from duskwire.operators import gates

    refs = spark.createDataFrame([("s9", "http://a.example/", "text/html", 10)], "source_id string, url string, content_type string, size_bytes long")
    sources = spark.createDataFrame(
        [], "source_id string, authorization_status string, authorization_ref string, enabled boolean, retention_days int, pii_policy string"
    )
    row = gates.policy(refs, sources).first()
    assert (row.decision, row.rule_hit, row.event_id) == ("block", "unknown_source", None)
