"""Rows that are crowded or long keep everything."""
import json

import pytest
from pyspark.sql import functions as F

from duskwire.functions import fixed, pages
from duskwire.functions import identifiers as ids
from duskwire.operators import gates, resolve, wallets
from duskwire.sources import feeds, readers
from duskwire.streaming import jobs

SF = "/root/testdata/sf0.001"


def first(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def test_page_lists_are_whole(spark):
    text = " ".join(f"m{i:02d}@example{i:02d}.com vendor: v{i:02d}" for i in range(30))
    assert len(first(spark, text, ids.page_entities)["emails"]) == 30
    got = first(spark, text, ids.archive_entities)
    assert len(got["emails"]) == 30 and len(got["vendor_handles"]) == 30
    assert len(first(spark, text, lambda t: ids.page_entities(t, limit=4))["emails"]) == 4


def test_links_titles_and_generators_are_whole(spark):
    html = "<title>" + "x" * 300 + "</title>" + " " * 12_000 + '<meta name="generator" content="Hugo">'
    html += "".join(f'<a href="http://h{i:02d}.onion/">' for i in range(60))
    assert len(first(spark, html, lambda h: pages.links(h, F.lit("http://a.onion/")))) == 60
    assert first(spark, html, pages.title) == "x" * 300
    assert first(spark, html, pages.generator) == "Hugo"


def test_content_gate_reads_to_the_end(spark):
    assert first(spark, "a " * 260_000 + "child abuse", gates.content_allowed) is False


def test_addresses_of_many_transactions(spark):
    eth = {"address": "0xA", "transactions": [{"from": "0xa", "to": f"0xb{i:02d}"} for i in range(40)]}
    spend = [{"txid": "t", "vin": [{"prevout": {"scriptpubkey_address": f"bc{i:02d}"}} for i in range(40)]}]

    def run(name, record):
        landed = spark.createDataFrame([(json.dumps(record),)], "value string")
        return feeds.normalize(landed, feeds.FEEDS[name], F.lit("2024-01-01").cast("timestamp")).first()

    assert len(run("feed_eth", eth)["interacting_addresses"]) == 40
    assert len(run("feed_btc", {"address": "bc00", "transactions": spend})["co_spent_addresses"]) == 39


def test_lookups_of_a_crowded_event(spark):
    text = " ".join(f"10.0.0.{i}" for i in range(30))
    posts = spark.createDataFrame([("e", "s", "someone", text)], "event_id string, source_id string, handle string, text string")
    ingested = jobs.ingest(posts)
    assert jobs.lookup_requests(ingested).filter("queue = 'ip'").count() == 30
    assert jobs.lookup_requests(ingested, {"ip": 7}).filter("queue = 'ip'").count() == 7


def test_clusters_with_one_long_prefix_stay_apart(spark):
    rows = [(f"t{i}", p, f"{'p' * 20}{i}{p}") for i in range(2) for p in range(2)]
    clusters, _ = wallets.co_spent_clusters(spark.createDataFrame(rows, "txid string, pos int, address string"))
    assert clusters.count() == 2


def test_armor_lines_are_no_handles(spark):
    text = "-----BEGIN PGP PUBLIC KEY BLOCK-----\nabc\n-----END PGP PUBLIC KEY BLOCK-----\n-- Red Fox\n--dash\n--- rule"
    assert [h["normalized"] for h in first(spark, text, ids.handle)] == ["red fox", "dash"]


def test_wallets_keep_their_currency(spark):
    text = "0x" + "ab" * 20 + " T" + "9" * 33
    events = spark.createDataFrame([("e", "s", "someone", text)], "event_id string, source_id string, handle string, text string")
    hits = resolve.extract_hits(events.withColumn("observed_at", F.lit("2024-01-01").cast("timestamp")))
    got = {r["currency"] for r in resolve.entity_spans(hits).filter("kind = 'wallet'").collect()}
    assert got == {"ETH", "TRON"}


def test_candidates_leave_the_chunk_join_unshuffled(spark):
    """Pairs of the window carry their spans out of the join: no other join lies above it."""
    from duskwire.plans import q_persona
    from duskwire.plans.inputs import derived

    for df in (q_persona.rb_candidates(spark, SF), q_persona.jn_rebrand(spark, SF)):
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert "_chunk" in joins[0]
    people = derived(spark, SF, "personas")
    assert people.count() > 0


def test_candidates_work_out_little_for_each_pair(spark):
    """What holds for all pairs of the window is not asked of each, and an old persona's dormancy is worked out before the join."""
    from duskwire.plans import q_persona

    plan = q_persona.rb_candidates(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("_chunk")]
    assert "gap_days" in top and "old_first" not in plan and "new_last" not in plan and "interval" not in top.lower().replace("interval#", "")
    assert plan.count("AS dormancy_days") == 0 or plan.index("AS dormancy_days") > plan.index("Join")


def test_interval_chunks_grow_with_the_points(spark):
    """An interval over all points is dealt ``most_chunks`` times, however many points there are, and columns come along."""
    from duskwire.operators import intervals

    points = spark.range(500).select(F.concat(F.lit("p"), "id").alias("pid"), F.col("id").alias("at"), (F.col("id") * 2).alias("twice"))
    spans = spark.createDataFrame([("a", 0, 499), ("b", 10, 11)], "sid string, lo long, hi long")
    got = intervals.within(points, spans, F.col("at"), F.col("lo"), F.col("hi"), "pid", "sid").collect()
    assert len(got) == 502 and all(r["twice"] == 2 * int(r["pid"][1:]) and r["lo"] <= r["at"] <= r["hi"] for r in got)
    ranks, ends = intervals.ranked(points.select(F.col("pid").alias("id"), "at"), spans.withColumnRenamed("sid", "id"))
    assert intervals.pairs(ranks, ends, 1, 4).count() == 502
    ids = intervals.pairs(ranks, ends, 1, 4).select("interval", "point").distinct().count()
    assert ids == 502


def test_evaluation_lists_no_pairs_without_evidence(spark, monkeypatch):
    """The evaluation stays linear: candidates of one customer, decoys with a score, and whether there are others."""
    from duskwire.operators import rebrand
    from duskwire.plans import q_persona

    cand = rebrand.candidates
    monkeypatch.setattr(rebrand, "candidates", lambda *a, **k: pytest.fail("lists all pairs"))
    got = {r["difficulty"]: r for r in q_persona.agg_eval_rebrand(spark, SF).collect()}
    p = q_persona.derived(spark, SF, "personas")
    who = lambda c: F.split(c, "-")[0]
    pairs = cand(p, q_persona.at()).join(q_persona.rb_scores(spark, SF), rebrand.PAIR, "left").withColumn("same", who("old_id") == who("new_id")).collect()
    kinds = {("decoy" if not r["same"] else "easy" if r["gap_days"] < 20 else "hard") for r in pairs}
    assert set(got) == kinds
    assert sum(r["tp"] + r["fn"] for r in got.values()) == sum(r["same"] for r in pairs)
    assert got["decoy"]["fp"] == sum(not r["same"] and (r["score"] or 0) >= 50 for r in pairs)


def test_host_keys_are_counted_behind_the_spread(spark):
    """No task lists or counts the keys of a whole file of hosts: hosts are dealt by name before they become keys."""
    from duskwire.operators import infra

    rows = [("A.example", "f1"), ("a.example", "f1"), ("a.EXAMPLE", "f2"), ("b.example", "f1"), (None, "f1")]
    hosts = spark.createDataFrame(rows, "host string, favicon_hash string")
    keys = infra.host_keys(hosts, ["D1", "D2"], [7])
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Aggregate" not in plan[plan.rindex("RepartitionByExpression"):]
    got = sorted((r["what"], r["key"], r["match"] or "-") for r in keys.collect())
    assert got == sorted([
        ("name", "a.example", "a.example"), ("name", "b.example", "b.example"), ("ending", "example", "a.example"), ("ending", "example", "b.example"),
        ("favicon_hash", "f1", "A.example"), ("favicon_hash", "f1", "a.example"), ("favicon_hash", "f2", "a.EXAMPLE"), ("favicon_hash", "f1", "b.example"), ("favicon_hash", "f1", "-"),
    ])


def test_equal_handles_are_compared_once(spark, tmp_path, monkeypatch):
    """Three copies of all customers and suppliers make nine times the pairs from the same comparisons."""
    from duskwire.plans import q_text

    c = spark.createDataFrame([(i + k * 100, f"C{i}", i % 2, "M") for i in range(20) for k in range(3)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    s = spark.createDataFrame([(i + k * 100, f"S{i}", i % 2) for i in range(10) for k in range(3)], "s_suppkey long, s_name string, s_nationkey int")
    c.write.parquet(f"{tmp_path}/customer.parquet")
    s.write.parquet(f"{tmp_path}/supplier.parquet")
    compared = []
    cut = q_text.cut_lineage
    monkeypatch.setattr(q_text, "cut_lineage", lambda df, label: (out := cut(df, label), compared.append(out.count()))[0])
    rows = q_text.handle_ratio_pairs(spark, str(tmp_path)).collect()
    assert len(rows) == 9 * 20 == len({(r["c_custkey"], r["s_suppkey"]) for r in rows}) and compared == [20]


def test_archived_pages_are_stripped_and_searched_once(spark):
    texts = [
        " a\t\tb  c d \n e  f  ", "x  y  z", "<p>one</p><script>no</script>two <style a>b</style>", "none", "", None,
        "to a@b.co+d@e.fr and\nm@n.op\tq@r.st 1BoatSLRHtKNngkdXEeobR76b53LETtpyT,", "VENDOR : bob Shop:amy seller x", "shop:vendor: v",
        "-----BEGIN PGP PUBLIC KEY BLOCK----- k -----END PGP PUBLIC KEY BLOCK----- and -----BEGIN PGP PUBLIC KEY BLOCK-----",
    ]
    df = spark.createDataFrame([(f"c/{i}", t) for i, t in enumerate(texts)], "path string, html string")
    plain = F.col("html")
    for pattern, by in ((r"(?s)<script[^>]*>.*?</script>", ""), (r"(?s)<style[^>]*>.*?</style>", ""), (r"<[^>]+>", " "), (fixed.SPACE + "+", " ")):
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(by))
    assert df.filter(~F.trim(plain).eqNullSafe(pages.strip_html(F.col("html")))).count() == 0
    whole = {
        "btc_addresses": ids.ranked(ids.find_all(F.col("html"), fixed.ARCHIVE_BTC)), "emails": ids.ranked(ids.find_all(F.col("html"), fixed.LOOSE_EMAIL)),
        "vendor_handles": ids.ranked(ids.find_all(F.col("html"), fixed.ARCHIVE_VENDOR, 1)),
        "pgp_key_hashes": F.transform(ids.find_all(F.col("html"), f"(?s){fixed.PGP_BLOCK}"), lambda b: F.substring(F.sha2(b, 256), 1, 16)),
    }
    found = df.select("html", ids.archive_entities(F.col("html")).alias("e"))
    for name, want in whole.items():
        assert found.filter(~want.eqNullSafe(F.col(f"e.{name}"))).count() == 0, name
    plan = readers.archive(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]+>") == 1 and plan.count(fixed.ARCHIVE_BTC) == 1


def test_texts_are_looked_through_for_digits_once(spark):
    """Also in the order of rules: what one leaves behind is what the next one sees."""
    texts = ["call +91 98765 43210 or (0123) 456 7890", "1234 5678 9012 ABCDE1234F a@b.co", "no digits", "", None, "x@y.org 12", "+1 12 (345 678 901"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain, found = F.col("t"), []
    for name, pattern, by in fixed.REDACTION_RULES:
        pattern = pattern.removeprefix(r"(?=[+(\p{Nd}])")
        found.append(F.when(F.regexp_count(plain, F.lit(pattern)) > 0, F.concat(F.lit(f"{name}:"), F.regexp_count(plain, F.lit(pattern)).cast("string"))))
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(by))
    rows = df.select(gates.redacted(F.col("t")).alias("r"), plain.alias("text"), F.array_compact(F.array(*found)).alias("found")).collect()
    assert all(r["r"]["text"] == r["text"] and r["r"]["found"] == r["found"] for r in rows)
    assert {f.split(":")[0] for r in rows for f in r["found"]} == {name for name, _, _ in fixed.REDACTION_RULES}
    plan = df.select(gates.redacted(F.col("t"))["text"].alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") + plan.count("rlike") == 1


def test_lists_of_lengths_are_made_once(spark):
    from duskwire.functions import style

    df = spark.createDataFrame([("One two. Three, FOUR five! 12",), ("",)], "t string")
    plan = df.select(style.feature_vector(F.col("t")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[.!?]+") == 1
    row = df.select(style.feature_vector(F.col("t")).alias("v")).first()["v"]
    assert row[style.slot("avg_sentence_length")] == 2.0 and abs(row[style.slot("uppercase_ratio")] - 6 / 29) < 1e-12
