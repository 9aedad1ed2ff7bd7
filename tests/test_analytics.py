import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duskwire import schemas
from duskwire.functions.handles import handle_ratio, ratio_bound
from duskwire.operators import clocks, evidence, infra, metrics, rebrand, resolve, stylometry
from duskwire.sources import feeds, readers

ITEM = "pair_id string, evidence_type string, lr double, reliability string, credibility int"


def score(spark, *items):
    rows = [("p", *i) for i in items]
    return evidence.score_links(spark.createDataFrame(rows, ITEM), ["pair_id"]).first()


def test_key_alone_is_even_odds(spark):
    r = score(spark, ("pgp_fingerprint", None, "A", 1))
    assert (r["score"], r["band"], r["analyst_status"]) == (50.0, "MODERATE", "pending")


def test_weak_evidence_stays_low(spark):
    assert score(spark, ("temporal_overlap", None, "C", 4))["score"] < 50
    assert score(spark, ("pgp_fingerprint", None, "F", 1))["score"] < 10
    assert score(spark, ("pgp_fingerprint", 0.0, "A", 1))["score"] == 0.1


def test_three_families_agree(spark):
    r = score(spark, ("contact_id", None, "B", 2), ("wallet_cluster", None, "B", 2), ("stylometry", None, "C", 3))
    assert r["score"] >= 50 and r["why"][0] == "Same contact identifier" and len(r["why"]) == 3


def test_damping_and_caps(spark):
    rows = [("p", "favicon", None, "A", 1), ("p", "favicon", None, "A", 1), ("p", "banner", None, "A", 1), ("p", "handle_exact", None, "A", 1), ("p", "odd", 9.0, "Z", 9)]
    fam = {r["family"]: r for r in evidence.by_family(evidence.adjust(spark.createDataFrame(rows, ITEM)), ["pair_id"]).collect()}
    assert fam["infra"]["family_llr"] == pytest.approx(math.log(30) + 0.5 * (math.log(30) + math.log(3)))
    assert fam["handle"]["family_llr"] == 3.0 and fam["handle"]["capped"]
    r = score(spark, ("handle_exact", None, "A", 1))
    assert r["warnings"] == ["handle evidence capped at 3.00 (was 3.40) to prevent inflation"]


T0 = datetime(2024, 6, 1)


def actor(name, first, last, pgp=(), wallets=(), contacts=(), handles=None, style=None):
    return (name, name, T0 + timedelta(days=first), T0 + timedelta(days=last), "active", list(pgp), list(wallets), list(contacts), list(handles or [name]), style)


def frame(spark, *actors):
    return spark.createDataFrame(list(actors), schemas.PROFILE)


def at():
    return F.lit(T0 + timedelta(days=60))


def test_rebrand_alert(spark):
    df = frame(
        spark,
        actor("OldFox", -100, 10, ["K1"], ["w1"], ["@fox"], ["OldFox"], [1.0, 2.0]),
        actor("NewFox", 20, 58, ["K1"], ["w1"], ["@fox"], ["NewFox"], [1.0, 2.1]),
        actor("Other", 25, 59, ["K2"], [], [], ["zzz"]),
        actor("Late", 56, 59, ["K1"], [], [], ["late"]),
    )
    alerts = rebrand.detect(df, at()).collect()
    assert [(a["old_id"], a["new_id"]) for a in alerts] == [("OldFox", "NewFox")]
    a = alerts[0]
    assert a["score"] >= 90 and a["why"][0] == "Same PGP fingerprint" and a["alert_type"] == "persona_migration"
    cand = {(r["old_id"], r["new_id"]): (r["dormancy_days"], r["gap_days"]) for r in rebrand.candidates(df, at()).collect()}
    assert cand == {("OldFox", "NewFox"): (50, 10), ("OldFox", "Other"): (50, 15)}


def test_blank_identifiers_are_not_shared(spark):
    df = frame(spark, actor("a", -50, 10, [""], [], [""]), actor("b", 20, 59, [""], [], [""]))
    assert rebrand.linked_candidates(df, at()).count() == 0
    kinds = [r["evidence_type"] for r in rebrand.pair_evidence(rebrand.candidates(df, at()), df).collect()]
    assert kinds == ["temporal_overlap"]


def test_identifier_plan_finds_the_alerts_of_all_pairs(spark):
    people = []
    for i in range(12):
        people.append(actor(f"o{i}", -80 + i, i, [f"K{i % 5}"], [f"w{i % 3}"], [f"@c{i % 4}"], [f"handle{i}"]))
        people.append(actor(f"n{i}", i + 3, 50 + i % 10, [f"K{i % 4}"], [f"w{i % 3}"], [f"@c{i % 5}"], [f"handle{i}x"]))
    df = frame(spark, *people)
    fast = {(r["old_id"], r["new_id"]): r["score"] for r in rebrand.detect(df, at()).collect()}
    full = {(r["old_id"], r["new_id"]): r["score"] for r in rebrand.score_all(df, at()).collect() if r["score"] >= 75}
    assert fast == full and fast
    unlinked = rebrand.candidates(df, at()).join(rebrand.linked_candidates(df, at()), rebrand.PAIR, "left_anti")
    scored = evidence.score_links(rebrand.pair_evidence(unlinked, df), rebrand.PAIR)
    assert scored.agg(F.max("score")).first()[0] <= rebrand.unlinked_bound() < rebrand.ALERT_SCORE


def test_co_activity(spark):
    a, b = T0, T0 + timedelta(days=10)
    row = spark.range(1).select(
        rebrand.co_active(F.lit(a), F.lit(b), F.lit(a + timedelta(days=6)), F.lit(b)).alias("four"),
        rebrand.co_active(F.lit(a), F.lit(b), F.lit(a + timedelta(days=7)), F.lit(b)).alias("three"),
    ).first()
    assert row["four"] and not row["three"]


def test_handle_ratio(spark):
    """Matching blocks, ties, empty strings, letter case, and strings so long that frequent characters begin no block."""
    from difflib import SequenceMatcher

    r = random.Random(1)
    pairs = [("ShadowX", "shadow_x"), ("abc", "xyz"), ("a", "a"), ("", ""), ("", "a"), ("aab", "baa"), ("ñandú", "NANDÚ")]
    for _ in range(250):
        letters = r.choice(["ab", "abcd", "abcdefghij_0123"])
        a, b = ("".join(r.choice(letters) for _ in range(r.randrange(26))) for _ in "ab")
        pairs.append((a.upper(), b[:3] + a[4:]) if r.random() < 0.5 else (a, b))
    for n in (199, 200, 230):
        b = "".join(r.choice("abcdefgh" * 9 + "xyzuvw") for _ in range(n))
        pairs += [("".join(r.choice("abcdefgh") for _ in range(40)) + b[40:70], b), (b, b[5:25])]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    rows = df.select("a", "b", handle_ratio(F.col("a"), F.col("b")).alias("r"), ratio_bound(F.col("a"), F.col("b")).alias("bound")).collect()
    assert len(rows) == len(pairs)
    for x in rows:
        assert x["r"] == SequenceMatcher(None, x["a"].lower(), x["b"].lower()).ratio() <= x["bound"] + 1e-12, x
    assert spark.sql("select cast(null as string) a, 'x' b").select(handle_ratio(F.col("a"), F.col("b"))).first()[0] is None


def test_ratios_of_many_pairs():
    """The same blocks as one pair at a time, in lots of any size, also in long strings and beyond the basic plane."""
    from difflib import SequenceMatcher

    from duskwire.functions.handles import pair_ratios

    r = random.Random(4)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    pairs = [("", ""), ("", "a"), ("a", ""), ("aab", "baa"), ("a\0", "a"), ("a\0b\0", "\0b")]
    pairs += [(word(k, r.randrange(30)), word(k, r.randrange(30))) for k in ("ab", "abcd", "aé日😀_0", "abcdefghij_0123") for _ in range(150)]
    for n in (199, 200, 260):
        b = word("abcdefgh" * 9 + "xyzuvw", n)
        pairs += [(word("abcdefgh", 40) + b[40:70], b), (b, b[5:25]), (b[:60] + "x" + b[60:], b)]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    for lot in (1, 7, 4096):
        assert pair_ratios(*zip(*pairs), lot) == want
    assert pair_ratios(["a", None, "ab"], [None, "a", "ab"]) == [None, None, 1.0] and pair_ratios([], []) == []


def test_alerts_read_profiles_four_times_and_need_no_python(spark):
    df = frame(spark, actor("OldFox", -100, 10, ["K1"], [], ["@fox"]), actor("NewFox", 20, 58, ["K1"], [], ["@fox"]))
    plan = rebrand.detect(df, at())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and "Python" not in plan


def test_sharing_pairs(spark):
    df = frame(spark, actor("a", 0, 1, ["K", ""], ["w", "v"], ["@c"]), actor("b", 0, 1, ["K", "K"], ["v"], []), actor("c", 0, 1, [], ["v", "w"], ["@d", ""]))
    got = {tuple(r) for r in resolve.sharing_pairs(df).collect()}
    assert got == {("a", "b", 1, 0, 1), ("a", "c", 0, 0, 2), ("b", "c", 0, 0, 1)}


ONION = ("x.onion", ["Shop.example.com", "*.corp.net"], "fp", "fav", "Custom/9 ", {}, ["A", "B", "C", "D"], "ssh", "err", "ServerName: leak.example.com\nhostname='gone'")


def host(name, **kw):
    base = dict(sans=[], fp=None, fav=None, banner=None, headers={}, order=[], ssh=None, err=None)
    return (name, *{**base, **kw}.values())


def test_detectors(spark):
    onions = spark.createDataFrame([ONION], schemas.ONION)
    hosts = spark.createDataFrame([
        host("shop.example.com"), host("a.corp.net"), host("xcorp.net"), host("f", fav="fav"), host("b", banner="custom/9"),
        host("n", banner="nginx"), host("leak.example.com"), host("s", ssh="ssh"), host("h", order=["a", "b", "c", "d"]), host("h3", order=["a", "b", "c"]), host("e", err="err"),
    ], schemas.HOST)
    rows = infra.ranked_findings(infra.all_findings(onions, hosts)).collect()
    assert [(r["detector_id"], r["clearnet_match"], r["confidence"]) for r in rows] == [
        ("D5", "s", 0.98), ("D1", "shop.example.com", 0.95), ("D1", "a.corp.net", 0.9), ("D1", "xcorp.net", 0.9),
        ("D4", "leak.example.com", 0.85), ("D2", "f", 0.7), ("D7", "e", 0.55), ("D3", "b", 0.45), ("D6", "h", 0.4),
    ]
    loose = {r["clearnet_match"] for r in infra.cert_san(onions, hosts).collect()}
    strict = {r["clearnet_match"] for r in infra.cert_san(onions, hosts, dot_boundary=True).collect()}
    assert loose - strict == {"xcorp.net"}


def test_common_banner_is_noise(spark):
    onions = spark.createDataFrame([("x.onion", [], None, None, "NGINX", {}, [], None, None, None)], schemas.ONION)
    assert infra.all_findings(onions, spark.createDataFrame([host("n", banner="nginx")], schemas.HOST)).count() == 0


def test_skew_pairs(spark):
    rows = [(u, T0 + timedelta(hours=i), s) for u, s, n in [("a", 1.0, 25), ("b", 1.5, 12), ("c", 1.5000001, 3), ("d", 1.0, 2), ("e", 9.0, 5)] for i in range(n)]
    prof = clocks.skew_profiles(spark.createDataFrame(rows, schemas.PROBES))
    assert {r["url"]: r["samples"] for r in prof.collect()} == {"a": 20, "b": 12, "c": 3, "e": 5}
    pairs = {(r["url_a"], r["url_b"]): r["confidence"] for r in clocks.skew_pairs(prof).collect()}
    assert pairs == {("a", "b"): 0.0, ("b", "c"): 0.3}


def test_feed_fallbacks(spark):
    rows = [('{"url": "http://x.onion/a", "date_added": "2024-01-02 03:04:05"}',), ('{"url": "http://y.com", "date_added": "bad"}',), ("{oops",)]
    df = spark.createDataFrame(rows, "value string")
    now = F.lit(T0)
    got = {r["url"]: (r["observed_at"], r["is_onion"]) for r in feeds.normalize(df, feeds.FEEDS["feed_url"], now).collect()}
    assert got == {"http://x.onion/a": (datetime(2024, 1, 2, 3, 4, 5), True), "http://y.com": (T0, False)}
    assert [r["value"] for r in feeds.bad_records(df, feeds.FEEDS["feed_url"].schema).collect()] == ["{oops"]
    env = feeds.envelope(feeds.normalize(df, feeds.FEEDS["feed_url"], now), "src_url")
    assert env.columns == [c.split()[0] for c in schemas.RAW_EVENT.split(", ")]


def test_bad_messages(spark):
    good = '{"source_id":"s","adapter_type":"replay","mode":"live","content_type":"text","observed_at":"2024-01-01T00:00:00Z","content_hash":"x"}'
    rows = [good, "{", good.replace('"s"', '""'), good.replace("replay", "pigeon"), good.replace("live", "dead")]
    dec = readers.decode_events(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert [r["error"] for r in dec.collect()] == [None, "invalid json", "missing source_id", "unknown adapter_type", "unknown mode"]
    assert readers.good_events(dec).count() == 1 and readers.dead_letters(dec, "raw").count() == 4


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "forums").mkdir()
    (tmp_path / "forums" / "a.html").write_text("<p>vendor: Joe " + "text " * 20 + "</p>")
    (tmp_path / "forums" / "b.html").write_text("<p>short</p>")
    out = readers.archive(readers.archive_files(spark, str(tmp_path)), root=str(tmp_path)).collect()
    assert [(r["path"], r["category"], r["entities"]["vendor_handles"]) for r in out] == [("forums/a.html", "forums", ["Joe"])]


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", "b", "easy"), ("c", "d", "easy"), ("e", "f", "decoy")], "old_id string, new_id string, difficulty string")
    scored = spark.createDataFrame([("a", "b", 80.0), ("c", "d", 20.0), ("e", "f", 60.0)], "old_id string, new_id string, score double")
    got = {r["difficulty"]: (r["tp"], r["fp"], r["fn"], r["recall"], r["avg_score"]) for r in metrics.evaluate_pairs(truth, scored).collect()}
    assert got == {"easy": (1, 0, 1, 0.5, 50.0), "decoy": (0, 1, 0, 0.0, 60.0)}


def test_similar_texts_score_higher(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat and the dog"), (2, "the cat sat on the mat and the cow"), (3, "QUANTUM! FLUX? 99 zebras")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    for vectors in (stylometry.tfidf(*stylometry.char_model(docs, 3)),):
        s = {r["b"]: r["similarity"] for r in stylometry.sparse_similarity(vectors, pairs).collect()}
        assert s[2] > 0.7 > s[3] >= 0
    rows = stylometry.feature_rows(docs)
    z = stylometry.standardise(rows, stylometry.fit_scaler(rows))
    s = {r["b"]: r["similarity"] for r in stylometry.dense_similarity(z, pairs, "doc_id", "features", clip=True).collect()}
    assert s[2] > s[3] and s[3] == 0.0


def test_sharing_pairs_of_copies_are_not_shuffled(spark):
    rows = [actor(f"n{i:02d}", i, i + 1, ["K"], ["w"] if i % 2 else [], [f"@{i % 3}"]) for i in range(30)] + [actor("lone", 0, 1, [], [], [])]
    df = frame(spark, *rows)
    out = resolve.sharing_pairs(df, keep=["handle"], chunk=4)
    got = {(r["a"], r["b"]): (r["pgp"], r["contacts"], r["wallets"]) for r in out.collect()}
    assert out.count() == len(got)
    assert got == {(f"n{i:02d}", f"n{j:02d}"): (1, int(i % 3 == j % 3), i % 2 * (j % 2)) for i in range(30) for j in range(i + 1, 30)}
    names = {r["actor_id"]: r["handle"] for r in df.collect()}
    assert all(r["a_handle"] == names[r["a"]] and r["b_handle"] == names[r["b"]] for r in out.collect())
    # nothing is grouped or exchanged behind the explosion into pairs of actors, which the plan lists from the top
    plan = resolve.sharing_pairs(df)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first_generate = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert not any("Aggregate" in line or "Join" in line for line in plan[:first_generate])
