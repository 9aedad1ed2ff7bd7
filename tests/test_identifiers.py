import pytest
from pyspark.sql import functions as F

from duskwire.functions import identifiers as ids

BECH = "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq"
KEY = "ABCD1234" * 5


def hits(spark, fn, text, **kw):
    df = spark.createDataFrame([(text,)], "text string")
    return [r["h"] for r in df.select(F.explode(fn(F.col("text"), **kw)).alias("h")).collect()]


@pytest.mark.parametrize("offsets", [False, True])
@pytest.mark.parametrize("text,expected", [
    ("My PGP: " + KEY, [KEY]),
    ("PGP: ABCD 1234 ABCD 1234 ABCD 1234 ABCD 1234 ABCD 1234", [KEY]),
    ("PGP: " + KEY.lower(), [KEY]),
    ("fingerprint: " + KEY, [KEY]),
    ("fpr " + KEY.lower(), [KEY]),
    ("key\t" + KEY + "\nend", [KEY]),
    ("-----BEGIN PGP PUBLIC KEY BLOCK-----\nkey data\n-----END PGP PUBLIC KEY BLOCK-----", ["KEY_BLOCK_DETECTED"]),
    ("The hash is ABCD1234", []),
    ("x" + KEY, []),
])
def test_pgp(spark, text, expected, offsets):
    assert [h["normalized"] for h in hits(spark, ids.pgp, text, offsets=offsets)] == expected


@pytest.mark.parametrize("offsets", [False, True])
@pytest.mark.parametrize("text,currency", [
    ("Send to " + BECH, "BTC"),
    ("Send to " + BECH.upper(), "BTC"),
    ("BTC: 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "BTC"),
    ("P2SH 3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy.", "BTC"),
    ("ETH: 0x742d35Cc6634C0532925a3b844Bc9e7595f2bD38", "ETH"),
    ("USDT TRC20: TJCnKsPa7y5okkXvQAidZBzqx3QyQ6sxMW", "TRON"),
    ("XMR: 4" + "A" * 94, "XMR"),
])
def test_wallets(spark, text, currency, offsets):
    found = hits(spark, ids.wallet, text, offsets=offsets)
    assert [h["metadata"]["currency"] for h in found] == [currency]
    if currency == "XMR":
        assert found[0]["metadata"]["traceable"] == "false"
    if currency == "ETH":
        assert found[0]["normalized"] == found[0]["value"].lower()


def test_short_hex_is_no_wallet(spark):
    assert hits(spark, ids.wallet, "The temperature is 0x42 degrees.") == []


@pytest.mark.parametrize("text,expected", [
    ("Contact me at user@example.com", ["user@example.com"]),
    ("Reach: Dealer@ProtonMail.com.", ["dealer@protonmail.com"]),
    ("Main: a@b.com, Alt: c@d.org", ["a@b.com", "c@d.org"]),
    ("éa.bc@d.org", [".bc@d.org"]),
    ("(é a@b.com)", ["a@b.com"]),
    ("a@b.comé", []),
    ("no at here", []),
])
def test_emails(spark, text, expected):
    assert [h["normalized"] for h in hits(spark, ids.email, text)] == expected
    assert [h["normalized"] for h in hits(spark, ids.email, text, offsets=True)] == expected


def test_domains(spark):
    text = "see shop1.market and big.com, mail me@corp.market or sub.site.ru"
    assert [h["normalized"] for h in hits(spark, ids.domain, text)] == ["shop1.market", "sub.site"]


def test_onion(spark):
    assert [h["normalized"] for h in hits(spark, ids.onion, "Visit " + "A" * 56 + ".onion/x")] == ["a" * 56 + ".onion"]
    assert hits(spark, ids.onion, "Old site: " + "a" * 16 + ".onion") == []


@pytest.mark.parametrize("text,platform,normalized", [
    ("DM me @DarkVendor42", "telegram", "@darkvendor42"),
    ("XMPP: user123@jabber.server.im", "xmpp", "user123@jabber.server.im"),
    ("Session: 05" + "a1" * 32, "session", "05" + "a1" * 32),
    ("Wickr: MyWickrId", "wickr", "wickr:mywickrid"),
])
def test_contacts(spark, text, platform, normalized):
    assert [(h["metadata"]["platform"], h["normalized"]) for h in hits(spark, ids.contact, text)] == [(platform, normalized)]


def test_ipv4(spark):
    assert [h["value"] for h in hits(spark, ids.ipv4, "Server at 192.168.1.100, not 999.1.1.1 or 1.2.3")] == ["192.168.1.100"]


def test_handles(spark):
    df = spark.createDataFrame([("post text", "ShadowX")], "text string, who string")
    got = df.select(F.explode(ids.handle(F.col("text"), F.col("who"))).alias("h")).collect()
    assert [(r["h"]["normalized"], r["h"]["confidence"]) for r in got] == [("shadowx", 1.0)]
    assert [h["normalized"] for h in hits(spark, ids.handle, "Great.\n-- DarkVendor")] == ["darkvendor"]
    assert [h["normalized"] for h in hits(spark, ids.handle, "Thanks.\nRegards, CryptoKing")] == ["cryptoking"]
    assert [h["normalized"] for h in hits(spark, ids.handle, "x\n- Al\n- " + "a1" * 10)] == ["al"]


def test_all_mixed_and_first_hit(spark):
    text = (
        "Selling Item-1042. Contact @darkvendor or darkvendor@protonmail.com. "
        f"BTC: {BECH} and again {BECH}. PGP: {KEY}"
    )
    found = hits(spark, ids.extract_all, text)
    kinds = [h["kind"] for h in found]
    assert kinds == ["pgp", "wallet", "email", "contact_id"]
    assert hits(spark, ids.extract_all, "") == []
    assert hits(spark, ids.extract_all, "The weather today is sunny and warm. It is 72 degrees.") == []


def test_offsets_point_into_the_text(spark):
    text = f"é @vendor1 pays {BECH} to a@b.com and a@b.com\n-- Joe Doe"
    found = hits(spark, ids.extract_all, text, offsets=True)
    assert {h["kind"] for h in found} == {"wallet", "email", "contact_id", "handle"}
    for h in found:
        part = text[h["start"]:h["end"]]
        assert part == h["value"] if h["kind"] != "handle" else part.endswith(h["value"])
    plain = hits(spark, ids.extract_all, text)
    assert [(h["kind"], h["normalized"]) for h in plain] == [(h["kind"], h["normalized"]) for h in found]


def test_attack_tags(spark):
    df = spark.createDataFrame([(["attack.T1059.001", "attack.g0032", "attack.g9999", "attack.execution"],)], "t array<string>")
    row = df.select(ids.attack_tags(F.col("t")).alias("a")).first()["a"]
    assert row["techniques"] == ["T1059.001"] and row["actors"] == ["lazarus", "g9999"]
