"""Identifier extraction as column expressions: ``text -> ARRAY<hit>``.

A hit is ``STRUCT<kind, value, normalized, start, end, confidence, metadata>``.

Most identifiers contain no blank. For those, patterns run over ``compact(text)``: the words
that can hold an identifier at all, which is a small part of prose and needs no regular
expression to find. Offsets refer to the full text, so they are computed on demand only
(``offsets=True``) and are NULL otherwise.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import bind, ranked

HIT_TYPE = (
    "array<struct<kind:string,value:string,normalized:string,start:int,end:int,"
    "confidence:double,metadata:map<string,string>>>"
)
SHORTEST_ADDRESS = 26
Extractor = Callable[..., Column]


def no_hits() -> Column:
    return F.array().cast(HIT_TYPE)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def compact(text: Column) -> Column:
    """Blank-separated words that are long, hold an ``@`` or have a dot inside, in order."""

    def may_hold(word: Column) -> Column:
        dot = F.instr(word, ".")
        return (
            (F.length(word) >= SHORTEST_ADDRESS)
            | F.contains(word, F.lit("@"))
            | ((dot > 0) & (dot < F.length(word)))
        )

    return F.array_join(F.filter(F.split(text, " "), may_hold), " ")


def _on_words(fn: Extractor) -> Extractor:
    """Give an extractor the full text and the words it has to look at."""

    @wraps(fn)
    def run(text: Column, offsets: bool = False, words: Column | None = None) -> Column:
        if offsets:
            return fn(text, text, True)
        if words is not None:
            return fn(text, words, False)
        return bind(compact(text), lambda w: fn(text, w, False))

    return run


def _meta(**entries: str) -> Column:
    pairs: list[Column] = []
    for k, v in entries.items():
        pairs += [F.lit(k), F.lit(v)]
    if not pairs:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.create_map(*pairs)


def _hits(
    text: Column,
    pattern: str,
    kind: str,
    value: Callable[[Column], Column] = lambda m: m,
    normalize: Callable[[Column], Column] = lambda v: v,
    confidence: float = 1.0,
    meta: Column | None = None,
    guard: Column | None = None,
    offsets: bool = False,
) -> Column:
    """All matches of ``pattern``; ``guard`` is a cheap necessary condition.

    With offsets, ``split`` gives the text between matches, and summing both kinds of length
    gives the place of each match.
    """
    metadata = _meta() if meta is None else meta
    found = find_all(text, pattern)
    if guard is not None:
        found = F.when(guard, found).otherwise(F.array().cast("array<string>"))

    def hit(match: Column, start: Column) -> Column:
        return bind(
            value(match),
            lambda v: F.struct(
                F.lit(kind).alias("kind"),
                v.alias("value"),
                normalize(v).alias("normalized"),
                start.cast("int").alias("start"),
                (start + F.length(match)).cast("int").alias("end"),
                F.lit(confidence).alias("confidence"),
                metadata.alias("metadata"),
            ),
        )

    if not offsets:
        hits = F.transform(found, lambda m: hit(m, F.lit(None).cast("int")))
        return F.coalesce(hits.cast(HIT_TYPE), no_hits())

    def build(s: Column) -> Column:
        def one(match: Column, i: Column) -> Column:
            gaps = F.aggregate(F.slice(s["gaps"], F.lit(1), i + 1), F.lit(0), lambda a, p: a + F.length(p))
            before = F.aggregate(F.slice(s["found"], F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p))
            return hit(match, gaps + before)

        return F.transform(s["found"], one)

    located = bind(
        found,
        lambda m: F.when(
            F.size(m) > 0,
            bind(F.struct(m.alias("found"), F.split(text, pattern, -1).alias("gaps")), build),
        ).otherwise(no_hits()),
    )
    return F.coalesce(located.cast(HIT_TYPE), no_hits())


def _has(text: Column, *needles: str) -> Column:
    out = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        out = out | F.contains(text, F.lit(needle))
    return out


@_on_words
def pgp(text: Column, words: Column, offsets: bool) -> Column:
    labelled = f"{fixed.PGP_LABEL}{fixed.HEX_GROUPS}"

    def digits(v: Column) -> Column:
        # only the hex group counts: the letters of a label such as "fpr" are no digits of the key
        unlabelled = F.regexp_replace(v, F.lit(f"^{fixed.PGP_LABEL}"), F.lit(""))
        return F.upper(F.regexp_replace(unlabelled, F.lit("[^0-9A-Fa-f]"), F.lit("")))

    has_label = bind(F.lower(text), lambda low: _has(low, "pgp", "gpg", "fp", "fingerprint"))
    keys = bind(
        has_label,
        lambda label: F.concat(
            _hits(text, f"{labelled}|{fixed.HEX40}", "pgp", F.trim, digits, guard=label, offsets=offsets),
            _hits(words, fixed.HEX40, "pgp", F.trim, digits, guard=~label, offsets=offsets),
        ),
    )
    blocks = _hits(
        text,
        f"(?s){fixed.PGP_BLOCK}",
        "pgp",
        value=lambda m: F.lit("[PGP_KEY_BLOCK]"),
        normalize=lambda v: F.lit("KEY_BLOCK_DETECTED"),
        confidence=0.8,
        meta=_meta(type="armored_block"),
        guard=_has(text, "-----BEGIN PGP"),
        offsets=offsets,
    )
    return F.concat(keys, blocks)


@_on_words
def wallet(text: Column, words: Column, offsets: bool) -> Column:
    def of(pattern: str, normalize: Callable[[Column], Column] = lambda v: v, **meta: str) -> Column:
        return _hits(words, pattern, "wallet", normalize=normalize, meta=_meta(**meta), offsets=offsets)

    return F.concat(
        of(fixed.BTC_BECH32, currency="BTC"),
        of(fixed.BTC_LEGACY, currency="BTC"),
        of(fixed.BTC_P2SH, currency="BTC"),
        of(fixed.ETH, F.lower, currency="ETH"),
        of(fixed.TRON, currency="TRON"),
        of(fixed.XMR, currency="XMR", traceable="false"),
    )


@_on_words
def email(text: Column, words: Column, offsets: bool) -> Column:
    return _hits(words, fixed.EMAIL, "email", normalize=F.lower, guard=_has(text, "@"), offsets=offsets)


@_on_words
def domain(text: Column, words: Column, offsets: bool) -> Column:
    hits = _hits(words, fixed.DOMAIN, "domain", normalize=F.lower, guard=_has(text, "."), offsets=offsets)
    # the pattern admits one dot, so a hit always has two labels
    return F.filter(
        hits,
        lambda h: ~F.substring_index(h["normalized"], ".", -1).isin(fixed.NOISE_TLDS)
        & ~F.contains(words, F.concat(F.lit("@"), h["value"])),
    )


@_on_words
def onion(text: Column, words: Column, offsets: bool) -> Column:
    return _hits(
        words, fixed.ONION_V3, "onion", normalize=F.lower, guard=_has(F.lower(words), ".onion"), offsets=offsets
    )


@_on_words
def contact(text: Column, words: Column, offsets: bool) -> Column:
    def wickr_value(m: Column) -> Column:
        return F.concat(F.lit("wickr:"), F.regexp_extract(m, fixed.WICKR, 1))

    def of(where: Column, pattern: str, platform: str, guard: Column, value=lambda m: m) -> Column:
        return _hits(
            where, pattern, "contact_id", value=value, normalize=F.lower, meta=_meta(platform=platform),
            guard=guard, offsets=offsets,
        )

    return F.concat(
        of(words, fixed.TELEGRAM, "telegram", _has(words, "@")),
        of(words, fixed.XMPP, "xmpp", _has(words, "@")),
        of(words, fixed.SESSION_ID, "session", _has(words, "05")),
        of(text, fixed.WICKR, "wickr", _has(F.lower(text), "wickr"), wickr_value),
    )


@_on_words
def ipv4(text: Column, words: Column, offsets: bool) -> Column:
    return _hits(words, fixed.IPV4, "ip", guard=_has(words, "."), offsets=offsets)


# a lone dash must not be the first of two, or "-- name" would be found twice; nor two dashes the
# start of more, or the armor lines of a key would be names
SIGNATURES = [
    (rf"^--(?!-){fixed.SPACE}*(.+)$", "--"),
    (rf"^Regards,{fixed.SPACE}*(.+)$", "Regards,"),
    (rf"^Cheers,{fixed.SPACE}*(.+)$", "Cheers,"),
    (rf"^-(?!-){fixed.SPACE}*(.+)$", "-"),
]


def handle(text: Column, author: Column | None = None, offsets: bool = False) -> Column:
    parts: list[Column] = []
    if author is not None:
        given = F.struct(
            F.lit("handle").alias("kind"),
            author.alias("value"),
            F.trim(F.lower(author)).alias("normalized"),
            F.lit(-1).alias("start"),
            F.lit(-1).alias("end"),
            F.lit(1.0).alias("confidence"),
            _meta(source="metadata").alias("metadata"),
        )
        parts.append(F.when(F.length(author) >= 2, F.array(given).cast(HIT_TYPE)).otherwise(no_hits()))
    for signature, opening in SIGNATURES:
        pattern = f"(?md){signature}"
        hits = _hits(
            text, pattern, "handle",
            value=lambda m, p=pattern: F.btrim(F.regexp_extract(m, p, 1), F.lit(" \t\r\n")),
            normalize=F.lower,
            confidence=0.7,
            meta=_meta(source="signature"),
            guard=F.startswith(text, F.lit(opening)) | _has(text, "\n" + opening),
            offsets=offsets,
        )
        parts.append(
            F.filter(
                hits,
                lambda h: F.length(h["value"]).between(2, 64) & ~h["value"].rlike("^[0-9A-Fa-f]{16,}$"),
            )
        )
    return F.concat(*parts)


def first_hits(hits: Column) -> Column:
    """First hit per (kind, normalized), in the given order."""

    def keep(s: Column) -> Column:
        firsts = F.filter(
            s["keys"], lambda e, j: ~F.coalesce(F.get(s["keys"], j - 1)["k"] == e["k"], F.lit(False))
        )
        order = F.array_sort(F.transform(firsts, lambda e: e["i"]))
        return F.transform(order, lambda i: F.get(s["hits"], i))

    def keyed(all_hits: Column) -> Column:
        keys = F.transform(
            all_hits,
            lambda h, i: F.struct(F.concat_ws("\x01", h["kind"], h["normalized"]).alias("k"), i.alias("i")),
        )
        return F.struct(all_hits.alias("hits"), F.array_sort(keys).alias("keys"))

    return bind(bind(hits, keyed), keep)


EXTRACTORS: list[tuple[str, Extractor]] = [
    ("pgp", pgp),
    ("wallet", wallet),
    ("email", email),
    ("onion", onion),
    ("contact", contact),
    ("ipv4", ipv4),
    ("domain", domain),
]


def extract_all(text: Column, author: Column | None = None, offsets: bool = False) -> Column:
    """Every extractor in fixed order, handles last, first hit per identity."""

    def run(words: Column | None) -> Column:
        parts = [fn(text, offsets=offsets, words=words) for _, fn in EXTRACTORS]
        return first_hits(F.concat(*parts, handle(text, author, offsets)))

    return run(None) if offsets else bind(compact(text), run)


def page_entities(text: Column, limit: int | None = None) -> Column:
    """Identifier lists of a stored page, distinct and sorted; ``limit`` bounds each list."""
    blocks = F.transform(
        find_all(text, f"(?s){fixed.PGP_BLOCK}"), lambda b: F.substring(F.sha2(b, 256), 1, 16)
    )
    return F.struct(
        ranked(find_all(text, fixed.PAGE_BTC), limit).alias("btc_addresses"),
        ranked(find_all(text, fixed.ETH), limit).alias("eth_addresses"),
        ranked(find_all(text, fixed.PAGE_XMR), limit).alias("xmr_addresses"),
        ranked(find_all(text, fixed.LOOSE_EMAIL), limit).alias("emails"),
        blocks.alias("pgp_keys"),
        ranked(find_all(text, fixed.LOOSE_HEX40), limit).alias("pgp_fingerprints"),
        ranked(find_all(text, fixed.ONION_URL), limit).alias("onion_urls"),
        ranked(find_all(text, fixed.LOOSE_HANDLE), limit).alias("handles"),
    )


def archive_entities(text: Column, limit: int | None = None) -> Column:
    """Identifier lists of an archived forum page; ``limit`` bounds each list."""
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    low = F.lower(text)
    block = F.when(F.contains(text, F.lit("-----BEGIN PGP PUBLIC KEY BLOCK-----")), find_all(text, f"(?s){fixed.PGP_BLOCK}")).otherwise(none)
    sells = F.contains(text, F.lit(":")) & (F.contains(low, F.lit("vendor")) | F.contains(low, F.lit("seller")) | F.contains(low, F.lit("shop")))
    vendors = F.when(sells, find_all(text, fixed.ARCHIVE_VENDOR, 1)).otherwise(none)

    def lists(words: Column) -> Column:
        return F.struct(
            ranked(find_all(words, fixed.ARCHIVE_BTC), limit).alias("btc_addresses"),
            F.transform(block, lambda b: F.substring(F.sha2(b, 256), 1, 16)).alias("pgp_key_hashes"),
            ranked(find_all(words, fixed.LOOSE_EMAIL), limit).alias("emails"),
            ranked(vendors, limit).alias("vendor_handles"),
        )

    # addresses hold no blank: they lie within words that are long or hold an @
    return bind(compact(text), lists)


def contact_field(contact_text: Column) -> Column:
    """Identifiers in the free-form contact line of a relay operator."""
    return F.struct(
        find_all(contact_text, fixed.LOOSE_EMAIL).alias("emails"),
        find_all(contact_text, fixed.LOOSE_HEX40).alias("pgp_fingerprints"),
        find_all(contact_text, fixed.CONTACT_SHORT_KEY).alias("pgp_short_ids"),
        find_all(contact_text, fixed.CONTACT_URL).alias("urls"),
        find_all(contact_text, fixed.LOOSE_HANDLE).alias("handles"),
    )


def attack_tags(tags: Column) -> Column:
    """Techniques and actor groups named by rule tags."""
    from .columns import lookup

    lowered = F.transform(tags, F.lower)
    technique = r"attack\.t(\d{4}(?:\.\d{3})?)"
    group = r"attack\.g(\d{4})"
    techniques = F.transform(
        F.filter(lowered, lambda t: t.rlike(technique)),
        lambda t: F.concat(F.lit("T"), F.regexp_extract(t, technique, 1)),
    )
    groups = F.transform(
        F.filter(lowered, lambda t: t.rlike(group)),
        lambda t: F.concat(F.lit("g"), F.regexp_extract(t, group, 1)),
    )
    actors = F.transform(groups, lambda g: lookup(g, fixed.ATTACK_GROUPS, g))
    return F.struct(techniques.alias("techniques"), actors.alias("actors"))
