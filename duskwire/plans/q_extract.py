"""Extraction, redaction and other string queries."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.columns import bind
from .inputs import ctes, derived
from .registry import query

POSTS = ctes("posts")


def _listed(spark: SparkSession, sf: str, fn: Callable[[Column], Column]) -> DataFrame:
    posts = derived(spark, sf, "posts").select("post_id", "text")
    return posts.select("post_id", F.explode(fn(F.col("text"))).alias("h")).select(
        "post_id", "h.kind", "h.value", "h.normalized", "h.confidence"
    )


def _all(pattern: str, group: int = 0, flags: str = "") -> str:
    """Hits of one pattern as rows (post_id, value)."""
    opt = f", {group}, '{flags}'" if flags else f", {group}"
    return f"select post_id, unnest(regexp_extract_all(text, '{pattern}'{opt})) as value from posts"


def _simple(parts: list[tuple[str, str]], kind: str) -> str:
    """Union of (rows, normalised expression) as extractor output."""
    return POSTS + "\n" + "\nunion all\n".join(
        f"select post_id, '{kind}' as kind, value, {norm} as normalized, 1.0::double as confidence from ({rows}) t"
        for rows, norm in parts
    )


HEXG = r"(?:[0-9A-Fa-f]{4}[\s\-]?){9}[0-9A-Fa-f]{4}"
SQL_PGP = POSTS + rf"""
select post_id, 'pgp' as kind, trim(value) as value,
  upper(regexp_replace(regexp_replace(trim(value), '(?i)^(?:PGP|GPG|fingerprint|fpr|fp)[:\s]*', ''), '[^0-9A-Fa-f]', '', 'g')) as normalized,
  1.0::double as confidence
from ({_all(r'(?i)(?:(?:PGP|GPG|fingerprint|fpr|fp)[:\s]*' + HEXG + r'|\b[0-9A-Fa-f]{40}\b)')}) t
union all
select post_id, 'pgp', '[PGP_KEY_BLOCK]', 'KEY_BLOCK_DETECTED', 0.8::double
from ({_all('(?s)-----BEGIN PGP PUBLIC KEY BLOCK-----.*?-----END PGP PUBLIC KEY BLOCK-----')}) t"""


@query("ext_pgp", SQL_PGP)
def ext_pgp(spark, sf):
    return _listed(spark, sf, ids.pgp)


B58 = "[1-9A-HJ-NP-Za-km-z]"


@query("ext_wallet", _simple([
    (_all(r"(?i)\bbc1[qpzry9x8gf2tvdw0s3jn54khce6mua7l]{38,62}\b"), "value"),
    (_all(rf"\b1{B58}{{25,34}}\b"), "value"),
    (_all(rf"\b3{B58}{{25,34}}\b"), "value"),
    (_all(r"\b0x[0-9a-fA-F]{40}\b"), "lower(value)"),
    (_all(rf"\bT{B58}{{33}}\b"), "value"),
    (_all(r"\b4[0-9A-Za-z]{94}\b"), "value"),
], "wallet"))
def ext_wallet(spark, sf):
    return _listed(spark, sf, ids.wallet)


EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"


@query("ext_email", _simple([(_all(EMAIL), "lower(value)")], "email"))
def ext_email(spark, sf):
    return _listed(spark, sf, ids.email)


SQL_DOMAIN = POSTS + rf"""
select post_id, 'domain' as kind, value, lower(value) as normalized, 1.0::double as confidence
from (select post_id, text, unnest(regexp_extract_all(text, '\b([a-zA-Z0-9](?:[a-zA-Z0-9\-]{{0,61}}[a-zA-Z0-9])?\.(?:[a-zA-Z]{{2,}}))\b', 1)) as value from posts) t
where not contains(text, '@' || value)
  and regexp_extract(lower(value), '[^.]*$') not in ('com','org','net','edu','gov','io','co')"""


@query("ext_domain", SQL_DOMAIN)
def ext_domain(spark, sf):
    return _listed(spark, sf, ids.domain)


@query("ext_onion", _simple([(_all(r"(?i)\b[a-z2-7]{56}\.onion\b"), "lower(value)")], "onion"))
def ext_onion(spark, sf):
    return _listed(spark, sf, ids.onion)


CONTACT_ROWS = [
    # no lookbehind in this dialect: the character before the handle is part of the match
    (_all(r"(?:^|[^\w@])(@[a-zA-Z][a-zA-Z0-9_]{4,31})\b", 1), "lower(value)"),
    (_all(r"(?i)\b[a-zA-Z0-9._%+\-]+@(?:jabber|xmpp|conversations)\.[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"), "lower(value)"),
    (_all(r"\b05[0-9a-fA-F]{64}\b"), "lower(value)"),
    ("select post_id, 'wickr:' || value as value from (" + _all(r"(?i)(?:wickr|wickr\.me)[:\s]+([a-zA-Z0-9_]{3,20})", 1) + ") w", "lower(value)"),
]


@query("ext_contact", _simple(CONTACT_ROWS, "contact_id"))
def ext_contact(spark, sf):
    return _listed(spark, sf, ids.contact)


OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"


@query("ext_ipv4", _simple([(_all(rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"), "value")], "ip"))
def ext_ipv4(spark, sf):
    return _listed(spark, sf, ids.ipv4)


SIGN_ROWS = "\nunion all\n".join(
    f"select post_id, {i} as o, trim(value, ' ' || chr(9) || chr(10) || chr(13)) as value from ({_all(p, 1)}) t{i}"
    for i, p in enumerate([
        r"(?m)^--(\s+.+|[^-\s].*)$", r"(?m)^Regards,\s*(.+)$", r"(?m)^Cheers,\s*(.+)$", r"(?m)^-\s*([^-\s].*)$",
    ])
)
SQL_HANDLE = POSTS + f""", signs as ({SIGN_ROWS})
select post_id, 'handle' as kind, handle as value, trim(lower(handle)) as normalized, 1.0::double as confidence
from posts where length(handle) >= 2
union all
select post_id, 'handle', value, lower(value), 0.7::double from signs
where length(value) between 2 and 64 and not regexp_matches(value, '^[0-9A-Fa-f]{{16,}}$')"""


@query("ext_handle", SQL_HANDLE)
def ext_handle(spark, sf):
    posts = derived(spark, sf, "posts").select("post_id", "text", "handle")
    return posts.select("post_id", F.explode(ids.handle(F.col("text"), F.col("handle"))).alias("h")).select(
        "post_id", "h.kind", "h.value", "h.normalized", "h.confidence"
    )


def all_hits_sql(base: str = "posts") -> str:
    """Rows (post_id, kind, value, normalized, confidence) of every extractor over one input."""
    def body(sql: str) -> str:
        return sql[len(POSTS):].strip()

    parts = [
        body(ORACLE_TEXT["ext_pgp"]), body(ORACLE_TEXT["ext_wallet"]), body(ORACLE_TEXT["ext_email"]),
        body(ORACLE_TEXT["ext_onion"]), body(ORACLE_TEXT["ext_contact"]), body(ORACLE_TEXT["ext_ipv4"]),
        body(ORACLE_TEXT["ext_domain"]),
    ]
    handle = body(SQL_HANDLE)
    signs_end = handle.index("\nselect post_id, 'handle' as kind")
    parts.append(handle[signs_end:].strip())
    signs = handle[:signs_end].strip()
    text = signs + ", all_hits as (" + "\nunion all\n".join(f"({p})" for p in parts) + ")"
    return text if base == "posts" else text.replace("from posts", f"from {base}")


from .registry import ORACLES as ORACLE_TEXT  # noqa: E402

SQL_ALL = POSTS + all_hits_sql() + """
select post_id, kind, normalized, max(confidence) as confidence from all_hits group by post_id, kind, normalized"""


@query("ext_all", SQL_ALL)
def ext_all(spark, sf):
    posts = derived(spark, sf, "posts").select("post_id", "text", "handle")
    hits = posts.select("post_id", F.explode(ids.extract_all(F.col("text"), F.col("handle"))).alias("h"))
    return hits.select("post_id", "h.kind", "h.normalized", "h.confidence")


SQL_OFFSETS = POSTS + rf""", m as (
  select post_id, text, regexp_extract_all(text, '{EMAIL}') as found, regexp_split_to_array(text, '{EMAIL}') as gaps from posts),
n as (select post_id, text, found, gaps, unnest(range(1, len(found) + 1)) as i from m)
select post_id, found[i] as value,
  cast(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint) as start_at
from n"""


@query("ext_offsets", SQL_OFFSETS)
def ext_offsets(spark, sf):
    """Character offsets of hits."""
    posts = derived(spark, sf, "posts").select("post_id", "text")
    return posts.select("post_id", F.explode(ids.email(F.col("text"), offsets=True)).alias("h")).select(
        "post_id", "h.value", F.col("h.start").cast("long").alias("start_at")
    )


def _list_rows(spark, sf, table_sql_name: str, fn, fields: list[str]) -> DataFrame:
    """(post_id, list, value) of all lists in one scan."""

    def named(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("list"), v.alias("value")))

    def entries(e: Column) -> Column:
        return F.concat(*[named(f, e[f]) for f in fields])

    posts = derived(spark, sf, table_sql_name)
    # the outer form keeps Spark from repeating the extraction in a filter on its result
    rows = posts.select("post_id", F.explode_outer(bind(fn(F.col("text")), entries)).alias("l"))
    return rows.filter("l is not null").select("post_id", "l.list", "l.value")


def _list_sql(lists: list[tuple[str, str, int, bool, str]]) -> str:
    """``lists``: name, pattern, group, distinct or not, value."""
    out = []
    for name, pattern, group, distinct, value in lists:
        found = f"regexp_extract_all(text, '{pattern}', {group})"
        chosen = f"list_distinct({found})" if distinct else found
        out.append(f"select post_id, '{name}' as list, {value} as value from (select post_id, unnest({chosen}) as v from posts) t")
    return POSTS + "\n" + "\nunion all\n".join(out)


BLOCK = "(?s)-----BEGIN PGP PUBLIC KEY BLOCK-----.*?-----END PGP PUBLIC KEY BLOCK-----"
LOOSE_MAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
# the word class of this dialect is ASCII only
LOOSE_MAIL_U = r"[\pL\p{Nd}_.+-]+@[\pL\p{Nd}_-]+\.[\pL\p{Nd}_.-]+"
PAGE_FIELDS = ["btc_addresses", "eth_addresses", "xmr_addresses", "emails", "pgp_keys", "pgp_fingerprints", "onion_urls", "handles"]


@query("ext_page", _list_sql([
    ("btc_addresses", rf"\b((?:1|3){B58}{{25,34}}|bc1[a-zA-HJ-NP-Z0-9]{{25,62}})\b", 1, True, "v"),
    ("eth_addresses", r"\b(0x[0-9a-fA-F]{40})\b", 1, True, "v"),
    ("xmr_addresses", rf"\b(4[0-9AB]{B58}{{93}})\b", 1, True, "v"),
    ("emails", LOOSE_MAIL_U, 0, True, "v"),
    ("pgp_keys", BLOCK, 0, False, "substr(sha256(v), 1, 16)"),
    ("pgp_fingerprints", "[0-9A-Fa-f]{40}", 0, True, "v"),
    ("onion_urls", r"https?://[a-z2-7]{56}\.onion[^\s\"''<>]*", 0, True, "v"),
    ("handles", r"@[\pL\p{Nd}_]{3,30}", 0, True, "v"),
]))
def ext_page(spark, sf):
    return _list_rows(spark, sf, "posts", ids.page_entities, PAGE_FIELDS)


@query("ext_archive", _list_sql([
    ("btc_addresses", rf"\b((?:1|3){B58}{{25,34}})\b", 1, True, "v"),
    ("pgp_key_hashes", BLOCK, 0, False, "substr(sha256(v), 1, 16)"),
    ("emails", LOOSE_MAIL_U, 0, True, "v"),
    ("vendor_handles", r"(?i)(?:vendor|seller|shop)\s*:\s*(\S+)", 1, True, "v"),
]))
def ext_archive(spark, sf):
    return _list_rows(
        spark, sf, "posts", ids.archive_entities, ["btc_addresses", "pgp_key_hashes", "emails", "vendor_handles"]
    )


@query("ext_contact_field", _list_sql([
    ("emails", LOOSE_MAIL_U, 0, False, "v"),
    ("pgp_fingerprints", "[0-9A-Fa-f]{40}", 0, False, "v"),
    ("pgp_short_ids", "0x[0-9A-Fa-f]{8,16}", 0, False, "v"),
    ("urls", r"https?://[\w./?&=%-]+", 0, False, "v"),
    ("handles", r"@[\pL\p{Nd}_]{3,30}", 0, False, "v"),
]))
def ext_contact_field(spark, sf):
    return _list_rows(
        spark, sf, "posts", ids.contact_field, ["emails", "pgp_fingerprints", "pgp_short_ids", "urls", "handles"]
    )




@query("ext_attack_tags", """
with tags as (select doc_id, 'attack.T' || cast(1000 + doc_id % 600 as varchar) || case when doc_id % 3 = 0 then '.001' else '' end as t,
   'attack.g' || lpad(cast(doc_id % 140 as varchar), 4, '0') as g, 'attack.execution' as x from documents)
select doc_id, 'technique' as kind, upper(substr(t, 8, 1)) || substr(t, 9) as value from tags
union all
select doc_id, 'actor', case substr(g, 8)
 when 'g0016' then 'apt29' when 'g0022' then 'apt3' when 'g0026' then 'apt18' when 'g0032' then 'lazarus' when 'g0034' then 'sandworm'
 when 'g0035' then 'dragonfly' when 'g0045' then 'menupass' when 'g0049' then 'oilrig' when 'g0050' then 'apt32' when 'g0059' then 'magic_hound'
 when 'g0064' then 'apt33' when 'g0074' then 'wizard_spider' when 'g0078' then 'gorgon_group' when 'g0080' then 'cobalt_group' when 'g0092' then 'ta505'
 when 'g0096' then 'apt41' when 'g0102' then 'fin7' when 'g0108' then 'blue_mockingbird' when 'g0114' then 'chimera' when 'g0119' then 'indrik_spider'
 when 'g0125' then 'hafnium' when 'g0129' then 'mustang_panda' else substr(g, 8) end from tags""")
def ext_attack_tags(spark, sf):
    from .inputs import table

    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.array(
            F.concat(F.lit("attack.T"), (1000 + F.col("doc_id") % 600).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".001").otherwise("")),
            F.concat(F.lit("attack.g"), F.lpad((F.col("doc_id") % 140).cast("string"), 4, "0")),
            F.lit("attack.execution"),
        ).alias("tags"),
    )
    parsed = docs.select("doc_id", ids.attack_tags(F.col("tags")).alias("a"))
    return parsed.select("doc_id", F.lit("technique").alias("kind"), F.explode("a.techniques").alias("value")).unionByName(
        parsed.select("doc_id", F.lit("actor").alias("kind"), F.explode("a.actors").alias("value"))
    )
