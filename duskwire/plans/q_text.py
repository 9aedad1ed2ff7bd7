"""Gates, redaction, HTML, URL, hash, score and style expressions."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import fixed, hashing, pages, scores, style, vectors
from ..functions.handles import pair_ratios
from ..lineage import cut_lineage
from ..operators import gates
from .inputs import ctes, derived, table
from .registry import query

POSTS = ctes("posts")

# --- redaction ---------------------------------------------------------------
AADHAAR = r"\b(\d{4}[\s\-]?\d{4}[\s\-]?\d{4})\b"
PAN = r"\b([A-Z]{5}\d{4}[A-Z])\b"
PHONE = r"(?:\+?\d{1,3}[\s\-]?)?\(?\d{3,5}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}\b"
MAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
KEPT = r"@(protonmail\.|tutanota\.|cock\.li|dnmx\.|onionmail\.)"


def redaction_ctes(base: str = "posts", key: str = "post_id") -> str:
    """Stages r0..r3 and ``redacted``: addresses of kept providers lose their @ for the last rule."""
    return rf"""
r0 as (select *, len(regexp_extract_all(text, '{AADHAAR}')) as n0, regexp_replace(text, '{AADHAAR}', '[AADHAAR_REDACTED]', 'g') as t0 from {base}),
r1 as (select *, len(regexp_extract_all(t0, '{PAN}')) as n1, regexp_replace(t0, '{PAN}', '[PAN_REDACTED]', 'g') as t1 from r0),
r2 as (select *, len(regexp_extract_all(t1, '{PHONE}')) as n2, regexp_replace(t1, '{PHONE}', '[PHONE_REDACTED]', 'g') as t2 from r1),
r3 as (select *, regexp_replace(t2, '{KEPT}', chr(1) || '\1', 'g') as t3 from r2),
redacted as (select * exclude (text, t0, t1, t2, t3), len(regexp_extract_all(t3, '{MAIL}')) as n3,
  replace(regexp_replace(t3, '{MAIL}', '[EMAIL_REDACTED]', 'g'), chr(1), '@') as text from r3)"""


SQL_SUMMARY = """concat_ws(',', case when n0 > 0 then 'aadhaar:' || n0 end, case when n1 > 0 then 'pan:' || n1 end,
  case when n2 > 0 then 'phone:' || n2 end, case when n3 > 0 then 'victim_email:' || n3 end)"""


@query("red_pii", POSTS + "," + redaction_ctes() + f"""
select post_id, md5(text) as text_md5, length(text) as n, {SQL_SUMMARY} as redactions from redacted""")
def red_pii(spark, sf):
    out = gates.redact(derived(spark, sf, "posts").select("post_id", "text"))
    return out.select(
        "post_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"),
        F.array_join("redactions", ",").alias("redactions"),
    )


# --- gates -------------------------------------------------------------------
SQL_POLICY = ctes("refs", "sources") + """
select source_id, doc_id, rule_hit, case when rule_hit is not null then 'block' when contains(pii_policy, 'redact') then 'redact_allow' else 'allow' end as decision,
  rule_hit is not null as blocked
from (select *, case
  when authorization_status is null then 'unknown_source'
  when not enabled then 'source_disabled'
  when authorization_status not in ('approved', 'authorized') then 'unauthorized'
  when authorization_status = 'authorized' and authorization_ref is null then 'missing_auth_ref'
  when lower(trim(split_part(content_type, ';', 1))) not in ('text/html','text/plain','application/json','application/xml') then 'content_type_blocked'
  when size_bytes > 10485760 then 'size_exceeded'
  when regexp_extract(url, '://([^/]+)', 1) in ('n7.example.com', 'n11.example.com') then 'domain_denied'
  when retention_days <= 0 then 'no_retention' end as rule_hit
  from (select * replace (case when doc_id % 17 = 0 then 'ghost' else source_id end as source_id) from refs) r left join sources using (source_id)) t"""


@query("gate_policy", SQL_POLICY)
def gate_policy(spark, sf):
    # some candidates name a source that is not registered
    refs = derived(spark, sf, "refs").withColumn("source_id", F.when(F.col("doc_id") % 17 == 0, "ghost").otherwise(F.col("source_id")))
    # denied hosts come from the reference list itself
    deny = refs.select(pages.host(F.col("url")).alias("host")).filter(F.col("host").isin("n7.example.com", "n11.example.com"))
    out = gates.policy(refs, derived(spark, sf, "sources"), deny)
    return out.select("source_id", "doc_id", "rule_hit", "decision", F.col("event_id").isNull().alias("blocked"))


@query("gate_mime", ctes("refs") + """
select doc_id, not regexp_matches(lower(trim(split_part(content_type, ';', 1))),
 '^(image/|video/|audio/|application/zip|application/x-rar|application/x-tar|application/gzip|application/x-7z|application/octet-stream|application/pdf|application/x-executable|application/x-msdownload)') as allowed
from refs""")
def gate_mime(spark, sf):
    return derived(spark, sf, "refs").select("doc_id", gates.mime_allowed(F.col("content_type")).alias("allowed"))


SQL_CONTENT = """
with t as (select doc_id, text || case doc_id % 11 when 3 then ' Recruiting  for terror.' when 5 then ' CHILD abuse' when 7 then ' grandchild abuse' else '' end as text from documents)
select doc_id, not (regexp_matches(text, '(?i)\\b(child\\s+(?:abuse|exploitation|pornograph))\\b')
  or regexp_matches(text, '(?i)\\b(recruit(?:ing|ment)\\s+for\\s+(?:jihad|terror))\\b')) as allowed
from t""".replace("\\\\", "\\")


@query("gate_content", SQL_CONTENT)
def gate_content(spark, sf):
    k = F.col("doc_id") % 11
    tail = F.when(k == 3, " Recruiting  for terror.").when(k == 5, " CHILD abuse").when(k == 7, " grandchild abuse").otherwise("")
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", gates.content_allowed(F.concat("text", tail)).alias("allowed"))


@query("gate_retention", ctes("posts", "sources") + """
select post_id from posts join sources using (source_id)
where epoch(timestamp '2024-02-10 00:00:00') - epoch(observed_at) <= retention_days * 86400""")
def gate_retention(spark, sf):
    at = F.lit("2024-02-10 00:00:00").cast("timestamp")
    return gates.retained(derived(spark, sf, "posts").select("post_id", "source_id", "observed_at"), derived(spark, sf, "sources"), at).select("post_id")


@query("flt_sources", ctes("sources") + """
select source_id, source_type, reliability_grade from sources
where enabled and authorization_status in ('approved', 'authorized') and source_type = 'feed'""")
def flt_sources(spark, sf):
    return gates.enabled_sources(derived(spark, sf, "sources"), "feed").select("source_id", "source_type", "reliability_grade")


HOSTS_CASE = """case page_id % 13 when 0 then 'http://10.1.2.' || page_id % 250 || '/x' when 1 then 'http://localhost:8080/' when 2 then 'http://192.168.0.1/'
  when 3 then 'http://172.20.1.1/a' when 4 then 'http://172.40.1.1/a' when 5 then 'http://169.254.169.254/latest' when 6 then 'http://abcdefgh.onion/x'
  when 7 then 'not a url' when 8 then 'http://127.0.0.1:99/' when 9 then 'http://metadata.google.internal/v1' when 10 then 'http://8.8.8.8/' else url end"""


@query("flt_url_ssrf", f"""
with u as (select page_id, {HOSTS_CASE} as url from pages),
h as (select *, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)) as host from u),
o as (select *, regexp_matches(host, '^[0-9.]+$') as ip, try_cast(split_part(host, '.', 1) as int) as a, try_cast(split_part(host, '.', 2) as int) as b from h)
select page_id, url, case when host = '' then false when host like '%.onion' then true
  when ip then not (a in (0, 10, 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168))
  else not (host like 'localhost%' or host like '10.%' or host like 'metadata.google.internal%' or host like 'metadata.aws.internal%') end as allowed
from o""")
def flt_url_ssrf(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", F.expr(HOSTS_CASE).alias("url"))
    return urls.select("page_id", "url", pages.allowed_target(F.col("url")).alias("allowed"))


@query("flt_watch_pattern", """
with d as (select doc_id, ['Shop' || doc_id || '.example.com', case when doc_id % 5 = 0 then 'LOCKBIT' || doc_id || '.net' when doc_id % 5 = 1 then 'the-leak-ransom' || doc_id || '.org'
   else 'x' || doc_id || '.io' end, case when doc_id % 7 = 0 then 'abc.ONION' else 'z.example.org' end] as domains from documents),
m as (select doc_id, domains, list_transform(domains, lambda x: case when contains(lower(x), '.onion') then '.onion' when contains(lower(x), 'lockbit') then 'lockbit'
   when contains(lower(x), 'blackcat') then 'blackcat' when contains(lower(x), 'alphv') then 'alphv' when contains(lower(x), 'ransom') then 'ransom' when contains(lower(x), 'leak') then 'leak' end) as hits from d)
select doc_id, list_filter(hits, lambda x: x is not null)[1] as matched_pattern from m where len(list_filter(hits, lambda x: x is not null)) > 0""")
def flt_watch_pattern(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr("""
        array('Shop' || doc_id || '.example.com', case when doc_id % 5 = 0 then 'LOCKBIT' || doc_id || '.net'
          when doc_id % 5 = 1 then 'the-leak-ransom' || doc_id || '.org' else 'x' || doc_id || '.io' end,
          case when doc_id % 7 = 0 then 'abc.ONION' else 'z.example.org' end)""").alias("domains"))
    return docs.select("doc_id", gates.watch_match(F.col("domains")).alias("matched_pattern")).filter("matched_pattern is not null")


ROBOTS_TEXT = """'User-agent: otherbot' || chr(10) || 'Disallow: /en' || chr(10) || 'User-Agent: *' || chr(10) || 'Disallow: /fr' || chr(10) || 'Disallow:' || chr(10) || 'Disallow: /de/' || length(domain) % 10"""


@query("flt_robots", f"""
with d as (select distinct lower(regexp_extract(url, '://([^/:?#]+)', 1)) as domain from pages),
p as (select page_id, url, lower(regexp_extract(url, '://([^/:?#]+)', 1)) as domain, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) as path from pages)
select page_id, url from p join d using (domain)
where not (starts_with(path, '/fr') or starts_with(path, '/de/' || length(domain) % 10))""")
def flt_robots(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", "url")
    robots = urls.select(pages.host(F.col("url")).alias("domain")).distinct().select("domain", F.expr(ROBOTS_TEXT).alias("text"))
    return gates.robots_allowed(urls, gates.robots_rules(robots, "duskwire")).select("page_id", "url")


# --- html and url --------------------------------------------------------------
SQL_STRIP = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'),
  '(?s)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[\s\pZ]+', ' ', 'g'))"""


@query("html_strip", f"select page_id, {SQL_STRIP} as text from pages")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.strip_html(F.col("html")).alias("text"))


@query("html_title", r"""
select page_id, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1), ' ' || chr(9) || chr(10) || chr(13)), '') as title from pages""")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.title(F.col("html")).alias("title"))


MARK = """case page_id % 8 when 0 then '<meta name="generator" content="WordPress 6.1">' when 1 then '<link href="/wp-content/x.css">' when 2 then 'Powered by DRUPAL'
  when 3 then 'joomla!' when 4 then '<div id="__next">' when 5 then 'Werkzeug/2.0' when 6 then '<META name=''Generator''  content=''Hugo''>' else '' end || html"""


@query("html_fingerprint", f"""
with p as (select page_id, {MARK} as html from pages)
select page_id, nullif(regexp_extract(html, '(?i)<meta\\s+name=["'']generator["'']\\s+content=["'']([^"'']+)["'']', 1), '') as generator,
 case when contains(html, 'wp-content') or contains(lower(html), 'wordpress') then 'wordpress' when contains(lower(html), 'drupal') then 'drupal'
  when contains(lower(html), 'joomla') then 'joomla' when contains(html, '__next') then 'nextjs'
  when contains(lower(html), 'flask') or contains(lower(html), 'werkzeug') then 'flask' end as framework
from p""".replace("\\\\", "\\"))
def html_fingerprint(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.expr(MARK).alias("html"))
    return p.select("page_id", pages.generator(F.col("html")).alias("generator"), pages.framework(F.col("html")).alias("framework"))


SQL_LINKS = r"""
with h as (select page_id, url, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/:?#]+)', 1)) as root,
    unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) as href from pages),
f as (select page_id, root, case when starts_with(href, 'http') then regexp_extract(href, '^[^?#]*') when starts_with(href, '/') then root || regexp_extract(href, '^[^?#]*')
    when href like '#%' then regexp_extract(url, '^[^?#]*')
    else root || regexp_extract(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '^(.*/)', 1) || regexp_extract(href, '^[^?#]*') end as full_url from h)
select page_id, unnest(list_sort(list_distinct(list(regexp_replace(full_url, '/$', ''))))) as link
from f where lower(regexp_extract(full_url, '://([^/:?#]+)', 1)) like '%.example.com' group by page_id"""


@query("html_links", SQL_LINKS)
def html_links(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.explode(pages.links(F.col("html"), F.col("url"), ".example.com")).alias("link")
    )


@query("url_norm", r"""
select page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/:?#]+)', 1)) ||
  case when rtrim(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/') = '' then '/' else rtrim(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/') end as normalized from pages""")
def url_norm(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.normalize_url(F.col("url")).alias("normalized"))


@query("hdr_fingerprint", """
select event_id, unnest(['server', 'via']) as header, unnest(['srv-' || event_type, 'proxy' || user_id]) as value from events
union all select event_id, 'set-cookie', 'k=' || event_id from events where event_type = 'click'""")
def hdr_fingerprint(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.expr("""
        map('server', 'srv-' || event_type, 'date', string(ts), 'via', 'proxy' || user_id, 'x-generator', '',
            'set-cookie', if(event_type = 'click', 'k=' || event_id, ''), 'content-length', '5')""").alias("headers"))
    return ev.select("event_id", F.explode(pages.header_fingerprint(F.col("headers"))).alias("header", "value"))


@query("clock_skew", """
select event_id, case when event_id % 10 = 0 then null else
  round_even(((epoch_us(date_trunc('second', ts)) + (user_id % 90 - 45) * 1000000) - epoch_us(ts)) / 1000000.0, 3) end as skew from events""")
def clock_skew(spark, sf):
    ev = table(spark, sf, "events")
    server = F.timestamp_seconds(F.unix_seconds("ts") + F.col("user_id") % 90 - 45)
    header = F.when(F.col("event_id") % 10 == 0, "yesterday").otherwise(
        F.concat(F.date_format(server, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    )
    return ev.select("event_id", pages.clock_skew(header, F.col("ts")).alias("skew"))


RAW_GROUP = """case c_custkey % 9 when 0 then ' LockBit_3.0 ' when 1 then 'BlackCat' when 2 then 'CL0P' when 3 then 'Black-Basta' when 4 then 'royal ransomware'
  when 5 then 'Hunters_International' when 6 then 'Ransom-Hub' when 7 then 'Play' else 'Group_' || c_custkey end"""


@query("group_norm", f"""
select c_custkey, case c_custkey % 9 when 0 then 'lockbit' when 1 then 'alphv' when 2 then 'clop' when 3 then 'blackbasta' when 4 then 'royallocker'
  when 5 then 'hunters' when 6 then 'ransomhub' when 7 then 'play' else 'group ' || c_custkey end as group_name from customer""")
def group_norm(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scores.normalize_group(F.expr(RAW_GROUP)).alias("group_name"))


# --- hashes ------------------------------------------------------------------
@query("hash_content", "select doc_id, 'sha256:' || sha256(text) as content_hash from documents")
def hash_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))


def uuid5_sql(name: str) -> str:
    h = f"sha1(unhex('{hashing.URL_NAMESPACE}') || encode({name}))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


@query("evidence_id", f"""select doc_id, {uuid5_sql("'sha256:' || sha256(text) || ':' || source")} as evidence_id from documents""")
def evidence_id(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", hashing.evidence_id(hashing.content_hash(F.col("text")), F.col("source")).alias("evidence_id"))


@query("hash_md5", "select page_id, md5(html) as page_hash from pages")
def hash_md5(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5("html").alias("page_hash"))


#: MurmurHash3 step by step: little-endian words, their mix, the fold over them and the final mix.
MURMUR_SQL = """
with b as (select page_id, octet_length(encode(html)) as n, hex(encode(html)) as x from pages),
p as (select page_id, n, rpad(x, cast((n + 3) // 4 * 8 as integer), '0') as x from b),
w as (select page_id, n, list_transform(range(0, (n + 3) // 4), lambda i: cast('0x' || substr(x, i * 8 + 7, 2) || substr(x, i * 8 + 5, 2) || substr(x, i * 8 + 3, 2) || substr(x, i * 8 + 1, 2) as ubigint)) as k from p),
m1 as (select page_id, n, list_transform(k, lambda v: (v * 3432918353::ubigint) & 4294967295::ubigint) as k from w),
m2 as (select page_id, n, list_transform(k, lambda v: ((v << 15::ubigint) & 4294967295::ubigint) | (v >> 17::ubigint)) as k from m1),
m3 as (select page_id, n, list_transform(k, lambda v: (v * 461845907::ubigint) & 4294967295::ubigint) as k from m2),
f0 as (select page_id, n, k, list_reduce(list_prepend(0::ubigint, k[1 : n // 4]),
  lambda h, v: ((((xor(h, v) << 13::ubigint) & 4294967295::ubigint) | (xor(h, v) >> 19::ubigint)) * 5::ubigint + 3864292196::ubigint) & 4294967295::ubigint) as h from m3),
f1 as (select page_id, xor(case when n % 4 > 0 then xor(h, k[n // 4 + 1]) else h end, n::ubigint) as h from f0),
f2 as (select page_id, (xor(h, h >> 16::ubigint) * 2246822507::ubigint) & 4294967295::ubigint as h from f1),
f3 as (select page_id, (xor(h, h >> 13::ubigint) * 3266489909::ubigint) & 4294967295::ubigint as h from f2),
f4 as (select page_id, xor(h, h >> 16::ubigint)::bigint as h from f3)
select page_id, cast(case when h >= 2147483648 then h - 4294967296 else h end as integer) as hash from f4"""


@query("hash_favicon32", MURMUR_SQL)
def hash_favicon32(spark, sf):
    return table(spark, sf, "pages").select("page_id", hashing.favicon_hash32(F.col("html").cast("binary")).alias("hash"))


# --- scores and labels -----------------------------------------------------------
@query("band", """
select o_orderkey, case when s >= 90 then 'VERY_HIGH' when s >= 75 then 'HIGH' when s >= 50 then 'MODERATE' when s >= 25 then 'LOW' else 'WEAK' end as band
from (select o_orderkey, o_totalprice / 5000.0 as s from orders) t""")
def band(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scores.band(F.col("o_totalprice") / 5000.0).alias("band"))


@query("label_coalesce", """
select p_partkey, coalesce(nullif(case when p_partkey % 4 = 0 then p_name end, ''), nullif(case when p_partkey % 4 = 1 then '' end, ''),
  case when p_partkey % 4 = 2 then p_brand end, case when p_partkey % 8 = 3 then p_type end, 'n' || p_partkey) as label from part""")
def label_coalesce(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", scores.display_label(
        F.when(k % 4 == 0, F.col("p_name")), F.when(k % 4 == 1, ""), F.when(k % 4 == 2, F.col("p_brand")),
        F.when(k % 8 == 3, F.col("p_type")), F.concat(F.lit("n"), k.cast("string")), k.cast("string"),
    ).alias("label"))


@query("ui_severity", """
select o_orderkey, case when s > 0.8 then 'critical' when s > 0.6 then 'high' when s > 0.4 then 'medium' else 'low' end as severity
from (select o_orderkey, o_totalprice / 500000.0 as s from orders) t""")
def ui_severity(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scores.severity(F.col("o_totalprice") / 500000.0).alias("severity"))


@query("ui_letter_band", """
select o_orderkey, case when s >= 80 then 'A' when s >= 60 then 'B' else 'C' end as letter from (select o_orderkey, o_totalprice / 5000.0 as s from orders) t""")
def ui_letter_band(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scores.letter_band(F.col("o_totalprice") / 5000.0).alias("letter"))


KIND = """case p_partkey % 14 when 0 then 'pgp' when 1 then 'wallet' when 2 then 'email' when 3 then 'domain' when 4 then 'onion' when 5 then 'contact_id' when 6 then 'handle'
  when 7 then 'ip' when 8 then 'avatar_hash' when 9 then 'cert_fp' when 10 then 'ssh_key' when 11 then 'favicon_hash' else 'odd' end"""


@query("kind_label", """
select p_partkey, case p_partkey % 14 when 0 then 'PGPKey' when 1 then 'Wallet' when 2 then 'Email' when 3 then 'Domain' when 4 then 'Onion' when 5 then 'ContactID' when 6 then 'Handle'
  when 7 then 'IP' when 8 then 'AvatarHash' when 9 then 'Cert' when 10 then 'SSHKey' when 11 then 'Favicon' else 'Entity' end as label from part""")
def kind_label(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scores.kind_label(F.expr(KIND)).alias("label"))


def values_sql(rows: list[tuple]) -> str:
    def lit(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else ("null" if v is None else repr(v))

    return "(values " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


TYPES = list(fixed.EVIDENCE_TYPES) + ["novel"]


def type_case(key: str) -> str:
    """Evidence type from a number, the same text in both dialects."""
    return f"case {key} % {len(TYPES)} " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(TYPES)) + " end"


@query("why_text", f"""
with w as (select * from {values_sql(list(fixed.WHY_TEXTS.items()))} t(k, v)), o as (select o_orderkey, {type_case('o_orderkey')} as t from orders)
select o_orderkey, coalesce(v, 'Evidence: ' || t) as why from o left join w on k = t""")
def why_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scores.why_text(F.expr(type_case("o_orderkey"))).alias("why"))


# --- vectors and style -----------------------------------------------------------
COS = """case when na * nb = 0 then 0.0 else d / (na * nb) end"""
SQL_COSINE = """
with p as (select a.vec_id as a, b.vec_id as b, list_transform(a.embedding, lambda x: x::double) as u, list_transform(b.embedding, lambda x: x::double) as v
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select a, b, round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 6) as similarity from p"""


@query("cosine", SQL_COSINE)
def cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")).join(b, "a").select(
        "a", "b", F.round(vectors.cosine(F.col("u"), F.col("v")), 6).alias("similarity")
    )


#: Ratios (id, ratio) of lower-case pairs ``hp`` (id, x, y) by recursion over rectangles: runs of equal characters on
#: a diagonal are cut to the rectangle, the longest and then leftmost one is the block. Needs "with recursive".
RATIO_SQL = """
hc as (select id, i, j from (select id, x, y, unnest(range(1, length(x) + 1)) as i from hp) a, lateral (select unnest(range(1, length(y) + 1)) as j) b where substr(x, i, 1) = substr(y, j, 1)),
hr as (select id, min(i) as i, min(j) as j, count(*) as n from (select *, i - row_number() over (partition by id, i - j order by i) as g from hc) t group by id, i - j, g),
hw as (select id, 1 as alo, cast(length(x) + 1 as bigint) as ahi, 1 as blo, cast(length(y) + 1 as bigint) as bhi from hp
 union all
 select id, case k when 0 then alo else -m.i + m.s end, case k when 0 then -m.i else ahi end, case k when 0 then blo else -m.j + m.s end, case k when 0 then -m.j else bhi end
 from (select w.id, alo, ahi, blo, bhi, max({'s': least(r.i + n, ahi, r.i - r.j + bhi) - greatest(r.i, alo, r.i - r.j + blo), 'i': -greatest(r.i, alo, r.i - r.j + blo),
    'j': r.i - r.j - greatest(r.i, alo, r.i - r.j + blo)}) as m
   from hw w join hr r on r.id = w.id and least(r.i + n, ahi, r.i - r.j + bhi) > greatest(r.i, alo, r.i - r.j + blo) group by w.id, alo, ahi, blo, bhi) b, (values (0), (1)) v(k)),
hm as (select w.id, alo, ahi, blo, bhi, max(least(r.i + n, ahi, r.i - r.j + bhi) - greatest(r.i, alo, r.i - r.j + blo)) as s
  from hw w join hr r on r.id = w.id and least(r.i + n, ahi, r.i - r.j + bhi) > greatest(r.i, alo, r.i - r.j + blo) group by w.id, alo, ahi, blo, bhi),
hs as (select id, sum(s) as s from hm group by id),
ha as (select hp.id, case when length(x) + length(y) = 0 then 1.0 else 2.0 * coalesce(s, 0)::double / (length(x) + length(y)) end as ratio from hp left join hs on hs.id = hp.id)"""


@query("handle_ratio", """
with recursive hp as (select c_custkey || '-' || s_suppkey as id, lower(c_name || '_' || c_mktsegment) as x, lower(s_name || '_' || c_mktsegment) as y
  from customer join supplier on c_nationkey = s_nationkey and c_custkey % 10 = s_suppkey % 10), """ + RATIO_SQL + """
select cast(split_part(id, '-', 1) as bigint) as c_custkey, cast(split_part(id, '-', 2) as bigint) as s_suppkey, round(ratio, 6) as ratio from ha""")
def handle_ratio_pairs(spark, sf):
    """Every customer's handle with those of the suppliers of its nation whose numbers end alike."""
    c = table(spark, sf, "customer").withColumn("_e", F.col("c_custkey") % 10)
    s = table(spark, sf, "supplier").withColumn("_e", F.col("s_suppkey") % 10).withColumnRenamed("s_nationkey", "c_nationkey")
    # a pair of handles is compared once for up to 256 rows that have each; few rows make many pairs, so tasks must not merge
    group, tasks = ["c_nationkey", "_e"], int(spark.conf.get("spark.sql.shuffle.partitions"))

    def holders(rows, key: str, *handle: str):
        each = rows.groupBy(*group, *handle).agg(F.collect_list(key).alias("all"))
        starts = F.sequence(F.lit(1), F.size("all"), F.lit(256))
        return each.select(*group, *handle, "all", F.explode(starts).alias("at")).select(*group, *handle, F.slice("all", F.col("at"), 256).alias(key)).repartition(tasks, *group)

    handle = lambda name: F.lower(F.concat(name, F.lit("_"), "c_mktsegment"))
    pairs = holders(c, "c_custkey", "c_name", "c_mktsegment").join(holders(s, "s_suppkey", "s_name"), group)
    pairs = pairs.select("c_custkey", "s_suppkey", handle("c_name").alias("x"), handle("s_name").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ratios = pair_ratios(b.column("x").to_pylist(), b.column("y").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("c_custkey"), b.column("s_suppkey"), pa.array(ratios, pa.float64())], ["c_custkey", "s_suppkey", "ratio"])

    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    compared = pairs.mapInArrow(compare, f"c_custkey {kind['c_custkey']}, s_suppkey {kind['s_suppkey']}, ratio double")
    ratios = cut_lineage(compared.withColumn("ratio", F.round("ratio", 6)), "handle-ratios")
    return ratios.select(F.explode("c_custkey").alias("c_custkey"), "s_suppkey", "ratio").select("c_custkey", F.explode("s_suppkey").alias("s_suppkey"), "ratio")


SQL_STYLE = r"""
with t as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\s\pZ]+'), lambda w: w <> '') as w from documents),
u as (select *, list_transform(w, lambda x: lower(x)) as lw, list_transform(w, lambda x: length(x)::double) as wl,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: len(list_filter(regexp_split_to_array(s, '[\s\pZ]+'), lambda w: w <> ''))::double), lambda n: n > 0) as sl from t)
select doc_id,
  round(len(list_filter(lw, lambda x: x = 'the'))::double / greatest(len(w), 1), 6) as fw_the,
  round(len(list_filter(lw, lambda x: x = 'of'))::double / greatest(len(w), 1), 6) as fw_of,
  round((length(text) - length(replace(text, ',', '')))::double / greatest(length(text), 1), 6) as punct_comma,
  round(((length(text) - length(replace(text, '...', ''))) / 3)::double / greatest(length(text), 1), 6) as ellipsis_count,
  round(coalesce(list_avg(wl), 0), 6) as avg_word_length, round(coalesce(list_stddev_pop(wl), 0), 6) as std_word_length,
  round(coalesce(list_avg(sl), 0), 6) as avg_sentence_length, round(coalesce(list_stddev_pop(sl), 0), 6) as std_sentence_length,
  round(len(list_distinct(lw))::double / greatest(len(w), 1), 6) as vocabulary_richness,
  round(length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::double / greatest(length(text), 1), 6) as uppercase_ratio,
  round(length(regexp_replace(text, '[^\p{Nd}]', '', 'g'))::double / greatest(length(text), 1), 6) as digit_ratio
from u"""
STYLE_SHOWN = [
    "fw_the", "fw_of", "punct_comma", "ellipsis_count", "avg_word_length", "std_word_length", "avg_sentence_length",
    "std_sentence_length", "vocabulary_richness", "uppercase_ratio", "digit_ratio",
]


@query("style_features", SQL_STYLE)
def style_features(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", style.feature_vector(F.col("text")).alias("v"))
    return docs.select("doc_id", *[F.round(F.get("v", F.lit(style.slot(n))), 6).alias(n) for n in STYLE_SHOWN])


@query("sty_sufficient", "select doc_id from documents where length(text) >= 100")
def sty_sufficient(spark, sf):
    return table(spark, sf, "documents").filter(style.is_sufficient(F.col("text"))).select("doc_id")
