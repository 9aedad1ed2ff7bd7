"""Input tables of the domain, derived from the supplied tables over all their rows.

Each derivation is one SQL text for two dialects, so that a query and its reference SQL start
from the same rows. Ids are spread so that groups keep their size as the tables grow.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Spark:
    text = "string"

    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"({a} div {b})"

    @staticmethod
    def sha(x: str) -> str:
        return f"sha2(cast({x} as string), 256)"

    @staticmethod
    def ts(seconds: str) -> str:
        return f"timestamp_seconds({seconds})"

    @staticmethod
    def epoch(ts: str) -> str:
        return f"unix_seconds({ts})"

    @staticmethod
    def arr(*items: str) -> str:
        return f"array({', '.join(items)})"


class Duck:
    text = "varchar"

    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"({a} // {b})"

    @staticmethod
    def sha(x: str) -> str:
        return f"sha256(cast({x} as varchar))"

    @staticmethod
    def ts(seconds: str) -> str:
        return f"make_timestamp(cast(({seconds}) * 1000000 as bigint))"

    @staticmethod
    def epoch(ts: str) -> str:
        return f"cast(floor(epoch({ts})) as bigint)"

    @staticmethod
    def arr(*items: str) -> str:
        return f"[{', '.join(items)}]"


BASE = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def _s(d, x: str) -> str:
    return f"cast({x} as {d.text})"


def _tag(d, name: str, x: str) -> str:
    """Hash of a named id."""
    return d.sha(f"'{name}' || {_s(d, x)}")


def _onion(d, x: str) -> str:
    return f"(substr(translate({_tag(d, 'onion', x)}, '0189', 'ghij'), 1, 56) || '.onion')"


def _wallet(d, x: str) -> str:
    return f"('1' || translate(substr({_tag(d, 'btc', x)}, 1, 33), '0', 'x'))"


def _posts(d) -> str:
    a = d.idiv
    line = "chr(10)"
    marks = {
        0: [
            f"'PGP: ' || upper(substr({_tag(d, 'pgp', a('doc_id', '6'))}, 1, 40))",
            f"'pay bc1q' || translate(substr({_tag(d, 'seg', a('doc_id', '5'))}, 1, 40), '1b', 'qz')",
            f"'chat @vend_' || {_s(d, a('doc_id', '8'))} || 'x'",
        ],
        1: [
            f"'ETH 0x' || upper(substr({_tag(d, 'eth', a('doc_id', '7'))}, 1, 40))",
            f"'mirror ' || {_onion(d, a('doc_id', '9'))}",
            f"'session 05' || {_tag(d, 'ses', a('doc_id', '8'))}",
            f"'BTC ' || {_wallet(d, a('doc_id', '6'))}",
        ],
        2: [
            f"'XMR 4' || substr({_tag(d, 'xmr', a('doc_id', '5'))} || {_tag(d, 'xm2', a('doc_id', '5'))}, 1, 94)",
            f"'jid u' || {_s(d, a('doc_id', '8'))} || '@jabber.chat' || {_s(d, 'doc_id % 7')} || '.im'",
            f"'Wickr: wk' || {_s(d, a('doc_id', '8'))}",
            f"'mail m' || {_s(d, a('doc_id', '6'))} || '@protonmail.com'",
            f"'shop' || {_s(d, a('doc_id', '6'))} || '.market'",
        ],
        3: [
            f"'TRC T' || translate(substr({_tag(d, 'trx', a('doc_id', '5'))}, 1, 33), '0', 'x')",
            f"'P2SH 3' || translate(substr({_tag(d, 'psh', a('doc_id', '5'))}, 1, 33), '0', 'x')",
            f"'-----BEGIN PGP PUBLIC KEY BLOCK-----' || chr(10) || {_tag(d, 'blk', 'doc_id')} || chr(10) || '-----END PGP PUBLIC KEY BLOCK-----'",
            f"'host 10.' || {_s(d, 'doc_id % 256')} || '.' || {_s(d, a('doc_id', '256') + ' % 256')} || '.7'",
            f"'fpr ' || substr({_tag(d, 'pgp', a('doc_id', '6'))}, 1, 40)",
        ],
    }
    cases = " ".join(
        f"when {k} then {(' || ' + line + ' || ').join(v)}" for k, v in marks.items()
    )
    sign = (
        f"case doc_id % 3 when 0 then '-- User' || {_s(d, a('doc_id', '4'))} "
        f"when 1 then 'Regards, User' || {_s(d, a('doc_id', '4'))} else '- User' || {_s(d, a('doc_id', '4'))} end"
    )
    return f"""
select doc_id as post_id, {_s(d, 'doc_id')} as event_id, source as source_id, source as market, lang as language,
  {_s(d, a('doc_id', '4'))} as actor_id, 'User' || {_s(d, a('doc_id', '4'))} as handle,
  {d.ts(f'{BASE} + doc_id * 3600')} as posted_at, {d.ts(f'{BASE} + doc_id * 3600')} as observed_at,
  text || {line} || case doc_id % 4 {cases} end || {line} || {sign} as text
from documents"""


def _actors(d) -> str:
    return f"""
select {_s(d, 'c_custkey')} as actor_id, c_name as label, c_mktsegment as category,
  min(o_orderdate) as first_seen, max(o_orderdate) as last_seen,
  case when max(o_orderdate) < timestamp '2001-06-01 00:00:00' then 'dormant' else 'active' end as status
from customer join orders on o_custkey = c_custkey
group by c_custkey, c_name, c_mktsegment"""


def _personas(d) -> str:
    """Customer activity per quarter: one persona each, with identifiers of the customer."""
    q = "(year(o_orderdate) * 4 + quarter(o_orderdate))"
    c, k = "c", "q"
    pgp = f"upper(substr({_tag(d, 'pgp', d.idiv('c', '2'))}, 1, 40))"
    return f"""
select {_s(d, c)} || '-' || {_s(d, k)} as actor_id, 'Trader' || {_s(d, c)} || '.' || {_s(d, 'q % 3')} as handle,
  first_seen, last_seen, 'active' as status,
  {d.arr(pgp)} as pgp_fingerprints,
  {d.arr(_wallet(d, d.idiv('c', '3')), _wallet(d, 'c + 1000000'))} as wallet_addresses,
  {d.arr("'@tg' || " + _s(d, d.idiv('c', '2')))} as contact_ids,
  {d.arr("'Trader' || " + _s(d, c) + " || '.' || " + _s(d, 'q % 3'), "'Alt' || " + _s(d, c))} as handles,
  {d.arr("cast(c % 7 + 1 as double)", "cast(c % 5 + 1 as double)", "cast(q % 4 as double)")} as style_vector
from (select o_custkey as c, {q} as q, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen
      from orders group by o_custkey, {q}) t"""


def _onions(d) -> str:
    s, k = _s(d, "s_suppkey"), "s_suppkey"
    return f"""
select {_onion(d, k)} as address,
  {d.arr("'h' || " + _s(d, k + ' * 4') + " || '.example.com'", "'*.s' || " + s + " || '.Example.org'", "'other' || " + s + " || '.example.net'")} as tls_cert_sans,
  {_tag(d, 'crt', k)} as tls_cert_fingerprint, md5('fav' || {s}) as favicon_hash,
  case when s_suppkey % 4 = 0 then 'Nginx' else 'Srv/' || {s} || ' ' end as server_banner,
  {d.arr("'Server'", "'Date'", "'X-App-' || " + s, "'Via'")} as header_order,
  {_tag(d, 'ssh', k)} as ssh_host_key, md5('err' || {s}) as error_page_hash,
  'ServerName: H' || {_s(d, k + ' * 2')} || '.example.com' || chr(10) || 'hostname = h' || {_s(d, k + ' * 6')} || '.example.com'
    || chr(10) || 'server_name w' || {_s(d, k + ' * 10 + 1')} || '.s' || {s} || '.example.org;' as status_page_text
from supplier"""


def _hosts(d) -> str:
    c, k = _s(d, "c_custkey"), "c_custkey"
    g = lambda n: _s(d, d.idiv(k, n))
    return f"""
select case when c_custkey % 2 = 0 then 'h' || {c} || '.example.com' else 'w' || {c} || '.s' || {g('10')} || '.example.org' end as host,
  {d.arr("'h' || " + c)} as tls_cert_sans, {_tag(d, 'crt', k)} as tls_cert_fingerprint, md5('fav' || {g('5')}) as favicon_hash,
  case when c_custkey % 6 = 0 then 'nginx' else 'srv/' || {g('9')} end as server_banner,
  {d.arr("'server'", "'DATE'", "'x-app-' || " + g('4'), "'via'")} as header_order,
  {_tag(d, 'ssh', d.idiv(k, '3'))} as ssh_host_key, md5('err' || {g('7')}) as error_page_hash
from customer"""


def _probes(d) -> str:
    """Events as clock probes: one URL per user, skew around a level of the user."""
    return f"""
select 'http://site' || {_s(d, 'user_id')} || '.example.com/' as url, ts as probed_at,
  round(user_id * 0.4 + value * 0.001, 3) as clock_skew, event_id
from events"""


def _vertices(d) -> str:
    s = lambda x: _s(d, x)
    return f"""
select 'a' || {s('c_custkey')} as id, 'Actor' as label, c_name as value from customer
union all
select 'e' || {s('p_partkey')}, case p_partkey % 7 when 0 then 'Handle' when 1 then 'Wallet' when 2 then 'PGPKey'
  when 3 then 'Email' when 4 then 'Onion' when 5 then 'Domain' else 'IP' end, p_name || ' ' || p_brand from part
union all
select 'w' || {s('s_suppkey')}, 'WalletCluster', s_name from supplier"""


def _edges(d) -> str:
    s = lambda x: _s(d, x)
    return f"""
select distinct 'a' || {s('o_custkey')} as src, 'e' || {s('l_partkey')} as dst, 'USES' as type
from lineitem join orders on l_orderkey = o_orderkey
union all
select distinct 'e' || {s('l_partkey')}, 'w' || {s('l_suppkey')}, 'MEMBER_OF' from lineitem"""


def _tx_inputs(d) -> str:
    """Transaction inputs: orders of a block of 50 share neighbouring addresses."""
    block = d.idiv("l_orderkey", "50")
    addr = f"'bc' || {_s(d, block)} || '-' || {_s(d, '(l_orderkey % 50) + l_linenumber')}"
    return f"select l_orderkey as txid, l_linenumber as pos, {addr} as address from lineitem"


def _transfers(d) -> str:
    return f"""
select 'w' || {_s(d, 'o_custkey')} as from_address, 'w' || {_s(d, 'l_suppkey')} as to_address,
  l_extendedprice as amount, l_shipdate as ts
from lineitem join orders on l_orderkey = o_orderkey"""


def _sources(d) -> str:
    return f"""
select source as source_id, case when n % 3 = 0 then 'forum' else 'feed' end as source_type,
  case when n = 3 then 'disabled' when n % 5 = 1 then 'authorized' else 'approved' end as authorization_status,
  case when n = 6 then null else 'ref-' || source end as authorization_ref,
  n <> 4 as enabled, case when n = 9 then 0 else n * 2 + 1 end as retention_days,
  case when n % 2 = 0 then 'redact_all' else 'keep' end as pii_policy, 'C' as reliability_grade
from (select distinct source, cast(substr(source, 4) as int) as n from documents) t"""


def _refs(d) -> str:
    return f"""
select source as source_id, doc_id, 'https://n' || {_s(d, 'doc_id % 50')} || '.example.com/doc/' || {_s(d, 'doc_id')} as url,
  case doc_id % 6 when 0 then 'text/html; charset=utf-8' when 1 then ' Text/Plain' when 2 then 'application/json'
    when 3 then 'image/jpeg' when 4 then 'application/xml' else 'text/html' end as content_type,
  n_chars * 4000 as size_bytes
from documents"""


def _runs(d) -> str:
    return f"""
select event_type as source, ts as run_at, event_id as run_id, user_id % 4 as items from events"""


def _requests(d) -> str:
    return f"""
select 'u' || {_s(d, 'user_id')} as source_id, ts as at, event_id as seq,
  event_type <> 'error' and event_type <> 'signup' as ok,
  case when event_type = 'error' and value > 50 then 429 when event_type = 'error' then 500 else 200 end as http_status
from events"""


BUILDERS = {
    "posts": _posts, "actors": _actors, "personas": _personas, "onions": _onions, "hosts": _hosts, "probes": _probes,
    "vertices": _vertices, "edges": _edges, "tx_inputs": _tx_inputs, "transfers": _transfers, "sources": _sources,
    "refs": _refs, "runs": _runs, "requests": _requests,
}


WIDE = ("documents", "pages")


def utc_schema(spark: SparkSession, path: str) -> StructType:
    """Schema of a Parquet table with zone-less times read as UTC instants."""
    fields = spark.read.parquet(path).schema.fields
    return StructType([
        StructField(f.name, TimestampType() if isinstance(f.dataType, TimestampNTZType) else f.dataType, True)
        for f in fields
    ])


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A supplied table. Text tables in fewer files than there are cores are spread over the cores, others with ``spread``.

    A file of one row group is read by one task, which then does all that follows up to the next shuffle.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.schema(utc_schema(spark, path)).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if (spread or name in WIDE) and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def spark_sql(spark: SparkSession, sf_dir: str, text: str, spread: bool = False) -> DataFrame:
    """Run SQL text over the supplied tables without registering anything in the session; ``spread`` as for ``table``."""
    import re

    text = text.replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t, spread) for t in used})


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, BUILDERS[name](Spark))


def ctes(*names: str) -> str:
    """WITH clause of the named inputs for reference SQL."""
    return "with " + ",\n".join(f"{n} as ({BUILDERS[n](Duck)})" for n in names)
