"""Graph queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages
from ..operators import graph, wallets
from .inputs import BUILDERS, Spark, ctes, derived, spark_sql, table
from .q_text import SQL_LINKS
from .registry import query

G = ctes("vertices", "edges")

REACH = G + """
, both_ways as (select src, dst from edges union select dst, src from edges),
h1 as (select distinct dst as id from both_ways where src = 'a7' and dst <> 'a7'),
h2 as (select distinct dst as id from both_ways join h1 on src = id where dst <> 'a7' and dst not in (select id from h1)),
reached as (select 'a7' as id, 0 as hops union all select id, 1 from h1 union all select id, 2 from h2)"""


def _seed(spark, sf):
    return derived(spark, sf, "vertices").filter("id = 'a7'").select("id")


@query("gr_ego", REACH + " select id, hops from reached")
def gr_ego(spark, sf):
    return graph.ego_nodes(derived(spark, sf, "edges"), _seed(spark, sf), 2)


@query("gr_ego_edges", REACH + """
, inner_ids as (select id from reached where hops < 2)
select distinct src, dst, type from edges where src in (select id from inner_ids) or dst in (select id from inner_ids)""")
def gr_ego_edges(spark, sf):
    edges = derived(spark, sf, "edges")
    return graph.ego_edges(edges, graph.ego_nodes(edges, _seed(spark, sf), 2), 2)


@query("gr_overview", G + """
select src, dst, type from edges where src in (select id from vertices) and dst in (select id from vertices) order by src, dst, type limit 900""")
def gr_overview(spark, sf):
    # equal edges are dropped when few are left, as a task would hold all edges of its input to tell them apart
    edges = spark_sql(spark, sf, BUILDERS["edges"](Spark).replace("select distinct ", "select "))
    return graph.overview_edges(derived(spark, sf, "vertices"), edges)


@query("gr_overview_nodes", G + " select id, label, value from vertices order by id limit 300")
def gr_overview_nodes(spark, sf):
    return graph.overview_nodes(derived(spark, sf, "vertices"))


@query("gr_filter", G + """
, shown as (select id from vertices where (label in ('Actor', 'Onion') or label not in ('Actor', 'Wallet', 'PGPKey', 'Onion', 'Handle', 'Domain')) and (contains(lower(value), '1') or contains(lower(id), '1')))
select src, dst, type from edges where src in (select id from shown) and dst in (select id from shown)""")
def gr_filter(spark, sf):
    hidden_free = ["Wallet", "PGPKey", "Handle"]
    nodes, edges = graph.filter_view(
        derived(spark, sf, "vertices").filter("label <> 'Domain'"), derived(spark, sf, "edges"), hidden_free, " 1 "
    )
    return edges.select("src", "dst", "type")


@query("agg_graph_stats", G + """
, n(name) as (values ('Actor'), ('Handle'), ('Wallet'), ('PGPKey'), ('Email'), ('Onion'), ('ContactID'), ('Domain'), ('IP'), ('WalletCluster')),
r(name) as (values ('USES'), ('LINKED_TO'), ('SHARES_FINGERPRINT'), ('SHARES_CLOCK_SKEW'), ('MEMBER_OF'), ('SENT_TO'))
select 'node_' || lower(name) as metric, count(label) as n from n left join vertices on label = name group by name
union all select 'rel_' || lower(name), count(type) from r left join edges on type = name group by name
union all select 'total_nodes', count(*) from vertices union all select 'total_edges', count(*) from edges""")
def agg_graph_stats(spark, sf):
    return graph.stats(derived(spark, sf, "vertices"), derived(spark, sf, "edges"))


TX = ctes("tx_inputs")


@query("gr_wallet_cluster", TX + """
, t as (select txid, count(*) as size, arg_min(address, pos) as f from tx_inputs group by txid having count(*) >= 2)
select 'cluster_' || f as cluster_id, arg_max(size, txid) as size from t group by 1""")
def gr_wallet_cluster(spark, sf):
    clusters, _ = wallets.co_spent_clusters(derived(spark, sf, "tx_inputs"))
    return clusters.select("cluster_id", "size")


@query("gr_wallet_members", TX + """
, t as (select txid, arg_min(address, pos) as f from tx_inputs group by txid having count(*) >= 2)
select distinct 'cluster_' || f as cluster_id, address from tx_inputs join t using (txid)""")
def gr_wallet_members(spark, sf):
    return wallets.co_spent_clusters(derived(spark, sf, "tx_inputs"))[1]


CC_SQL = TX + """
, hub as (select txid, min(address) as h from tx_inputs group by txid), e as (select distinct address as a, h as b from tx_inputs join hub using (txid)),
w as (select a, b from e union select b, a from e)"""


def components_sql() -> str:
    return CC_SQL.replace("with ", "with recursive ", 1) + """
, reach(id, r) as (select a, a from w union select reach.id, w.b from reach join w on w.a = reach.r)
select id, min(r) as component from reach group by id"""


@query("gr_components", components_sql())
def gr_components(spark, sf):
    return wallets.ownership_components(derived(spark, sf, "tx_inputs"))


@query("gr_transfers", ctes("transfers") + """
select from_address as src, to_address as dst, round(sum(amount), 2) as amount, count(*) as n_tx, min(ts) as first_ts, max(ts) as last_ts from transfers group by 1, 2""")
def gr_transfers(spark, sf):
    out = wallets.transfers(derived(spark, sf, "transfers"))
    return out.select("src", "dst", F.round("amount", 2).alias("amount"), "n_tx", "first_ts", "last_ts")


PAGE_KEY = "lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/:?#]+)', 1)) || rtrim(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/')"
LINKS_CTE = SQL_LINKS.strip().replace("select page_id, unnest(list_sort", "lk as (select page_id, unnest(list_sort").replace(" group by page_id", " group by page_id)")
LINKS_CTE = LINKS_CTE[: LINKS_CTE.index("lk as (")].rstrip().rstrip(",") + ", " + LINKS_CTE[LINKS_CTE.index("lk as ("):]


@query("gr_frontier", LINKS_CTE + f""", k as (select page_id, {PAGE_KEY} as u from pages),
e as (select distinct k.u as src, link as dst from lk join k using (page_id)),
seeds as (select distinct u from k where regexp_matches(u, '\\.example\\.com/')),
d0 as (select url, domain from (select u as url, regexp_extract(u, '://([^/]+)', 1) as domain, row_number() over (partition by regexp_extract(u, '://([^/]+)', 1) order by u) as rn from seeds) t where rn <= 4),
n1 as (select distinct dst as url from d0 join e on e.src = d0.url where dst not in (select u from seeds)),
d1 as (select url, domain from (select url, regexp_extract(url, '://([^/]+)', 1) as domain, row_number() over (partition by regexp_extract(url, '://([^/]+)', 1) order by url) as rn from n1) t
  where rn + (select count(*) from d0 where d0.domain = t.domain) <= 4),
n2 as (select distinct dst as url from d1 join e on e.src = d1.url where dst not in (select u from seeds) and dst not in (select url from n1)),
d2 as (select url, domain from (select url, regexp_extract(url, '://([^/]+)', 1) as domain, row_number() over (partition by regexp_extract(url, '://([^/]+)', 1) order by url) as rn from n2) t
  where rn + (select count(*) from d0 where d0.domain = t.domain) + (select count(*) from d1 where d1.domain = t.domain) <= 4)
select url, domain, 0 as depth from d0 union all select url, domain, 1 from d1 union all select url, domain, 2 from d2""".replace("\\\\", "\\"))
def gr_frontier(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", "html")
    here = F.concat(pages.scheme(F.col("url")), F.lit("://"), pages.host(F.col("url")), F.rtrim(pages.path(F.col("url")), F.lit("/")))
    links = p.select(here.alias("src"), F.explode(pages.links(F.col("html"), F.col("url"), ".example.com")).alias("dst")).distinct()
    seeds = p.select(here.alias("url")).filter(F.endswith(pages.host(F.col("url")), F.lit(".example.com"))).distinct()
    seeds = seeds.filter(F.col("url").rlike(r"\.example\.com/"))
    return graph.frontier(links, seeds, 2, per_domain=4)
