"""Registered queries against their reference SQL on the smallest tables."""
import os

import pytest

import __spark_entry__ as entry
from tools.check_oracles import rows_of

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "ext_all", "red_pii", "gate_policy", "feed_relay", "agg_cooccur", "infra_all", "jn_skew", "win_cumulative", "win_gap",
    "gr_components", "agg_link_score", "prov_merkle", "sty_word", "st_rate", "st_span",
]


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    from duskwire.plans.inputs import TABLES

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    assert "score" in entry.entry(spark).columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_feeds_of_a_table_in_one_file_are_spread_over_the_cores(spark):
    from duskwire.plans import q_feeds

    cores = spark.sparkContext.defaultParallelism
    for name in ("feed_ransom_victim", "feed_c2", "feed_pulse"):
        rows = q_feeds.landed(spark, "/root/testdata/sf0.001", name)
        assert cores > 1 and rows.rdd.getNumPartitions() >= cores
