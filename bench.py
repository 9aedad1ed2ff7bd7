"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS (median of that many runs) and BENCH_QUERIES (comma-separated
names) change what runs.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from duskwire.plans import catalog
from duskwire.plans.inputs import table
from duskwire.session import build_session

HEADLINE = [
    "red_pii", "ext_all", "ingest_batch", "agg_entity_span", "jn_observation", "agg_cooccur", "agg_merge",
    "html_strip", "html_links", "gate_policy", "feed_ransom_victim", "feed_btc",
    "infra_all", "jn_skew", "win_cumulative", "agg_health", "win_gap",
    "gr_ego", "agg_graph_stats", "gr_components", "gr_transfers",
    "agg_link_score", "rb_candidates", "rb_alerts", "sty_word", "sty_char", "style_features",
    "txt_search", "prov_merkle", "snk_dossier_flat", "st_rate", "st_ingest",
]


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's compilers and the Python workers before the clock runs
    table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity")).collect()
    run(spark, "ext_email", sf)
    times: dict[str, float] = {}
    for name in names:
        times[name] = round(statistics.median(run(spark, name, sf) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
