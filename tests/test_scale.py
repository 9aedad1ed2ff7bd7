"""Operators that must stay exact when one key holds a third of all rows."""
import itertools
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from duskwire.lineage import scratch_root
from duskwire.operators import graph, metrics, ordering, overlap, wallets


def skewed_rows(n=300):
    rnd = random.Random(5)
    return [("hot" if i % 3 == 0 else f"k{rnd.randrange(40)}", i, rnd.randrange(5)) for i in rnd.sample(range(n), n)]


def test_running_sums_split_a_hot_key(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r["k"], r["o"]): (r["rn"], r["s"]) for r in ordering.running_sums(df, ["k"], ["o"], {"rn": F.lit(1), "s": F.col("v")}, ranges=7).collect()}
    want, seen = {}, defaultdict(lambda: [0, 0])
    for k, o, v in sorted(rows):
        seen[k][0] += 1
        seen[k][1] += v
        want[(k, o)] = tuple(seen[k])
    assert got == want


def test_neighbours_across_ranges(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r["k"], r["o"]): (r["prev"], r["next"]) for r in ordering.neighbours(df, ["k"], ["o"], "o", ranges=7).collect()}
    by = defaultdict(list)
    for k, o, _ in sorted(rows):
        by[k].append(o)
    want = {(k, o): (os[i - 1] if i else None, os[i + 1] if i + 1 < len(os) else None) for k, os in by.items() for i, o in enumerate(os)}
    assert got == want


@pytest.mark.parametrize("t", [1, 2, 3])
@pytest.mark.parametrize("direct", [5, 1000])
def test_overlap_equals_brute_force(spark, t, direct):
    rnd = random.Random(t)
    rel = {(f"i{i:02d}", f"g{g}") for i in range(40) for g in rnd.sample(range(25), rnd.randrange(1, 6))}
    rel |= {(f"i{i:02d}", g) for i in range(40) for g in ("hot1", "hot2") if rnd.random() < 0.7}
    kind = {f"i{i:02d}": f"k{i % 3}" for i in range(40)}
    df = spark.createDataFrame([(a, g, kind[a]) for a, g in rel], "item string, grp string, kind string")
    got = {(r["item_a"], r["item_b"]): r["shared"] for r in overlap.shared_groups(df, "item", "grp", t, "kind", direct).collect()}
    groups = defaultdict(set)
    for a, g in rel:
        groups[g].add(a)
    want = Counter(p for m in groups.values() for p in itertools.combinations(sorted(m), 2) if kind[p[0]] != kind[p[1]])
    assert got == {p: n for p, n in want.items() if n >= t}


def test_components_equal_union_find(spark):
    rnd = random.Random(9)
    edges = [(f"n{rnd.randrange(120)}", f"n{rnd.randrange(120)}") for _ in range(90)]
    edges += [("hub", f"m{i}") for i in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("self", "self")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    members = defaultdict(list)
    for x in list(parent):
        members[find(x)].append(x)
    want = {x: min(m) for m in members.values() for x in m}
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r["id"]: r["component"] for r in graph.components(df).collect()} == want


def test_overview_looks_at_the_first_edges_alone(spark):
    """Same edges whether the first look suffices, equal or dangling edges fill it, or all edges are matched."""
    rnd = random.Random(2)
    ids = [f"n{i}" for i in range(30)]
    edges = [("a0", "n1", "t")] * 40 + [(rnd.choice(ids), rnd.choice([*ids, "gone"]), rnd.choice("xy")) for _ in range(200)]
    vertices = spark.createDataFrame([(i,) for i in ids], "id string")
    for given in (edges, edges[40:], edges[40:42]):
        want = sorted({e for e in given if e[0] in ids and e[1] in ids})[:6]
        for looks in ((2, 4), (4, 64), ()):
            df = spark.createDataFrame(given, "src string, dst string, type string").repartition(3)
            assert [tuple(r) for r in graph.overview_edges(vertices, df, 2, looks).collect()] == want


def test_co_spent_keeps_transactions_apart(spark):
    rows = [("t1", 0, "A"), ("t1", 1, "B"), ("t2", 0, "B"), ("t2", 1, "C"), ("t3", 0, "D")]
    inputs = spark.createDataFrame(rows, "txid string, pos int, address string")
    clusters, members = wallets.co_spent_clusters(inputs)
    assert {r["cluster_id"]: r["size"] for r in clusters.collect()} == {"cluster_A": 2, "cluster_B": 2}
    assert {(r["cluster_id"], r["address"]) for r in members.collect()} == {("cluster_A", "A"), ("cluster_A", "B"), ("cluster_B", "B"), ("cluster_B", "C")}
    assert {r["id"]: r["component"] for r in wallets.ownership_components(inputs).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D"}


def test_tasks_contract_edges_between_whole_numbers(spark, monkeypatch):
    rnd = random.Random(5)
    edges = [(a, max(0, a - rnd.randint(0, 3))) for a in (rnd.randint(0, 400) + 70_000 * rnd.randint(0, 2) for _ in range(3000))] + [(70_001, 2), (5, 5)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    want = {r["id"]: r["component"] for r in graph.components(df).collect()}
    for lot in (1_000_000, 200):
        monkeypatch.setattr(graph, "GATHER", lot)
        frames = list(graph.forest_of_task(iter([pd.DataFrame(edges, columns=["u", "v"])[i:i + 150] for i in range(0, len(edges), 150)])))
        assert lot == 200 or sum(map(len, frames)) < len(want)
        held = spark.createDataFrame(pd.concat(frames), "u long, v long").toDF("src", "dst")
        got = {r["id"]: r["component"] for r in graph.components(held).collect()}
        assert all(got.get(k, k) == v for k, v in want.items())
    small = graph.contracted(df).collect()
    assert len(small) < len(want) and all(r["src"] > r["dst"] for r in small)


def test_owners_of_addresses_in_any_order(spark):
    rnd = random.Random(9)
    rows = [(t, f"bc{rnd.randint(0, 300)}" if rnd.random() < 0.99 else None) for t in range(220) for _ in range(rnd.randint(1, 3))] + [(None, "lost")]
    inputs = spark.createDataFrame(rows, "txid long, address string").repartition(3)
    hubs = {}
    for t, a in rows:
        if t is not None and a is not None:
            hubs.setdefault(t, set()).add(a)
    edges = [(a, min(group)) for group in hubs.values() for a in group]
    want = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    got = {r["id"]: r["component"] for r in wallets.ownership_components(inputs).collect()}
    assert got == want | {None: None}


def test_auc_equals_pairwise_count(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(12), rnd.randrange(2)) for _ in range(150)]
    got = metrics.roc_auc(spark.createDataFrame(rows, "score long, label int")).first()
    pos, neg = [s for s, l in rows if l], [s for s, l in rows if not l]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got["auc"] == pytest.approx(want) and (got["n_pos"], got["n_neg"]) == (len(pos), len(neg))


def test_health_streaks(spark):
    log = [("a", i, ok, code) for i, (ok, code) in enumerate([(False, 500), (True, 200), (False, 429), (False, 500)])]
    log += [("b", i, False, 500) for i in range(6)] + [("c", 0, True, 200)]
    df = spark.createDataFrame([(s, i, i, ok, c) for s, i, ok, c in log], "source_id string, t long, seq long, ok boolean, http_status int")
    got = {r["source_id"]: r for r in metrics.source_health(df.withColumn("at", F.timestamp_seconds("t"))).collect()}
    assert (got["a"]["consecutive_failures"], got["a"]["consecutive_429s"], got["a"]["status"], got["a"]["backoff_seconds"]) == (2, 1, "degraded", 120.0)
    assert (got["b"]["status"], got["b"]["backoff_seconds"]) == ("offline", 600.0)
    assert (got["c"]["status"], got["c"]["backoff_seconds"]) == ("online", 0.0)


def test_parts_split_only_large_keys(spark):
    df = spark.createDataFrame([("big", str(i)) for i in range(100)] + [("small", "x")], "k string, id string")
    parts = ordering.split_parts(df, ["k"], "id", 20)
    got = {r["k"]: (r["n"], r["p"]) for r in parts.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("part").alias("p")).collect()}
    assert got == {"big": (100, 5), "small": (1, 1)}


def test_scratch_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert scratch_root(spark) == configured.rstrip("/")


def test_tasks_of_pair_counts_follow_the_pairs(spark, monkeypatch):
    rel = spark.createDataFrame([(i, g) for g in range(10) for i in range(g, g + 21)], "item long, grp long")
    assert overlap._tasks(rel, "grp") == 4
    monkeypatch.setattr(overlap, "PAIRS_PER_TASK", 100)
    assert overlap._tasks(rel, "grp") == 21
    got = {(r["item_a"], r["item_b"]): r["shared"] for r in overlap.shared_groups(rel, "item", "grp", 2).collect()}
    groups = [set(range(g, g + 21)) for g in range(10)]
    want = {(a, b): sum(a in s and b in s for s in groups) for a, b in itertools.combinations(range(31), 2)}
    assert got == {p: n for p, n in want.items() if n >= 2}
