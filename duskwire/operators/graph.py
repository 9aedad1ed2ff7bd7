"""Property-graph queries over ``vertices(id, label, ...)`` and ``edges(src, dst, type, ...)``."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.pages import host
from ..lineage import cut_lineage
from .ordering import newest_per_key


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def ego_nodes(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(id, hops) of all nodes within ``depth`` hops of the seeds; depth is held within 1..5.

    ``seeds``: column id. Each round joins the frontier only, and a node enters once.
    """
    depth = max(1, min(depth, 5))
    step = both_ways(edges)
    reached = seeds.select("id", F.lit(0).alias("hops")).distinct()
    frontier = reached
    for hop in range(1, depth + 1):
        found = (
            frontier.select(F.col("id").alias("src"))
            .join(step, "src")
            .select(F.col("dst").alias("id"))
            .distinct()
            .join(reached, "id", "left_anti")
            .withColumn("hops", F.lit(hop))
        )
        frontier = cut_lineage(found, "ego")
        reached = reached.unionByName(frontier)
    return reached


def ego_edges(edges: DataFrame, reached: DataFrame, depth: int = 2) -> DataFrame:
    """Edges on a path of at most ``depth`` hops: one end lies within ``depth - 1``."""
    depth = max(1, min(depth, 5))
    inner = reached.filter(F.col("hops") < depth).select("id")
    from_src = edges.join(inner, edges["src"] == inner["id"], "left_semi")
    from_dst = edges.join(inner, edges["dst"] == inner["id"], "left_semi")
    return from_src.unionByName(from_dst).distinct()


def overview_nodes(vertices: DataFrame, limit: int = 300) -> DataFrame:
    return vertices.orderBy("id").limit(limit)


def overview_edges(vertices: DataFrame, edges: DataFrame, limit: int = 300, looks: tuple[int, ...] = (4, 64)) -> DataFrame:
    """First edges of the graph, three per shown node, without those that lack an end; equal edges count once.

    The first rows of ``edges``, in order, hold every edge up to the last of them. So a look at some times as many rows as
    are shown, of which a task holds no more, mostly finds all; else all edges are matched with the vertices.
    """
    order = ["src", "dst", "type"]
    ids, shown = vertices.select("id"), limit * 3

    def whole(e: DataFrame) -> DataFrame:
        e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        return e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*order)

    for times in looks:
        rows = edges.select(*order).orderBy(*order).limit(shown * times)
        head = cut_lineage(rows.withColumn("times", F.lit(1)).groupBy(*order).agg(F.sum("times").alias("times")), "head")
        seen = head.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"]
        # few rows: the vertices are looked through once, and those that edges name are kept
        ends = head.select(F.col("src").alias("id")).union(head.select(F.col("dst").alias("id"))).distinct()
        known = cut_lineage(ids.join(F.broadcast(ends), "id", "left_semi"), "ends")
        found = cut_lineage(
            head.join(F.broadcast(known.withColumnRenamed("id", "src")), "src", "left_semi")
            .join(F.broadcast(known.withColumnRenamed("id", "dst")), "dst", "left_semi").select(*order), "whole",
        )
        if seen < shown * times or found.count() >= shown:
            return found.orderBy(*order).limit(shown)
    return whole(edges).distinct().orderBy(*order).limit(shown)


def view_kind(label: Column) -> Column:
    """Node kind as the explorer groups it."""
    known = ["Actor", "Wallet", "PGPKey", "Onion", "Handle", "Domain"]
    return F.when(label == "PGP", "PGPKey").when(label.isin(known), label).otherwise("Domain")


def filter_view(vertices: DataFrame, edges: DataFrame, hidden: list[str], query: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of the visible kinds that contain ``query``, and the edges between them."""
    q = query.strip().lower()
    nodes = vertices.filter(~view_kind(F.col("label")).isin(hidden)) if hidden else vertices
    if q:
        nodes = nodes.filter(F.contains(F.lower("value"), F.lit(q)) | F.contains(F.lower("id"), F.lit(q)))
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    return nodes, kept


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, count) per known label and edge type, zeros included, plus both totals."""
    spark = vertices.sparkSession

    def counted(df: DataFrame, column: str, names: list[str], prefix: str, total: str) -> DataFrame:
        by_name = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        wanted = spark.createDataFrame([(n,) for n in names], "name string")
        known = wanted.join(by_name, F.col("name") == F.col(column), "left").select(
            F.concat(F.lit(prefix), F.lower("name")).alias("metric"), F.coalesce("n", F.lit(0)).alias("n")
        )
        return known.unionByName(
            by_name.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(total).alias("metric"), "n")
        )

    return counted(vertices, "label", fixed.STATS_LABELS, "node_", "total_nodes").unionByName(
        counted(edges, "type", fixed.STATS_EDGES, "rel_", "total_edges")
    )


def frontier(links: DataFrame, seeds: DataFrame, max_depth: int = 2, per_domain: int = 20) -> DataFrame:
    """Breadth-first visit of stored links: (url, domain, depth) up to a cap per domain.

    ``links``: src, dst. ``seeds``: url. Visits run by depth, then URL; a page beyond the cap of
    its domain is not visited, so its links are not followed.
    """
    seen = seeds.select("url").distinct()
    layer = seen
    visited = None
    by_url = Window.partitionBy("domain").orderBy("url")
    for depth in range(max_depth + 1):
        found = layer.select("url", host(F.col("url")).alias("domain"))
        # no domain has more free visits than the cap, so each keeps that many rows at most
        found = newest_per_key(found, ["domain"], [F.col("url")], per_domain)
        if visited is not None:
            used = visited.groupBy("domain").agg(F.count(F.lit(1)).alias("used"))
            found = (
                found.join(used, "domain", "left")
                .withColumn("_rn", F.row_number().over(by_url))
                .filter(F.col("_rn") + F.coalesce("used", F.lit(0)) <= per_domain)
            )
        allowed = cut_lineage(found.select("url", "domain", F.lit(depth).alias("depth")), "frontier")
        visited = allowed if visited is None else visited.unionByName(allowed)
        if depth < max_depth:
            linked = allowed.select(F.col("url").alias("src")).join(links, "src")
            fresh = linked.select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
            layer = cut_lineage(fresh, "frontier")
            seen = seen.union(layer)
    return visited


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) with the smallest id of each connected component."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    found = roots(edges, max_rounds)
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) as ``components``, of the nodes that are not the smallest of theirs.

    Alternates the large-star and small-star steps of Kiveris et al. 2014. Both need only a
    minimum per node, which Spark combines before the shuffle, and a join that AQE can split,
    so a node with a third of all edges never lands in one task. Whole numbers as ids are several
    times faster than text, whose minimum Spark finds by sorting.
    """
    work = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v")
    work = cut_lineage(_undirected(work), "components")
    for _ in range(max_rounds):
        if _are_stars(work):
            return work.select(F.col("u").alias("id"), F.col("v").alias("component"))
        work = cut_lineage(_small_star(_large_star(work)), "components")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Edges that a task gathers before it contracts them.
GATHER = 1_000_000


def _forest(edges: pd.DataFrame) -> pd.DataFrame:
    """An edge from every node to the smallest node of its component, for the nodes that are not the smallest."""
    ids, places = np.unique(np.concatenate([edges["u"].to_numpy("int64"), edges["v"].to_numpy("int64")]), return_inverse=True)
    a, b = places[: len(edges)], places[len(edges):]
    label = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label != (up := label[label])).any():
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    moved = label != np.arange(len(ids))
    return pd.DataFrame({"u": ids[moved], "v": ids[label[moved]]})


def forest_of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as trees of one step that connect the same nodes."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= GATHER:
            held = [_forest(pd.concat(held, ignore_index=True))]
            if len(held[0]) >= GATHER // 2:
                yield held.pop()
    if held:
        yield _forest(pd.concat(held, ignore_index=True))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) between whole numbers that connect the same nodes, at most one per node and gathered lot.

    Edges between the same two blocks of 65,536 numbers come into one task, where most edges of graphs with a local
    order are settled at once; those of a node with very many edges are spread by the other end's block.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v")
    dealt = e.repartition(F.shiftright("u", 16), F.shiftright("v", 16))
    return dealt.mapInPandas(forest_of_task, "u long, v long").toDF("src", "dst")


def _are_stars(e: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, which has none itself; both steps leave such edges as they are."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("id"), F.lit(0).alias("up")))
    ways = ends.groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return ways.filter("up > 1 or up = 1 and least = 0").isEmpty()


def _undirected(e: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller id."""
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour to the smallest node of the neighbourhood."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link every smaller neighbour and the node itself to the smallest neighbour."""
    # edges of the step before run from larger to smaller ids already
    down = e
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(smallest, "u")
    return _undirected(
        linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
    )
