"""Wallet clusters, transfers and sanction checks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .graph import contracted, roots
from .ordering import numbered_in_order


def co_spent_clusters(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One cluster per transaction with two or more input addresses, and its members.

    ``inputs``: txid, pos, address. The cluster is keyed by the first address.
    """
    per_tx = inputs.groupBy("txid").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("address", "pos").alias("first_address")
    ).filter("size >= 2").withColumn("cluster_id", F.concat(F.lit("cluster_"), "first_address"))
    # a later transaction with the same first address overwrites the size
    clusters = per_tx.groupBy("cluster_id").agg(F.max_by("size", "txid").alias("size"))
    members = inputs.join(per_tx.select("txid", "cluster_id"), "txid").select("cluster_id", "address").distinct()
    return clusters, members


def ownership_components(inputs: DataFrame) -> DataFrame:
    """(id, component): addresses joined through any chain of common-input transactions.

    Each transaction becomes a star around its smallest address, so its edges grow with its
    inputs and not with their pairs. Addresses are numbered in their order first, so that the rounds
    compare whole numbers.
    """
    used = inputs.filter(F.col("txid").isNotNull()).select("txid", "address")
    names = numbered_in_order(used.select("address").distinct(), "address", "id")
    linked = cut_lineage(used.join(names, "address").select("txid", F.col("id").alias("src")), "linked")
    hub = linked.groupBy("txid").agg(F.min("src").alias("dst"))
    found = roots(contracted(linked.join(hub, "txid").select("src", "dst")))
    smallest = names.select(F.col("id").alias("component"), F.col("address").alias("smallest"))
    moved = found.join(smallest, "component").select("id", "smallest")
    return names.join(moved, "id", "left").select(F.col("address").alias("id"), F.coalesce("smallest", "address").alias("component"))


def transfers(txs: DataFrame) -> DataFrame:
    """SENT_TO edges with totals. ``txs``: from_address, to_address, amount, ts."""
    return txs.groupBy(F.col("from_address").alias("src"), F.col("to_address").alias("dst")).agg(
        F.sum("amount").alias("amount"),
        F.count(F.lit(1)).alias("n_tx"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def sanctioned(addresses: DataFrame, listed: DataFrame) -> DataFrame:
    """Addresses on the sanction list, compared without case."""
    keys = listed.select(F.lower("address").alias("_k")).distinct()
    return addresses.withColumn("_k", F.lower("address")).join(keys, "_k", "left_semi").drop("_k")


def sanction_summary(addresses: DataFrame, listed: DataFrame) -> DataFrame:
    """checked, flagged."""
    keys = listed.select(F.lower("address").alias("_k"), F.lit(1).alias("_hit")).distinct()
    joined = addresses.select(F.lower("address").alias("_k")).join(keys, "_k", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum("_hit"), F.lit(0)).cast("long").alias("flagged")
    )
