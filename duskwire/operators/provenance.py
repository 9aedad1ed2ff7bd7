"""Merkle batches over evidence hashes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bind
from ..lineage import cut_lineage
from .ordering import number_rows

BATCH_SIZE = 100
BATCH_SECONDS = 300


def assign_batches(evidence: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Adds batch_no and pos in the order (collected_at, evidence_id)."""
    numbered = number_rows(evidence, ["collected_at", "evidence_id"], "_n")
    return (
        numbered.withColumn("batch_no", F.floor((F.col("_n") - 1) / size).cast("long"))
        .withColumn("pos", ((F.col("_n") - 1) % size).cast("int"))
        .drop("_n")
    )


def following(at: np.ndarray, before: np.ndarray, size: int, timeout: int) -> np.ndarray:
    """For a batch that begins at each leaf, the place of the leaf after its last one; -1 if it stays open.

    ``at``: ascending times of the leaves; ``before``: the time of the leaf ahead of each, when the batch's clock started.
    """
    n = len(at)
    here = np.arange(n)
    full = here + size - 1
    late = np.maximum(np.searchsorted(at, before + timeout, side="left"), here)
    last = np.minimum(full, late)
    return np.where(last < n, last + 1, -1)


def assign_timed_batches(
    evidence: DataFrame, size: int = BATCH_SIZE, timeout: int = BATCH_SECONDS, at: str = "collected_at", id_: str = "evidence_id",
    range_rows: int = 100_000,
) -> DataFrame:
    """Adds batch_no, pos and closed: a batch closes with its ``size``-th leaf or with the first one ``timeout`` seconds
    or more after it began, which is when the one before it closed (for the first: at its first leaf).

    Where a batch begins depends on all before it, yet next(i), the beginning after a batch that begins at leaf i, is
    known from the ``size`` leaves behind i. So leaves are numbered, cut into ranges of ``range_rows`` with a border of
    ``size`` leaves, and every range tells for each of its first ``size`` leaves where a chain that enters there leaves
    to the next range. Doubling these pointers marks the one true entry of each range in log2(ranges) joins, and
    each range then marks its own batches.
    """
    range_rows = max(range_rows, size)
    numbered = cut_lineage(number_rows(evidence, [at, id_], "_n").withColumn("_n", F.col("_n") - 1), "batch-leaves")
    leaf = numbered.select(F.col("_n").alias("n"), F.unix_micros(at).alias("us"), F.floor(F.col("_n") / range_rows).alias("range"))
    inside = F.col("n") % range_rows
    copies = F.filter(F.array(
        F.col("range"),
        F.when((inside < size) & (F.col("range") > 0), F.col("range") - 1),  # what a range sees behind its end
        F.when(inside == range_rows - 1, F.col("range") + 1),  # the leaf ahead of a range, which may have no leaf of its own
    ), lambda r: r.isNotNull())
    bordered = leaf.select("n", "us", F.explode(copies).alias("range"))

    def chains(table: pa.Table, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, next) of the leaves from ``first`` on; next is a number or -1."""
        table = table.sort_by("n")
        n, us = table.column("n").to_numpy(), table.column("us").to_numpy()
        start = int(np.searchsorted(n, first))
        before = np.concatenate([us[:1], us[:-1]])[start:]
        n, us = n[start:], us[start:]
        step = following(us, before, size, timeout * 1_000_000)
        return n, np.where(step >= 0, first + step, -1)

    def enter(key: tuple, table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        n, step = chains(table, r * range_rows)
        own = min(len(n), range_rows)
        out = np.arange(len(n))  # where a chain through each leaf stands when it has left the range; -1 if it ends
        for i in range(own - 1, -1, -1):
            to = step[i] - r * range_rows
            out[i] = -1 if step[i] < 0 else to if to >= own else out[to]
        goes = out[: min(own, size)]
        at_ = np.flatnonzero((goes >= range_rows) & (goes < len(n) + 1))
        return pa.table({"r": np.full(len(at_), r), "e": at_, "r2": np.full(len(at_), r + 1), "e2": goes[at_] - range_rows})

    jumps = cut_lineage(bordered.groupBy("range").applyInArrow(enter, "r long, e long, r2 long, e2 long"), "batch-jumps")
    ranges = leaf.agg(F.max("range").alias("m")).first()["m"]  # one number
    entries = evidence.sparkSession.createDataFrame([(0, 0)] if ranges is not None else [], "r long, e long")
    done = 1
    while ranges is not None and done <= ranges:
        # ``jumps`` spans ``done`` ranges; entries are known up to range done - 1
        further = entries.join(jumps, ["r", "e"]).select(F.col("r2").alias("r"), F.col("e2").alias("e"))
        entries = cut_lineage(entries.unionByName(further), "batch-entries")
        behind = jumps.select(F.col("r").alias("r2"), F.col("e").alias("e2"), F.col("r2").alias("r3"), F.col("e2").alias("e3"))
        jumps = cut_lineage(jumps.join(behind, ["r2", "e2"]).select("r", "e", F.col("r3").alias("r2"), F.col("e3").alias("e2")), "batch-jumps")
        done *= 2

    def mark(key: tuple, table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        entry = table.column("e").drop_null()
        n, step = chains(table.drop_columns("e"), r * range_rows)
        own = min(len(n), range_rows)
        begun, closes = np.zeros(own, np.int64), np.ones(own, bool)
        i = entry[0].as_py() if len(entry) else own
        while 0 <= i < own:
            begun[i] = 1
            closes[i] = step[i] >= 0
            i = step[i] - r * range_rows if step[i] >= 0 else own
        return pa.table({"n": n[:own], "range": np.full(own, r), "begun": np.cumsum(begun), "open": ~closes})

    with_entry = bordered.join(entries.select(F.col("r").alias("range"), "e"), "range", "left")
    marked = cut_lineage(with_entry.groupBy("range").applyInArrow(mark, "n long, range long, begun long, open boolean"), "batch-marks")
    # a row for each range
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy("range").agg(F.max("begun").alias("_b")).select("range", F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_o"))
    placed = marked.join(offsets, "range").select(F.col("n").alias("_n"), (F.col("_o") + F.col("begun") - 1).alias("batch_no"), "open")
    mates = Window.partitionBy("batch_no")  # at most ``size`` rows
    return (
        numbered.join(placed, "_n")
        .withColumn("pos", (F.col("_n") - F.min("_n").over(mates)).cast("int"))
        .withColumn("closed", ~F.max("open").over(mates)).drop("_n", "open")
    )


def bare(hash_col: Column) -> Column:
    return F.regexp_replace(hash_col, F.lit("^sha256:"), F.lit(""))


def _level(nodes: Column) -> Column:
    """Parent hashes of one tree level; an odd last node pairs with itself."""

    def parent(i: Column) -> Column:
        left = F.get(nodes, i * 2)
        return F.sha2(F.concat(left, F.coalesce(F.get(nodes, i * 2 + 1), left)), 256)

    count = F.ceil(F.size(nodes) / 2).cast("int")
    return F.when(F.size(nodes) == 1, nodes).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), parent)
    )


def root(leaves: Column, max_leaves: int = BATCH_SIZE) -> Column:
    """Merkle root of an array of hex hashes with at most ``max_leaves`` items."""
    out = F.transform(leaves, bare)
    levels = max(1, (max_leaves - 1).bit_length())
    for _ in range(levels):
        out = bind(out, _level)
    return F.get(out, F.lit(0))


def root_of_peaks(n: Column, peaks: Column, max_leaves: int = BATCH_SIZE) -> Column:
    """Merkle root from the roots of the complete subtrees of ``n`` leaves, the largest first: one for each bit of n.

    What is left over on a level pairs with itself, as an odd last node does.
    """
    joined = lambda a, b: F.sha2(F.concat(a, b), 256)

    def level(s: Column, i: Column) -> Column:
        power = F.pow(F.lit(2.0), i).cast("long")
        nodes = F.floor(n / power)
        here, above = nodes % 2 == 1, nodes >= 2
        peak = F.get(peaks, s["left"] - 1)
        carry = (
            F.when(here & s["carry"].isNotNull(), joined(peak, s["carry"]))
            .when(here & above, joined(peak, peak))
            .when(here, peak)
            .when(s["carry"].isNotNull() & above, joined(s["carry"], s["carry"]))
            .otherwise(s["carry"])
        )
        return F.struct(carry.alias("carry"), (s["left"] - here.cast("int")).alias("left"))

    start = F.struct(F.lit(None).cast("string").alias("carry"), F.size(peaks).alias("left"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(max_leaves.bit_length())), start, level)["carry"]


def merkle_batches(assigned: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """(batch_no, leaf_count, root_hash); a batch holds at most ``size`` leaves."""
    leaves = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "content_hash"))), lambda s: s["content_hash"]
    )
    batches = assigned.groupBy("batch_no").agg(leaves.alias("_leaves"))
    return batches.select(
        "batch_no",
        F.size("_leaves").cast("long").alias("leaf_count"),
        F.concat(F.lit("sha256:"), root(F.col("_leaves"), size)).alias("root_hash"),
    )


def verify(assigned: DataFrame, batches: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """(batch_no, ok): recomputed roots against stored ones."""
    again = merkle_batches(assigned, size).select("batch_no", F.col("root_hash").alias("_again"))
    return batches.join(again, "batch_no", "left").select(
        "batch_no", F.coalesce(bare(F.col("root_hash")) == bare(F.col("_again")), F.lit(False)).alias("ok")
    )


def lookup(evidence: DataFrame, batches: DataFrame) -> DataFrame:
    """Evidence with its batch, if it has one."""
    return evidence.join(batches, "batch_no", "left")
