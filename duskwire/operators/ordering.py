"""Running sums and row numbers over data that no single task could sort.

A window over one hot partition key, or over no key at all, puts its rows into
one task. Here rows are range-partitioned by (keys, order), each range is summed,
the sums of earlier ranges become an offset, and the window runs inside a range.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    ranges: int | None = None,
) -> DataFrame:
    """``df`` plus inclusive running sums per ``keys`` in ``order``.

    ``order`` must identify a row within its key, so that ranges can split a hot key.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [F.col(c) for c in [*keys, *order]]
    measured = df.select("*", *[expr.alias(f"_m_{name}") for name, expr in sums.items()])
    ranged = measured.repartitionByRange(n, *ordered).withColumn("_range", F.spark_partition_id())
    # the range of a row must stay the same in both uses below
    ranged = cut_lineage(ranged, "ranges")

    group = ["_range", *keys]
    totals = ranged.groupBy(*group).agg(*[F.sum(f"_m_{name}").alias(f"_t_{name}") for name in sums])
    # at most (number of keys + number of ranges) rows
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in sums]
    )
    matched = ranged.join(offsets.withColumnsRenamed({k: f"_k_{k}" for k in group}),
                          _same(group), "inner")
    inside = Window.partitionBy(*group).orderBy(*[F.col(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = matched.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_o_{name}") + F.sum(f"_m_{name}").over(inside)).alias(name) for name in sums],
    )
    return out


def _same(group: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in group:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}")) if k != "_range" else cond & (F.col(k) == F.col(f"_k_{k}"))
    return cond


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_number", keys: Sequence[str] = ()) -> DataFrame:
    """Consecutive row numbers from 1, over all rows or per key."""
    return running_sums(df, list(keys), order, {name: F.lit(1).cast("long")})


def numbered_in_order(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` plus whole numbers that ascend with ``order``, with gaps; one shuffle.

    Ids of Spark rise with the range and, as ranges are sorted, within it. They are written, so that all uses see the same.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    return cut_lineage(ranged.withColumn(name, F.monotonically_increasing_id()), "numbers")


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key. Spark trims each map task to ``n`` rows before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(rank)).filter(F.col("_rn") <= n).drop("_rn")


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, ranges: int | None = None
) -> DataFrame:
    """``df`` plus ``prev`` and ``next`` of ``value`` per ``keys`` in ``order``.

    Ranges split a hot key; the rows at their edges look at the nearest range of the same key.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(n, *ordered).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ranges")
    group = ["_range", *keys]
    place = F.struct(*order)
    ends = ranged.groupBy(*group).agg(
        F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last")
    )
    # at most (number of keys + number of ranges) rows
    across = Window.partitionBy(*keys).orderBy("_range")
    edges = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in group],
        F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"),
    )
    inside = Window.partitionBy(*group).orderBy(*[F.col(c) for c in order])
    return ranged.join(edges, _same(group)).select(
        *[F.col(c) for c in df.columns],
        F.coalesce(F.lag(value).over(inside), F.when(F.row_number().over(inside) == 1, F.col("_before"))).alias("prev"),
        F.coalesce(F.lead(value).over(inside), F.when(F.lead(F.lit(1)).over(inside).isNull(), F.col("_after"))).alias("next"),
    )


def split_parts(df: DataFrame, keys: Sequence[str], row_id: str, size: int, name: str = "part") -> DataFrame:
    """Adds a part number so that rows of one key form groups of about ``size``.

    A key with up to ``size`` rows has one part, 0.
    """
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    return df.join(counts, list(keys)).withColumn(
        name, F.pmod(F.xxhash64(row_id), F.col("_parts")).cast("int")
    ).drop("_parts")
