"""Ordered replay: a stored table enters a stream in ascending slices of its own time.

A slice is what a replay at some speed lets through between two ticks. Slices land one after the other, and the
query takes in each before the next one lands, so micro-batches never overlap in time, however many files a slice
has and whatever their times of modification. Where the result does not depend on where micro-batches are cut,
consecutive slices may land together, so that their number follows the rows and not the replayed time.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import scratch_path


def sliced(df: DataFrame, at: str, seconds: int) -> DataFrame:
    """``df`` with its slice: whole spans of ``seconds`` since the earliest row. Rows without a time belong to slice 0."""
    first = df.agg(F.min(F.unix_micros(at)).alias("t")).first()["t"]  # one number
    span = F.floor((F.unix_micros(at) - F.lit(first or 0)) / (seconds * 1_000_000))
    return df.withColumn("slice", F.coalesce(span, F.lit(0)).cast("long"))


def landings(sizes: Sequence[tuple[int, int]], rows: int | None) -> list[tuple[int, int]]:
    """(first, last) slices of each landing, from ascending (slice, rows): as many as hold ``rows`` rows, else a single one."""
    out: list[list[int]] = []
    held = 0
    for number, n in sizes:
        if out and rows and held + n <= rows:
            out[-1][1] = number
            held += n
        else:
            out.append([number, number])
            held = n
    return [(first, last) for first, last in out]


def replayed(
    df: DataFrame, at: str, seconds: int, label: str, transform: Callable[[DataFrame], DataFrame] = lambda s: s,
    end: bool | Sequence[str] = False, rows_together: int | None = None,
) -> DataFrame:
    """All that ``transform`` makes of a stream of ``df``'s rows (with their slice), in an append sink.

    ``end``: after the last slice comes a row far in the future (in ``at``, or in the columns given) that is null
    elsewhere, as the input's end: it moves a watermark past everything else. ``rows_together``: consecutive slices of up to so
    many rows land together; for transformations that give the same result for every cut. The driver holds the numbers of
    the slices: the replayed time over ``seconds``.
    """
    spark = df.sparkSession
    rows = sliced(df, at, seconds)
    table, bus, out, state = (scratch_path(spark, f"{label}-{x}") for x in ("slices", "bus", "out", "state"))
    # slices in ascending ranges, so that a landing reads the files that it needs
    rows.repartitionByRange("slice").sortWithinPartitions("slice").write.parquet(table)
    stored = spark.read.schema(rows.schema).parquet(table)
    sizes = [(r["slice"], r["count"]) for r in stored.groupBy("slice").count().orderBy("slice").collect()]
    rows.limit(0).write.parquet(bus)
    stream = transform(spark.readStream.schema(rows.schema).parquet(bus))

    def run() -> None:
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    for low, high in landings(sizes, rows_together):
        stored.filter(F.col("slice").between(low, high)).write.mode("append").parquet(bus)
        run()
    if end:
        far = [at] if end is True else end
        mark = [F.lit("9999-01-01" if f.name in far else None).cast(f.dataType).alias(f.name) for f in rows.schema]
        spark.range(1).select(*mark).write.mode("append").parquet(bus)
        run()
    if not sizes and not end:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out)
