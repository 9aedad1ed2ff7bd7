"""Start streams and land their results in the shared folder."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..lineage import scratch_path


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over the files of a Parquet table, which is a folder or a single file."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    files = spark.read.schema(schema).parquet(path).inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the progress reports that Spark keeps."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def drain(
    stream: DataFrame, label: str, then: Callable[[], None] | None = None, late: list[int] | None = None
) -> DataFrame:
    """Process all available input and return what an append sink has received.

    With ``then``: it is called after that, and the same query goes on with what has landed meanwhile.
    ``late`` receives the number of late rows of each run.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-state")

    def run() -> None:
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        if late is not None:
            late.append(late_rows(query))

    run()
    if then:
        then()
        run()
    return spark.read.schema(stream.schema).parquet(out)


def ending(spark: SparkSession, schema: StructType, label: str) -> tuple[DataFrame, Callable[[DataFrame], None]]:
    """(stream, land): a stream without rows until ``land(rows)`` gives it some, as ``then`` of ``drain`` may do."""
    path = scratch_path(spark, f"{label}-ends")
    spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path), lambda rows: rows.write.mode("append").parquet(path)


def drain_closed(
    events: DataFrame, at: str, windows: Callable[[DataFrame], DataFrame], label: str, late: list[int] | None = None
) -> DataFrame:
    """All windows of a stream that ends: those still open after the input are closed by an end mark.

    The mark is a row far in the future with nulls elsewhere. It moves the watermark past every
    window but its own, which therefore stays open and is never seen.
    """
    spark = events.sparkSession
    marks, land = ending(spark, events.schema, label)
    mark = [F.lit("9999-01-01" if f.name == at else None).cast(f.dataType).alias(f.name) for f in events.schema]
    return drain(windows(events.unionByName(marks)), label, lambda: land(spark.range(1).select(*mark)), late)


def drain_updates(stream: DataFrame, label: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Process all available input of an updating query and return the last row per key.

    Each batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, f"{label}-out")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save).outputMode(mode)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    saved = spark.read.parquet(out).drop("b")
    values = [c for c in stream.columns if c not in keys]
    latest = saved.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
    return latest.select(*keys, "_v.*")


def fan_out(stream: DataFrame, label: str, routes: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Write several tables from each batch; returns them after all available input.

    A batch is written once per route and read once: it is kept for the duration of the batch.
    """
    spark = stream.sparkSession
    outs = {name: scratch_path(spark, f"{label}-{name}") for name in routes}
    schemas: dict[str, object] = {}

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, route in routes.items():
            part = route(batch)
            schemas[name] = part.schema
            part.write.mode("overwrite").parquet(f"{outs[name]}/b={batch_id}")
        batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return {name: spark.read.schema(schemas[name]).parquet(f"{path}/*") for name, path in outs.items()}
