"""Writers for events, dead letters, entities and exports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def events_to_bus(events: DataFrame, servers: str, topic: str, checkpoint: str):
    """Publish a stream of events keyed by source; needs the Kafka package."""
    keyed = events.select(F.col("source_id").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return (
        keyed.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("topic", topic).option("checkpointLocation", checkpoint).start()
    )


def events_to_files(events: DataFrame, path: str) -> None:
    """Append events partitioned by source and day of observation."""
    dated = events.withColumn("day", F.to_date("observed_at"))
    dated.write.mode("append").partitionBy("source_id", "day").parquet(path)


def payloads_to_files(texts: DataFrame, path: str) -> None:
    """Redacted payloads, partitioned by the first two characters of their hash."""
    texts.select(
        F.substring("content_hash", 8, 2).alias("prefix"), "content_hash", "text"
    ).write.mode("append").partitionBy("prefix").parquet(path)


CSV = {"header": "true", "escape": '"', "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, times keep their microseconds, null and empty are blank."""
    df.write.options(**CSV).csv(path)


def read_csv(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """What ``csv`` has written, values with line breaks included; blanks are null."""
    return spark.read.schema(schema).options(**CSV, multiLine="true", enforceSchema="false").csv(path)
