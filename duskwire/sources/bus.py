"""An event bus on shared files: topics with partitions and offsets, and consumer groups that remember their place.

A topic is a Parquet log. Publishing a batch deals its rows over partitions by key and numbers them on from the last
offset of each; a batch that is published again is left out. A group subscribes from the earliest or the latest
offset. That choice is made once: the offsets at which it starts are kept beside its stream checkpoint, so after a
restart the group goes on where it stopped, whatever it is asked then.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import number_rows

LOG = "partition int, offset long, key string, value string, published long"
_NO_ROWS = "partition int, start long"


class FileBus:
    def __init__(self, spark: SparkSession, root: str, partitions: int = 3):
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), partitions
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def log(self, topic: str) -> DataFrame:
        """All rows of a topic."""
        path = f"{self.root}/topics/{topic}"
        if not self._there(path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(path)

    def ends(self, topic: str) -> dict[int, int]:
        """The next offset of each partition that has rows."""
        found = self.log(topic).groupBy("partition").agg(F.max("offset").alias("o")).collect()  # a row a partition
        return {r["partition"]: r["o"] + 1 for r in found}

    def publish(self, events: DataFrame, topic: str, batch: int) -> None:
        """Append rows of (key, value) as batch number ``batch``, in the order of key and value within a partition.

        One writer at a time; a batch that failed on its way is written anew, a complete one stays as it is.
        """
        path = f"{self.root}/topics/{topic}/batch-{batch:012d}"
        if self._there(f"{path}/_SUCCESS"):
            return
        self._files.delete(self._path(path), True)
        ends = self.ends(topic)
        base = F.create_map(*[F.lit(x) for p in range(self.partitions) for x in (p, ends.get(p, 0))])
        dealt = events.select(F.pmod(F.xxhash64("key"), F.lit(self.partitions)).cast("int").alias("partition"), "key", "value")
        # equal rows get numbers too
        numbered = number_rows(dealt.withColumn("_id", F.monotonically_increasing_id()), ["key", "value", "_id"], "_n", ["partition"])
        rows = numbered.select(
            "partition", (base[F.col("partition")] + F.col("_n") - 1).cast("long").alias("offset"), "key", "value", F.lit(batch).cast("long").alias("published")
        )
        rows.write.parquet(path)

    def _starts(self, topic: str, group: str, from_beginning: bool) -> dict[int, int]:
        """Where a group starts; worked out and kept when it subscribes first."""
        path = f"{self.root}/groups/{group}/{topic}/start"
        if not self._there(f"{path}/_SUCCESS"):
            ends = {} if from_beginning else self.ends(topic)
            self.spark.createDataFrame(list(ends.items()), _NO_ROWS).write.mode("overwrite").parquet(path)
        return {r["partition"]: r["start"] for r in self.spark.read.schema(_NO_ROWS).parquet(path).collect()}

    def subscribe(self, topic: str, group: str, from_beginning: bool = False) -> DataFrame:
        """Stream of a topic's rows from the group's start on."""
        starts = self._starts(topic, group, from_beginning)
        path = f"{self.root}/topics/{topic}"
        self._files.mkdirs(self._path(path))
        stream = self.spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(path)
        if not starts:
            return stream
        start = F.create_map(*[F.lit(x) for item in starts.items() for x in item])
        return stream.filter(F.col("offset") >= F.coalesce(start[F.col("partition")], F.lit(0)))

    def consume(
        self, topic: str, group: str, from_beginning: bool = False, transform: Callable[[DataFrame], DataFrame] = lambda s: s
    ) -> DataFrame:
        """Let a group take in all that is there now; returns all that it has taken in so far.

        Rows and place are committed together: the checkpoint and the sink's log lie in the group's folder.
        """
        home = f"{self.root}/groups/{group}/{topic}"
        stream = transform(self.subscribe(topic, group, from_beginning))
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out")
            .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        if not self._there(f"{home}/out"):
            return self.spark.createDataFrame([], stream.schema)
        return self.spark.read.schema(stream.schema).parquet(f"{home}/out")
