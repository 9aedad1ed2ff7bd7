"""A stored entity table that batches of sightings are merged into: copy on write by hash bucket, with a commit log.

Rows lie in buckets of (kind, normalized). A merge rewrites the buckets that its batch touches into a folder of its
own and then publishes one commit: a file, created only if it doesn't exist, that tells which folder holds each
bucket and which batches are in. Readers take the newest commit, so they never see half a merge; a batch that comes
again changes nothing; folders of a merge that failed before its commit are never read.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import merge_entities

COLUMNS = "entity_id string, kind string, normalized string, value string, first_seen timestamp, last_seen timestamp"


class EntityTable:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        """``buckets`` is fixed for the life of a table: choose it so that a bucket is a few hundred MB."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("kind", "normalized"), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Numbers of all commits, ascending."""
        log = self._path(f"{self.root}/log")
        if not self._files.exists(log):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def commit_of(self, version: int) -> dict:
        """What a commit says: ``buckets`` (number to folder) and ``batches``, the last batch of each source."""
        text = self.spark.read.option("wholetext", "true").text(f"{self.root}/log/{version:012d}.json").first()[0]
        return json.loads(text)

    def _publish(self, version: int, commit: dict) -> None:
        """Create the commit's file; another writer that has taken the number makes this fail, and nothing is changed."""
        out = self._files.create(self._path(f"{self.root}/log/{version:012d}.json"), False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """All entities as of a commit, by default the newest; ``only``: those of some buckets."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], COLUMNS)
        folders = self.commit_of(known[-1] if version is None else version)["buckets"]
        paths = [f"{self.root}/data/{folder}/bucket={b}" for b, folder in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(COLUMNS).parquet(*paths) if paths else self.spark.createDataFrame([], COLUMNS)

    def upsert(self, spans: DataFrame, batch: int, source: str = "main") -> list[int]:
        """Merge one batch of entity spans; returns the buckets it rewrote.

        ``spans``: kind, normalized (one row each), value, first_seen, last_seen, entity_id. Batches of a source have
        ascending numbers; one that is in already is left out.
        """
        known = self.versions()
        last = self.commit_of(known[-1]) if known else {"buckets": {}, "batches": {}}
        if batch <= last["batches"].get(source, -1):
            return []
        placed = spans.withColumn("bucket", self._bucket())
        touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        version = known[-1] + 1 if known else 0
        folder = f"v{version}-{source}-{batch}"
        merged = merge_entities(self.read(only=touched), placed).drop("is_new")
        rows = merged.select(*[c.split()[0] for c in COLUMNS.split(", ")]).withColumn("bucket", self._bucket())
        rows.repartition(len(touched) or 1, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        self._publish(version, {
            "buckets": {**last["buckets"], **{str(b): folder for b in touched}}, "batches": {**last["batches"], source: batch},
        })
        return touched
