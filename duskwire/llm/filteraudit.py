"""Filter interaction audit: what each of five filters removes in every order, kept by a retracting stream.

All files of the documents go through one streaming query in available-now micro-batches. Whether a document
fails filters A to D is seen in its own text; filter E (a smaller id has the same text) depends on rows that may
come later. So each text keeps, in keyed state, its smallest id so far with what that id's rows were counted as.
When a smaller id arrives, the earlier count is retracted (-n) and put in again with E failing (+n). What the
stream returns are changes of part counters; their sum is right after every batch, in whatever order files come.

Copies are combined before the shuffle: of the rows that a task reads of one text, only those of the smallest id
go to the text's state, the rest fail E for sure and become counter changes at once. So a text that a third of
all rows share sends a few rows per task to its state.
"""
from __future__ import annotations

import hashlib
import itertools
import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..lineage import scratch_path
from ..streaming.stateful import rocksdb
from .postings import bytes_of, column

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
COUNTERS = "part string, mask int, quality int, toxic int, n long"
_FACTS = ["part", "mask", "quality", "toxic"]
#: Texts that a task combines before it sends them on.
GATHER = 50_000


_UPPER = bytes(range(65, 91))
_INNER = bytes(range(128, 192))  # bytes that begin no code point
_SIGNS = b"#$%&*|"


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    words = text.split()  # of bytes, this parts at exactly 0x20 and 0x09 to 0x0D
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER)) if not text.isascii() else len(text)
    return (
        BIT["A"] * (len(words) < 200)
        | BIT["B"] * (100 * len(set(words)) < 50 * len(words))
        | BIT["C"] * (100 * upper > 2 * points)
        | BIT["D"] * (len(text.translate(None, _SIGNS)) < len(text))
    )


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, key, mask): a text's SHA-256 stands for it from here on."""
    for b in batches:
        keys, masks = [], []
        for text in bytes_of(column(b, "text")):
            keys.append(hashlib.sha256(text).digest())
            masks.append(own_mask(text))
        yield pa.RecordBatch.from_arrays(
            [column(b, "doc_id"), column(b, "part"), pa.array(keys, pa.binary()), pa.array(masks, pa.int32())], ["doc_id", "part", "key", "mask"]
        )


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the rows of its smallest id; all other rows as counter changes, marked ``settled``."""
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % 64
    first: dict[bytes, tuple[int, Counter]] = {}
    settled: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = [(key, i, False, *facts, n) for key, (i, held) in first.items() for facts, n in held.items()]
        rows += [(b"settled-%d" % salt, 0, True, *facts, n) for facts, n in settled.items()]
        first.clear()
        settled.clear()
        kinds = (pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        names = ["key", "doc_id", "settled", *_FACTS, "n"]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for b in batches:
        columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "doc_id", *_FACTS)]
        for key, i, *facts in zip(*columns, strict=True):
            part, mask, quality, toxic = facts
            if i is None:
                settled[part, mask, quality, toxic] += 1
                continue
            had = first.get(key)
            if had is None:
                first[key] = (i, Counter({tuple(facts): 1}))
            elif i == had[0]:
                had[1][tuple(facts)] += 1
            elif i > had[0]:
                settled[part, mask | BIT["E"], quality, toxic] += 1
            else:
                for (p, m, q, t), n in had[1].items():
                    settled[p, m | BIT["E"], q, t] += n
                first[key] = (i, Counter({tuple(facts): 1}))
        if len(first) >= GATHER:
            yield out()
    if first or settled:
        yield out()


def merged(known: tuple[int, Counter] | None, rows: list[tuple]) -> tuple[tuple[int, Counter], Counter]:
    """A text's state after ``rows`` of (id, part, mask, quality, toxic, n), and the counter changes."""
    least = min([r[0] for r in rows] + ([known[0]] if known else []))
    changes: Counter = Counter()
    held: Counter = Counter()
    if known and known[0] == least:
        held.update(known[1])
    elif known:
        for (part, mask, quality, toxic), n in known[1].items():
            changes[part, mask, quality, toxic] -= n
            changes[part, mask | BIT["E"], quality, toxic] += n
    for i, part, mask, quality, toxic, n in rows:
        if i == least:
            held[part, mask, quality, toxic] += n
            changes[part, mask, quality, toxic] += n
        else:
            changes[part, mask | BIT["E"], quality, toxic] += n
    return (least, held), changes


class TextState(StatefulProcessor):
    """Keeps each text's smallest id and what that id's rows were counted as; returns counter changes.

    The grouping key is a bucket of texts, so rows come in large batches; a text has an entry of its own in the
    bucket's map state, which is read and written alone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getMapState("texts", "key binary", "least long, held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            changes: Counter = Counter()
            by_text: dict[bytes, list[tuple]] = defaultdict(list)
            columns = [frame[c].tolist() for c in ("settled", "key", "doc_id", *_FACTS, "n")]
            for settled, text, i, *facts, n in zip(*columns, strict=True):
                if settled:
                    changes[tuple(facts)] += n
                else:
                    by_text[bytes(text)].append((i, *facts, n))
            for text, mine in by_text.items():
                stored = self.texts.getValue((text,))
                known = (int(stored[0]), Counter({tuple(f): n for *f, n in json.loads(stored[1])})) if stored else None
                state, changed = merged(known, mine)
                if state != known:
                    self.texts.updateValue((text,), (state[0], json.dumps([[*f, n] for f, n in state[1].items()])))
                for facts, n in changed.items():
                    changes[facts] += n
            yield pd.DataFrame([(*f, n) for f, n in changes.items() if n], columns=[*_FACTS, "n"])

    def close(self) -> None:
        pass


def counter_changes(stream: DataFrame, labels: DataFrame) -> DataFrame:
    """Stream of counter changes (part, mask, quality, toxic, n) of a stream of documents (doc_id, text, source)."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("quality"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    docs = stream.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), "text")
    rows = docs.mapInArrow(_seen, "doc_id long, part string, key binary, mask int").join(marks, "doc_id", "left").select(
        "key", "doc_id", "part", "mask", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    combined = rows.mapInArrow(_combined, f"key binary, doc_id long, settled boolean, {COUNTERS}")
    buckets = 4 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = combined.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").transformWithStateInPandas(TextState(), COUNTERS, "Append", "None")


def report(counters: DataFrame) -> DataFrame:
    """The audit's rows from counters (part, mask, quality, toxic, n), summed or not."""
    sums = counters.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("bad")
    )
    # a fixed list of 600 steps: (order, step, bit of the step's filter, bits of those before)
    steps = [(o, i + 1, BIT[o[i]], sum(BIT[c] for c in o[:i])) for o in ORDERS for i in range(5)]
    table = F.from_json(
        F.lit(json.dumps([dict(zip(("o", "s", "b", "p"), x, strict=True)) for x in steps])), "array<struct<o:string,s:int,b:int,p:int>>"
    )
    at = sums.select("*", F.inline(table))
    fails, before = F.col("mask").bitwiseAND(F.col("b")) != 0, F.col("mask").bitwiseAND(F.col("p")) != 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    out = at.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step"), "b").agg(
        count(~fails & ~before).alias("kept"), count(fails & ~before).alias("removed"), count(fails & before).alias("redundant"),
        count(F.col("mask") == F.col("b")).alias("unique_fails"),
        count(fails & ~before, "good").alias("good_lost"), count(fails & ~before, "bad").alias("toxic_lost"),
    )
    # 120 rows of each part and filter
    filters = out.groupBy("part", "b").agg(F.sum("removed").alias("shapley"))
    return out.join(filters, ["part", "b"]).drop("b")


@contextmanager
def _small_logs(spark: SparkSession):
    """Changes alone go to the checkpoint after each batch, and stores don't reserve disk ahead; settings are put back."""
    wanted = {"changelogCheckpointing.enabled": "true", "allowFAllocate": "false"}
    names = {f"spark.sql.streaming.stateStore.rocksdb.{k}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def document_stream(spark: SparkSession, path: str, bytes_per_core: int) -> DataFrame:
    """Stream over all files of a Parquet table, which is a folder or a single file, in batches of so many bytes a core."""
    batch = bytes_per_core * spark.sparkContext.defaultParallelism
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(jvm_path).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, bytes_per_core: int = 16 << 20) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``path``: a Parquet table with doc_id, text, source; ``labels``: doc_id, quality, toxic, of which any row that says 1
    counts. Null texts are empty, null sources the part "". Rows without an id never fail E and make no row fail it;
    rows of one id and text fail it together or not at all. Extra columns are ignored, an empty table gives no rows.
    A micro-batch reads about ``bytes_per_core`` for each core of the cluster, one file at least, so the number of
    batches follows data and cluster. A batch that is run again overwrites its own counters and changes nothing.
    """
    changes = counter_changes(document_stream(spark, path, bytes_per_core), labels)
    out = scratch_path(spark, "audit-counters")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*_FACTS).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    with rocksdb(spark), _small_logs(spark):
        query = (
            changes.writeStream.foreachBatch(save).outputMode("append")
            .option("checkpointLocation", scratch_path(spark, "audit-state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    # the empty first folder keeps the path readable where no file gave a batch
    spark.createDataFrame([], COUNTERS).write.mode("overwrite").parquet(f"{out}/b=none")
    return report(spark.read.schema(COUNTERS).parquet(f"{out}/*"))
