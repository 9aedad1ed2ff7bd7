"""Keyed state that built-in streaming aggregates do not offer."""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.provenance import root_of_peaks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def rocksdb(spark: SparkSession):
    """Use the state store that keyed Python state needs, with one state task per core at most, and put the settings back.

    Every task of every micro-batch starts a Python worker, which takes seconds whatever its rows are.
    """
    tasks = min(int(spark.conf.get(PARTITIONS)), max(spark.sparkContext.defaultParallelism, 1))
    before = {name: spark.conf.get(name) for name in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(PARTITIONS, tasks)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Rows that a task gathers before it keeps the newest of each URL.
GATHER = 100_000
_SAMPLE = ["probed_at", "clock_skew"]


def _newest(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The newest ``keep`` rows of every URL, newest first."""
    return rows.sort_values(_SAMPLE, ascending=False).groupby("url", sort=False, dropna=False).head(keep)


def newest_of_task(frames: Iterator[pd.DataFrame], keep: int) -> Iterator[pd.DataFrame]:
    """The rows of a task without those that cannot be among the newest ``keep`` of their URL."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= GATHER:
            held = [_newest(pd.concat(held, ignore_index=True), keep)]
            if len(held[0]) >= GATHER // 2:
                yield held.pop()
    if held:
        yield _newest(pd.concat(held, ignore_index=True), keep)


class LastSamples(StatefulProcessor):
    """Keeps the newest samples of every URL of a bucket and emits the lists that a batch has touched.

    The state is a map by URL, so a batch reads and writes the URLs it holds. A bucket in place of a URL is the key, as
    a Python call for each key costs some milliseconds.
    """

    def __init__(self, keep: int = 20):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getMapState("samples", "url string", "held string")

    @staticmethod
    def _name(url) -> str:
        """Key of a URL in the map, which takes no null."""
        return f"={url}" if isinstance(url, str) else ""

    def _known(self, urls: list) -> list[pd.DataFrame]:
        if not self.samples.exists():
            return []
        out = []
        for url in urls:
            if self.samples.containsKey((self._name(url),)):
                at, skew = json.loads(self.samples.getValue((self._name(url),))[0])
                out.append(pd.DataFrame({
                    "url": pd.Series([url] * len(at), dtype="object"), "probed_at": pd.Series(at, dtype="Int64").astype("datetime64[us]"),
                    "clock_skew": pd.Series(skew, dtype="float64"),
                }))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = pd.DataFrame({"url": pd.Series(dtype="object"), "probed_at": pd.Series(dtype="datetime64[us]"), "clock_skew": pd.Series(dtype="float64")})
        for chunk in rows:
            # plain objects: Arrow-backed text may come in several chunks, which can't be returned
            chunk = chunk[["url", *_SAMPLE]].astype({"url": "object", "probed_at": "datetime64[us]"})
            newest = _newest(pd.concat([newest, chunk], ignore_index=True) if len(newest) else chunk, self.keep)
        known = self._known(newest["url"].unique().tolist())
        if known:
            newest = _newest(pd.concat([newest, *known], ignore_index=True), self.keep)
        at, none, skew = newest["probed_at"].to_numpy("datetime64[us]").astype("int64"), newest["probed_at"].isna().to_numpy(), newest["clock_skew"].to_numpy("float64")
        for url, rows_of in newest.groupby("url", sort=False, dropna=False).indices.items():
            held = [[None if none[i] else int(at[i]) for i in rows_of], [None if skew[i] != skew[i] else float(skew[i]) for i in rows_of]]
            self.samples.updateValue((self._name(url),), (json.dumps(held),))
        rank = newest.groupby("url", sort=False, dropna=False).cumcount() + 1
        yield pd.DataFrame({"url": newest["url"], "rn": rank.astype("int32"), "probed_at": newest["probed_at"], "clock_skew": newest["clock_skew"]})

    def close(self) -> None:
        pass


def last_samples(probes: DataFrame, keep: int = 20, buckets: int = 1024) -> DataFrame:
    """Newest samples per URL (url, rn, probed_at, clock_skew), for update mode.

    Each task sends on the newest ``keep`` of a URL alone, so a URL with very many samples burdens no state; URLs are
    dealt to ``buckets`` states, which must stay the same over restarts.
    """
    layout = "url string, probed_at timestamp, clock_skew double"
    kept = probes.select("url", *_SAMPLE).mapInPandas(lambda frames: newest_of_task(frames, keep), layout)
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(
        LastSamples(keep), "url string, rn int, probed_at timestamp, clock_skew double", "Update", "None"
    )


def merkle_root(leaves: list[str]) -> str:
    """Root over hex hashes; an odd last node pairs with itself."""
    level = [leaf.removeprefix("sha256:") for leaf in leaves]
    while len(level) > 1:
        if len(level) % 2:
            level.append(level[-1])
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2])]
    return level[0]


class MerkleBatcher(StatefulProcessor):
    """Closes a batch with its ``size``-th leaf, or once ``seconds`` of event time have passed since its first one.

    The state is the batch's peaks, the roots of its complete subtrees, one for each bit of the number of leaves, in
    place of the leaves. A batch ends by time with the first leaf behind its span, which belongs to the next batch, or
    by a timer when the watermark passes it. Both give the same batches, as leaves come in the order of their time.
    """

    def __init__(self, size: int = 100, seconds: int = 300):
        self.size = size
        self.span = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "n long, began long, peaks string")
        self.closed = handle.getValueState("closed", "n long")

    def _close(self, done: list[tuple], key, n: int, began: int, peaks: list[str], by: str) -> None:
        number = self.closed.get()[0] if self.closed.exists() else 0
        self.closed.update((number + 1,))
        done.append((int(key[0]), number, n, pd.Timestamp(began, unit="ms"), by, list(peaks)))

    @staticmethod
    def _frame(done: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(done, columns=["shard", "batch_no", "leaf_count", "began", "closed_by", "peaks"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, began, peaks = 0, 0, []
        if self.open.exists():
            n, began, held = self.open.get()
            peaks = held.split(",")
        # what a micro-batch holds of one shard
        leaves = pd.concat(list(rows), ignore_index=True).sort_values(["at", "evidence_id"], kind="stable")
        done: list[tuple] = []
        first_began = began if n else None
        for at, leaf in zip(leaves["at"].astype("datetime64[ms]").astype("int64").tolist(), leaves["content_hash"].tolist(), strict=True):
            if n and at >= began + self.span:
                self._close(done, key, n, began, peaks, "time")
                n, peaks = 0, []
            if not n:
                began = at
            n += 1
            peaks.append(leaf.removeprefix("sha256:"))
            carried = n
            while carried % 2 == 0:
                right, left = peaks.pop(), peaks.pop()
                peaks.append(hashlib.sha256((left + right).encode()).hexdigest())
                carried //= 2
            if n >= self.size:
                self._close(done, key, n, began, peaks, "size")
                n, peaks = 0, []
        if n:
            self.open.update((n, began, ",".join(peaks)))
        else:
            self.open.clear()
        now = began if n else None
        if now != first_began:
            if first_began is not None:
                self.handle.deleteTimer(first_began + self.span)
            if now is not None:
                self.handle.registerTimer(now + self.span)
        yield self._frame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        if self.open.exists():
            n, began, held = self.open.get()
            self._close(done, key, n, began, held.split(","), "time")
            self.open.clear()
        yield self._frame(done)

    def close(self) -> None:
        pass


#: No row is ever this far behind, so Spark drops none, and no replayed time reaches the end.
_NEVER = "100000 days"
_END_MS = 16_725_225_600_000  # the year 2500


class LateAwareWindows(StatefulProcessor):
    """Counts rows of tumbling windows, and returns rows that come behind their key's mark in place of dropping them.

    A key's mark is its latest time up to the batch before, less ``delay``. Rows whose window ends at or before it are
    late; windows that the new mark has passed are returned with their counts. The state is the mark and the counts of
    windows that are open still: those of ``delay`` and of one batch.
    """

    def __init__(self, width: int, delay: int):
        self.width, self.delay = width * 1000, delay * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", "latest long, open string")

    def _known(self) -> tuple[int | None, dict[int, int]]:
        if not self.state.exists():
            return None, {}
        latest, held = self.state.get()
        return latest, {int(k): n for k, n in json.loads(held).items()}

    def _windows(self, key, counts: dict[int, int]) -> pd.DataFrame:
        starts = sorted(counts)
        return pd.DataFrame({
            "source_id": pd.Series([key[0]] * len(starts), dtype="object"), "row_id": pd.Series([None] * len(starts), dtype="object"), "at": pd.to_datetime(pd.Series([None] * len(starts), dtype="float64")),
            "window_start": pd.to_datetime(pd.Series(starts, dtype="int64"), unit="ms"), "n": pd.Series([counts[w] for w in starts], dtype="int64"),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, counts = self._known()
        if latest is None:
            self.handle.registerTimer(_END_MS)
        newest = latest
        for frame in rows:
            at = frame["at"].astype("datetime64[ms]").astype("int64")
            start = at // self.width * self.width
            late = (start + self.width <= latest - self.delay) if latest is not None else at != at
            if late.any():
                # plain objects: Arrow-backed text may come in several chunks, which can't be returned
                yield pd.DataFrame({
                    "source_id": pd.Series(key[0], index=frame.index[late], dtype="object"), "row_id": frame["row_id"][late].astype("object"), "at": frame["at"][late],
                    "window_start": pd.to_datetime(start[late], unit="ms"), "n": pd.Series(1, index=frame.index[late], dtype="int64"),
                })
            for w, n in start[~late].value_counts().items():
                counts[int(w)] = counts.get(int(w), 0) + int(n)
            newest = int(at.max()) if newest is None else max(newest, int(at.max()))
        done = {w: n for w, n in counts.items() if w + self.width <= newest - self.delay}
        self.state.update((newest, json.dumps({w: n for w, n in counts.items() if w not in done})))
        yield self._windows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, counts = self._known()
        self.state.clear()
        yield self._windows(key, counts)

    def close(self) -> None:
        pass


def late_aware_windows(events: DataFrame, width: int, delay: int) -> DataFrame:
    """Window counts and late rows of a stream of (source_id, row_id, at): source_id, row_id, at, window_start, n.

    Closed windows have no row_id; late rows have theirs, and count 1. ``width`` and ``delay`` in seconds. Rows without a
    time or a source take no part. Where one source has most of all rows, salt it and sum its windows on read. An
    end mark far in the future closes what is open. Late rows can be added to their windows by a sum, see ``settled``.
    """
    keyed = events.withWatermark("at", _NEVER).filter(F.when(F.col("at").isNull(), F.lit(False)).otherwise(F.col("source_id").isNotNull()))
    return keyed.select("source_id", "row_id", "at").groupBy("source_id").transformWithStateInPandas(
        LateAwareWindows(width, delay), "source_id string, row_id string, at timestamp, window_start timestamp, n long", "Append", "EventTime"
    )


def settled(counts: DataFrame) -> DataFrame:
    """(source_id, window_start, on_time, late): what ``late_aware_windows`` returned, in one row per window."""
    return counts.groupBy("source_id", "window_start").agg(
        F.sum(F.when(F.col("row_id").isNull(), F.col("n")).otherwise(0)).alias("on_time"), F.count_if(F.col("row_id").isNotNull()).alias("late")
    )


def leaf_shard(evidence_id: Column, shards: int) -> Column:
    """Shard of a leaf from the first two hash digits of its id; up to 256 shards."""
    return (F.conv(F.substring(F.md5(evidence_id), 1, 2), 16, 10).cast("int") % shards).cast("int")


def merkle_stream(leaves: DataFrame, size: int = 100, seconds: int = 300, shards: int = 8, delay: str = "1 second") -> DataFrame:
    """Closed Merkle batches: shard, batch_no, leaf_count, began, closed_by (size or time) and root_hash.

    ``leaves``: evidence_id, content_hash, at; rows without a hash are no leaves, but their time counts as seen. Leaves
    spread over ``shards`` open batches, so no key takes the whole stream. They should come in the order of their
    times but for ``delay``; later ones are left to the late-row table.
    """
    # a condition on the time stays behind the watermark, which so sees rows without a hash
    is_leaf = F.when(F.col("at").isNull(), F.lit(False)).otherwise(F.col("content_hash").isNotNull())
    keyed = leaves.withWatermark("at", delay).filter(is_leaf).select(
        leaf_shard(F.col("evidence_id"), shards).alias("shard"), "evidence_id", "content_hash", "at"
    )
    closed = keyed.groupBy("shard").transformWithStateInPandas(
        MerkleBatcher(size, seconds),
        "shard int, batch_no long, leaf_count long, began timestamp, closed_by string, peaks array<string>", "Append", "EventTime",
    )
    root = root_of_peaks(F.col("leaf_count"), F.col("peaks"), size)
    return closed.withColumn("root_hash", F.concat(F.lit("sha256:"), root)).drop("peaks")
