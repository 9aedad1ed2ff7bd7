"""Streams over several batches that end, late rows, long icons and CSV files."""
import datetime as dt
import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from duskwire.functions.hashing import murmur3_32
from duskwire.sources import sinks
from duskwire.streaming import jobs, stateful
from duskwire.streaming.replay import replayed
from duskwire.streaming.run import drain, drain_closed, drain_updates, table_stream

T0 = dt.datetime(2024, 1, 1)
EVENTS = StructType([StructField("source_id", StringType()), StructField("content_hash", StringType()), StructField("observed_at", TimestampType())])


def landed(spark, path, files):
    """One file per list of (source, hash, minute), in order, as a stream of one file per batch."""
    for rows in files:
        data = [(s, h, T0 + dt.timedelta(minutes=m)) for s, h, m in rows]
        spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(path)
    return table_stream(spark, path, EVENTS, files_per_trigger=1)


# a batch drops what the watermark of the batch before it had passed
def test_rate_closes_windows_and_counts_late_rows(spark, tmp_path):
    stream = landed(spark, str(tmp_path / "in"), [
        [("a", "x", 0), ("a", "y", 1)], [("a", "z", 120)], [("b", "w", 121)], [("a", "late", 2)],
    ])
    late = []
    rows = drain_closed(stream, "observed_at", jobs.rate, "t", late).collect()
    got = {(r["source_id"], int((r["window_start"] - rows[0]["window_start"]).total_seconds())): r["n"] for r in rows}
    assert sorted(got.values()) == [1, 1, 2] and {r["source_id"] for r in rows} == {"a", "b"}
    assert late == [1, 0]


def test_sessions_grow_over_batches_and_close(spark, tmp_path):
    stream = landed(spark, str(tmp_path / "in"), [[("a", "x", 0)], [("a", "y", 8), ("b", "y", 9)], [("a", "z", 100)]])
    rows = drain_closed(stream, "observed_at", lambda e: jobs.sessions(e, "source_id"), "t").collect()
    assert sorted((r["source_id"], r["n"]) for r in rows) == [("a", 1), ("a", 2), ("b", 1)]


def test_repeats_in_later_batches_are_dropped(spark, tmp_path):
    stream = landed(spark, str(tmp_path / "in"), [[("a", "x", 0)], [("b", "x", 3), ("b", "y", 4)], [("c", "y", 5), ("c", "z", 6)]])
    assert sorted(r["content_hash"] for r in drain(jobs.dedup(stream), "t").collect()) == ["x", "y", "z"]


def test_spans_carry_over_batches(spark, tmp_path):
    stream = landed(spark, str(tmp_path / "in"), [[("a", "x", 5)], [("a", "x", 1)], [("a", "x", 9), ("b", "x", 2)]])
    hits = stream.select(F.col("source_id").alias("kind"), F.col("content_hash").alias("normalized"), "observed_at")
    rows = drain_updates(jobs.spans(hits), "t", ["kind", "normalized"]).collect()
    assert {(r["kind"], (r["last_seen"] - r["first_seen"]).total_seconds()) for r in rows} == {("a", 480.0), ("b", 0.0)}


def test_empty_stream_has_no_windows(spark, tmp_path):
    stream = landed(spark, str(tmp_path / "in"), [[]])
    assert drain_closed(stream, "observed_at", jobs.rate, "t").count() == 0


def greedy(times, size, seconds):
    """(first, after, closed_by) of stream batches over ascending times."""
    out, i = [], 0
    while i < len(times):
        j = i + 1
        while j < len(times) and j - i < size and times[j] < times[i] + seconds:
            j += 1
        out.append((i, j, "size" if j - i == size else "time"))
        i = j
    return out


def test_merkle_batches_by_size_and_time_over_many_batches(spark):
    """The peaks are carried from batch to batch; every leaf ends in one batch, whichever rule closes it."""
    ids = range(140)
    at = {i: i * 2 + 90 * (i // 45) for i in ids}
    rows = [(str(i), f"sha256:{hashlib.sha256(b'%d' % i).hexdigest()}", T0 + dt.timedelta(seconds=at[i])) for i in ids]
    rows += [("none", None, T0), ("x", None, None)]
    leaves = spark.createDataFrame(rows, "evidence_id string, content_hash string, at timestamp")
    shard_of = {r["evidence_id"]: r["s"] for r in leaves.select("evidence_id", stateful.leaf_shard(F.col("evidence_id"), 2).alias("s")).collect()}
    with stateful.rocksdb(spark):
        got = replayed(leaves, "at", 100, "t", lambda s: stateful.merkle_stream(s, 9, 40, 2), end=True).collect()
    want = set()
    for shard in (0, 1):
        mine = [r for r in rows if r[1] and shard_of[r[0]] == shard]
        for n, (a, b, by) in enumerate(greedy([at[int(r[0])] for r in mine], 9, 40)):
            want.add((shard, n, b - a, by, "sha256:" + stateful.merkle_root([r[1] for r in mine[a:b]])))
    assert {(r["shard"], r["batch_no"], r["leaf_count"], r["closed_by"], r["root_hash"]) for r in got} == want and len(got) == len(want)
    assert {w[3] for w in want} == {"size", "time"}


def test_replay_admits_slices_in_order(spark):
    rows = [(i, T0 + dt.timedelta(minutes=(i * 37) % 100)) for i in range(100)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, at timestamp").repartition(5)
    out = replayed(df, "at", 1200, "t", lambda s: s.withColumn("batch", F.current_timestamp())).collect()
    assert sorted(r["id"] for r in out) == [*range(100), 200]
    spans = sorted((min(r["at"] for r in g), max(r["at"] for r in g)) for g in
                   ([r for r in out if r["batch"] == b and r["at"]] for b in {r["batch"] for r in out}))
    assert len(spans) == 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert {r["slice"] for r in out} == {0, 1, 2, 3, 4} and [r["slice"] for r in out if r["id"] == 200] == [0]
    assert replayed(df.limit(0), "at", 60, "t").collect() == []


def test_late_rows_have_a_table_of_their_own(spark):
    """Marks are those of each source up to the slice before; on time and late together are all rows."""
    rows = [("a", str(i), T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i + (200 if i % 7 == 0 else 0))) for i in range(300)]
    rows += [("slow", f"s{i}", T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i + 400)) for i in range(30)]
    rows += [(None, "x", T0, T0), ("a", "y", None, T0)]
    df = spark.createDataFrame(rows, "source_id string, row_id string, at timestamp, delivered timestamp").repartition(3)
    with stateful.rocksdb(spark):
        out = replayed(df, "delivered", 3600, "t", lambda s: stateful.late_aware_windows(s, 600, 900), end=["delivered", "at"]).collect()
    mark, late, counts = {}, set(), {}
    for number in sorted({(r[3] - T0) // dt.timedelta(hours=1) for r in rows}):
        mine = [r for r in rows[:-2] if (r[3] - T0) // dt.timedelta(hours=1) == number]
        for source, i, at, _ in mine:
            start = (at - T0) // dt.timedelta(minutes=10)
            if source in mark and T0 + dt.timedelta(minutes=10 * start + 10) <= mark[source] - dt.timedelta(minutes=15):
                late.add((source, i))
            else:
                counts[source, start] = counts.get((source, start), 0) + 1
        for source, _, at, _ in mine:
            mark[source] = max(mark.get(source, at), at)
    assert {(r["source_id"], r["row_id"]) for r in out if r["row_id"]} == late and late
    assert not any(s == "slow" for s, _ in late), "a source that lags behind the others is not late"
    epoch = min(r["window_start"] for r in out)
    assert {(r["source_id"], int((r["window_start"] - epoch).total_seconds() // 600)): r["n"] for r in out if not r["row_id"]} == counts
    assert sum(counts.values()) + len(late) == 330


def reference_murmur(data):
    h, m = 0, 0xFFFFFFFF
    for i in range(0, len(data), 4):
        block = data[i : i + 4]
        k = int.from_bytes(block, "little") * 0xCC9E2D51 & m
        k = ((k << 15 | k >> 17) & m) * 0x1B873593 & m
        h ^= k
        if len(block) == 4:
            h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_one_long_icon_among_many():
    data = [bytes(range(i % 256)) for i in range(2000)] + [b"icon" * 400_000 + b"xyz", None, b"q" * 65_536, b"q" * 65_537]
    got = murmur3_32(pd.Series(data)).tolist()
    assert got[2001] is pd.NA
    assert [g for g in got if g is not pd.NA] == [reference_murmur(d) for d in data if d is not None]


def test_csv_gives_back_what_was_written(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith a break', T0 + dt.timedelta(microseconds=123456)), (2, "", T0), (3, None, None), (4, "back\\slash", T0)]
    df = spark.createDataFrame(rows, "id long, v string, t timestamp")
    sinks.csv(df, str(tmp_path / "csv"))
    back = sinks.read_csv(spark, df.schema, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted((i, v or None, t) for i, v, t in rows)


def test_slices_land_together_up_to_a_number_of_rows(spark):
    """The number of micro-batches follows the rows, not the replayed time; slices stay whole and in order."""
    from duskwire.streaming.replay import landings

    assert landings([(0, 2), (3, 2), (4, 9), (7, 1), (9, 1)], 4) == [(0, 3), (4, 4), (7, 9)]
    assert landings([(0, 2), (3, 2)], None) == [(0, 0), (3, 3)] and landings([], 5) == []
    rows = [(f"e{i}", f"{i:064x}", T0 + dt.timedelta(seconds=97 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "evidence_id string, content_hash string, at timestamp").repartition(5)
    out = replayed(df, "at", 100, "t", lambda s: s.withColumn("batch", F.current_timestamp()), rows_together=25).collect()
    assert len(out) == 60 and len({r["batch"] for r in out}) == 3
    assert all(len({r["batch"] for r in out if r["slice"] == x}) == 1 for x in {r["slice"] for r in out})
    with stateful.rocksdb(spark):
        got, one = (
            {tuple(r) for r in replayed(df, "at", 1000, "t", lambda s: stateful.merkle_stream(s, 9, 300, 2), end=True, rows_together=n).collect()} for n in (25, None)
        )
    assert got == one and sum(r[2] for r in got) == 60


def test_newest_samples_of_many_urls_share_states(spark, tmp_path):
    schema = "url string, probed_at timestamp, clock_skew double"
    rows = [(f"u{i % 60}" if i % 3 else "hot", T0 + dt.timedelta(minutes=i * 7919 % 4001), i % 5 / 10) for i in range(3000)] + [(None, T0, 1.0), ("u1", None, 2.0), ("none", None, None)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = table_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    with stateful.rocksdb(spark):
        got = drain_updates(stateful.last_samples(stream, 4, buckets=3), "t", ["url", "rn"]).collect()
    want = {}
    for url, at, skew in rows:
        want.setdefault(url, []).append((at is not None, at or T0, -1 if skew is None else skew))
    want = {(url, n): (at if known else None, None if skew == -1 else skew) for url, v in want.items() for n, (known, at, skew) in enumerate(sorted(v, reverse=True)[:4], 1)}
    assert {(r["url"], r["rn"]): (r["probed_at"], r["clock_skew"]) for r in got} == want


def test_a_task_sends_the_newest_samples_alone():
    frame = pd.DataFrame({"url": ["hot"] * 250_000, "probed_at": pd.to_datetime(range(250_000), unit="s"), "clock_skew": 0.5})
    sent = pd.concat(stateful.newest_of_task((frame[i:i + 10_000] for i in range(0, len(frame), 10_000)), 20))
    assert sorted(sent["probed_at"]) == list(frame["probed_at"][-20:])


def test_keyed_states_take_one_task_per_core(spark):
    """Each task of a micro-batch starts a Python worker, so more of them than cores only add starts."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")
    before = [spark.conf.get(n) for n in names]
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set(names[0], cores + 30)
    try:
        with stateful.rocksdb(spark):
            assert int(spark.conf.get(names[0])) == cores
        assert int(spark.conf.get(names[0])) == cores + 30
    finally:
        spark.conf.set(names[0], before[0])
    assert [spark.conf.get(n) for n in names] == before
