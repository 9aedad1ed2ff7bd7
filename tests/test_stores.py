"""The stored entity table, the event bus and their restarts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from duskwire.sources.bus import FileBus
from duskwire.sources.entity_table import EntityTable

T0 = dt.datetime(2024, 1, 1)
SPAN = "entity_id string, kind string, normalized string, value string, first_seen timestamp, last_seen timestamp"


def spans(spark, *rows):
    return spark.createDataFrame([(f"id-{k}-{n}", k, n, v, T0 + dt.timedelta(days=a), T0 + dt.timedelta(days=b)) for k, n, v, a, b in rows], SPAN)


def state(table, **kw):
    return {(r["kind"], r["normalized"]): (r["entity_id"], r["value"], (r["first_seen"] - T0).days, (r["last_seen"] - T0).days) for r in table.read(**kw).collect()}


def test_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    table = EntityTable(spark, str(tmp_path / "t"), buckets=8)
    assert state(table) == {}
    first = [("ip", f"10.0.0.{i}", "v", 0, 1) for i in range(40)]
    assert len(table.upsert(spans(spark, *first), 0)) == 8
    before = table.commit_of(0)["buckets"]
    touched = table.upsert(spans(spark, ("ip", "10.0.0.3", "new", 2, 5), ("onion", "x", "X", 3, 3)), 1)
    after = table.commit_of(1)["buckets"]
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before[b]} == {str(b) for b in touched}
    rows = state(table)
    assert len(rows) == 41 and rows["ip", "10.0.0.3"] == ("id-ip-10.0.0.3", "v", 0, 5) and rows["onion", "x"][2:] == (3, 3)
    assert len(state(table, version=0)) == 40, "an older commit is still there"


def test_repeated_and_failed_batches_change_nothing(spark, tmp_path, monkeypatch):
    table = EntityTable(spark, str(tmp_path / "t"), buckets=4)
    table.upsert(spans(spark, ("ip", "a", "v", 0, 1)), 5)
    rows = state(table)
    assert table.upsert(spans(spark, ("ip", "a", "v", 0, 9)), 5) == [] and table.upsert(spans(spark, ("ip", "a", "v", 0, 9)), 4) == []
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost before the commit")))
        with pytest.raises(OSError):
            table.upsert(spans(spark, ("ip", "a", "v", 0, 7)), 6)
    assert state(table) == rows and table.versions() == [0]
    # the same batch goes through afterwards, and a second source has numbers of its own
    assert table.upsert(spans(spark, ("ip", "a", "v", 0, 7)), 6) and table.upsert(spans(spark, ("ip", "b", "v", 0, 7)), 0, source="other")
    assert state(table)["ip", "a"][3] == 7 and len(state(table)) == 2
    with pytest.raises(Exception):  # noqa: B017  a commit's number is taken once
        table._publish(1, {})
    assert len(state(table)) == 2
    assert table.upsert(spans(spark), 7) == [] and len(state(table)) == 2


def events(spark, lo, hi):
    return spark.range(lo, hi).select(F.concat(F.lit("k"), (F.col("id") % 4).cast("string")).alias("key"), F.col("id").cast("string").alias("value"))


def values(df):
    return sorted(int(r["value"]) for r in df.collect())


def test_groups_start_where_they_ask_and_go_on_where_they_stopped(spark, tmp_path):
    bus = FileBus(spark, str(tmp_path / "bus"), partitions=2)
    bus.publish(events(spark, 0, 10), "t", 0)
    assert values(bus.consume("t", "all", from_beginning=True)) == list(range(10))
    assert values(bus.consume("t", "late")) == []
    bus.publish(events(spark, 10, 25), "t", 1)
    bus.publish(events(spark, 0, 99), "t", 1)  # the batch is there already
    again = FileBus(spark, str(tmp_path / "bus"), partitions=2)  # a new process
    assert values(again.consume("t", "all")) == list(range(25)), "the start is chosen once"
    assert values(again.consume("t", "late", from_beginning=True)) == list(range(10, 25))
    assert values(again.consume("t", "all")) == list(range(25)), "nothing comes twice"
    for r in bus.log("t").groupBy("partition").agg(F.sort_array(F.collect_list("offset")).alias("o")).collect():
        assert r["o"] == list(range(len(r["o"])))


def test_a_group_may_come_before_its_topic(spark, tmp_path):
    bus = FileBus(spark, str(tmp_path / "bus"))
    assert values(bus.consume("t", "g")) == []
    bus.publish(events(spark, 0, 5).unionByName(events(spark, 0, 2)), "t", 0)
    assert values(bus.consume("t", "g")) == [0, 0, 1, 1, 2, 3, 4]
