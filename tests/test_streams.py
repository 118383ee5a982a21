"""Streams over files: restarts between write and commit, verdicts from state, observed counters."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import index_store, metrics
from quern.streaming import changes

CHANGES = "seq long, item_id string, op string"


@pytest.fixture
def feed(spark, tmp_path):
    """A store with items A to D, a folder of changes, and what the items are now."""
    store = index_store.IndexStore(spark, f"file://{tmp_path}/index")
    rows = spark.createDataFrame([(c, k, c.lower()) for k, c in enumerate("ABCD")], "item_id string, pos long, text string")
    store.rebuild(rows)
    fresh = rows.withColumn("text", F.upper("text"))
    load = lambda ids: fresh if ids is None else fresh.join(ids, "item_id", "left_semi")

    def change(number, *said):
        spark.createDataFrame([(number * 10 + k, i, op) for k, (i, op) in enumerate(said)], CHANGES).coalesce(1).write.parquet(f"{tmp_path}/changes/{number}")

    def start():
        stream = spark.readStream.schema(CHANGES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/changes")
        return changes.follow(stream, store, load, f"{tmp_path}/checkpoint").trigger(availableNow=True).start()

    return store, change, start


def texts(store):
    return {r.item_id: r.text for r in store.read().collect()}


@pytest.mark.parametrize("late", [False, True])
def test_a_feed_killed_around_the_commit_goes_on(feed, monkeypatch, late):
    """The query dies before the store's commit, or behind it and before its own; the batch comes again and counts once."""
    store, change, start = feed
    change(1, ("A", "refresh"), ("B", "remove"))
    commit = index_store.IndexStore._commit

    def broken(self, *args):
        if late:
            commit(self, *args)
        raise RuntimeError("lost")

    monkeypatch.setattr(index_store.IndexStore, "_commit", broken)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    assert store.version() == (2 if late else 1) and len(store._listed("data")) == 2
    monkeypatch.setattr(index_store.IndexStore, "_commit", commit)
    start().awaitTermination()
    assert store.version() == 2 and store.current().batch == 0 and texts(store) == {"A": "A", "C": "c", "D": "d"}
    # What the killed write left is nobody's; it goes, and so does the first version.
    assert store.clean(3600) == 0 and store.clean(-1) == (1 if late else 2) and len(store._listed("data")) == 1
    change(2, ("C", "refresh"), ("C", "remove"))
    change(3, ("x", "rebuild"), ("A", "remove"))
    start().awaitTermination()
    assert store.version() == 4 and store.current().batch == 2 and texts(store) == {c: c for c in "ABCD"}
    start().awaitTermination()
    assert store.version() == 4


def test_writers_do_not_overwrite_each_other(feed):
    store, _, _ = feed
    index, other = store.read(), index_store.IndexStore(store.spark, store.path)
    made = store.rebuild(index.limit(1))
    before, other.current = store.current(), lambda: index_store.Commit(made - 1, "x", -1, 0)
    with pytest.raises(index_store.ConcurrentWrite):
        other.rebuild(index)
    assert store.current() == before and store.read().count() == 1
    # A commit that its writer has not finished is none.
    path, files = store._at("commits", f"{made + 1:012d}")
    files.create(path, False).close()
    assert store.current() == before


def test_operations_follow_what_there_is_now(spark):
    nodes = spark.createDataFrame([("q1", "faqItem"), ("base", "knowledgeBase"), ("page", "home")], "id string, type string")
    flags = [(1, "q1", 2), (2, "base", 4), (3, "page", 2), (4, "gone", 8), (5, "q1", 1), (6, None, 8), (7, "gone", 16)]
    found = changes.operations(spark.createDataFrame(flags, "seq long, item_id string, flags int"), nodes).collect()
    assert {(r.seq, r.item_id, r.op) for r in found} == {(1, "q1", "refresh"), (2, "base", "rebuild"), (4, "gone", "remove")}


def test_verdicts_of_a_stream_equal_the_batch(spark, tmp_path):
    rng, start = random.Random(1), dt.datetime(2024, 1, 1)
    times = sorted(rng.randrange(600) for _ in range(120))
    rows = [(k, rng.choice((1, 1, 1, 2, 3)), start + dt.timedelta(seconds=s)) for k, s in enumerate(times)]
    schema = "event_id long, user_id long, ts timestamp"
    for k in range(0, 120, 30):
        spark.createDataFrame(rows[k : k + 30], schema).coalesce(1).write.parquet(f"{tmp_path}/events/{k:03d}")
    spark.createDataFrame([(900, 9, start + dt.timedelta(days=1))], schema).coalesce(1).write.parquet(f"{tmp_path}/events/900")
    expected = changes.fixed_window(spark.createDataFrame([*rows, (900, 9, start + dt.timedelta(days=1))], schema), "user_id", "ts", "30 seconds", 3, "event_id")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/events")
        verdicts = changes.window_verdicts(stream, "user_id", "ts", "30 seconds", 3, "event_id", late="1 minute")
        run = verdicts.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        columns = ["event_id", "user_id", "window_start", "n", "allowed"]
        found = spark.read.parquet(f"{tmp_path}/out").select(*columns)
        assert sorted(map(tuple, found.collect())) == sorted((r.event_id, r.user_id, r.window_start, r.n, r.allowed) for r in expected.collect())
        # Only the window of the last event still has state.
        state = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "seen").load()
        assert [r.key.user_id for r in state.collect()] == [9]
    finally:
        spark.conf.unset(provider)


def test_observed_calls(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("a", -3.0), ("z", 2.0), (None, 9.0), ("b", None)], "kind string, value double")
    watched, watch = metrics.observed(rows, "kind", "value", ("a", "b", "none"))
    assert watched.where("value > 0").count() == 4
    assert metrics.counted(watch.get, ("a", "b", "none")) == [("a", 2, -2.0, 1.0), ("b", 2, 5.0, 5.0), (None, 2, 11.0, 9.0)]
    plain = {r.kind: (r.n, r.total, r.largest) for r in metrics.totals(rows, "kind", "value", "value").collect()}
    assert all(plain[k] == (n, t, m) for k, n, t, m in metrics.counted(watch.get, ("a", "b", "none")) if k)


def test_counters_of_a_stream_add_up(spark, tmp_path):
    schema = "kind string, value double"
    for k in range(3):
        spark.createDataFrame([("a", float(k)), ("b", 10.0 * k), ("a", 1.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    counters = metrics.CallCounters(("a", "b"), "own")
    spark.streams.addListener(counters)
    try:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        watched, _ = metrics.observed(stream, "kind", "value", ("a", "b"), "own")
        run = watched.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if counters.totals.get("a", (0,))[0] == 6:
                break
            run.awaitTermination(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals == {"a": (6, 6.0, 2.0), "b": (3, 30.0, 20.0)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9
