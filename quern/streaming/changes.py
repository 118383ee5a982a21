"""Change feeds and fixed-window limits, for streams too, and the memory of responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from quern.operators.index_store import IndexStore
from quern.sources.tables import kept, shared_path

REFRESH_NODE, REFRESH_BRANCH, REMOVE = 2, 4, 8


def relevant(changes: DataFrame, mask: int = REFRESH_NODE | REFRESH_BRANCH | REMOVE) -> DataFrame:
    return changes.where(F.col("flags").bitwiseAND(mask) != 0)


def last_changes(changes: DataFrame) -> DataFrame:
    """The last operation per item of a batch: item_id, op."""
    return changes.groupBy("item_id").agg(F.max_by("op", "seq").alias("op"))


def operations(changes: DataFrame, nodes: DataFrame, base: str = "knowledgeBase", item: str = "faqItem") -> DataFrame:
    """seq, item_id and op of the relevant changes: a changed item is refreshed, a changed base rebuilds all, what is gone is removed, the rest is left out."""
    kind = nodes.select(F.col("id").alias("item_id"), F.col("type").alias("quern_type"))
    op = F.when(F.col("quern_type") == item, "refresh").when(F.col("quern_type") == base, "rebuild").when(F.col("quern_type").isNull(), "remove")
    found = relevant(changes).join(kind, "item_id", "left").withColumn("op", op)
    return found.where("op is not null and item_id is not null").select("seq", "item_id", "op")


def apply_changes(store: IndexStore, load: Callable[[DataFrame | None], DataFrame], grace_seconds: float | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: ``load`` gives the candidates of the named items, or of all for None.

    A batch that comes again, as its query ended before it could note the batch as done, makes no new version. With a grace period, older
    versions are removed behind each batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if store.holds(batch_id):
            return
        last = kept(last_changes(batch), shared_path(batch.sparkSession, "changes"))
        if last.isEmpty():
            return
        if not last.where("op = 'rebuild'").isEmpty():
            store.rebuild(load(None), batch_id)
        else:
            refreshed = last.where("op = 'refresh'").select("item_id")
            store.refresh(load(refreshed), last.select("item_id"), batch_id)
        if grace_seconds is not None:
            store.clean(grace_seconds)

    return run


def follow(changes: DataFrame, store: IndexStore, load: Callable[[DataFrame | None], DataFrame], checkpoint: str, grace_seconds: float | None = None) -> DataStreamWriter:
    """The writer of a change feed (seq, item_id, op) into the store; the caller sets the trigger and starts it."""
    return changes.writeStream.foreachBatch(apply_changes(store, load, grace_seconds)).option("checkpointLocation", checkpoint)


def fixed_window(events: DataFrame, client: str, ts: str, width: str, permits: int, *order: str) -> DataFrame:
    """Each event with its number in the client's window and whether it is allowed; windows start at the epoch."""
    placed = events.withColumn("window_start", F.window(ts, width)["start"])
    turn = Window.partitionBy(client, "window_start").orderBy(ts, *order)
    return placed.withColumn("n", F.row_number().over(turn)).withColumn("allowed", F.col("n") <= permits)


def rejected_counts(events: DataFrame, client: str, ts: str, width: str, permits: int, late: str = "10 minutes") -> DataFrame:
    """The same for a stream: per client and window how many events and how many beyond the permits."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, width), client).agg(F.count("*").alias("n"))
    return counts.select(client, F.col("window.start").alias("window_start"), "n", F.greatest(F.lit(0), F.col("n") - permits).alias("rejected"))


class Permits(StatefulProcessor):
    """Numbers a client's events in one window, from batch to batch; what it counts goes when the window is over."""

    def __init__(self, permits: int, ts: str, order: list[str], width_ms: int) -> None:
        self.permits, self.ts, self.order, self.width_ms = permits, ts, order, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # A client's events of one window and batch; the trigger's limits bound them.
        some = pd.concat(list(rows), ignore_index=True).sort_values([self.ts, *self.order], kind="stable")
        before = self.seen.get()[0] if self.seen.exists() else 0
        if not before:
            self.handle.registerTimer(int(pd.Timestamp(key[1]).timestamp() * 1000) + self.width_ms)
        self.seen.update((before + len(some),))
        some["n"] = np.arange(before + 1, before + len(some) + 1)
        some["allowed"] = some["n"] <= self.permits
        yield some

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def window_verdicts(events: DataFrame, client: str, ts: str, width: str, permits: int, *order: str, late: str = "10 minutes") -> DataFrame:
    """fixed_window for a stream: each event once with its number in the client's window and whether it is allowed.

    Events are numbered as they come, those of one batch by time; events that are later than the watermark allows are left out.
    """
    first, second = events.sparkSession.sql(f"SELECT timestamp_seconds(0) AS a, timestamp_seconds(0) + interval {width} AS b").first()
    width_ms = int((second - first).total_seconds() * 1000)
    placed = events.withWatermark(ts, late).withColumn("window_start", F.window(ts, width)["start"])
    schema = T.StructType([*placed.schema.fields, T.StructField("n", T.LongType()), T.StructField("allowed", T.BooleanType())])
    grouped = placed.groupBy(client, "window_start")
    return grouped.transformWithStateInPandas(Permits(permits, ts, list(order), width_ms), schema, "Append", "EventTime")


def from_memory(requests: DataFrame, key: str, ts: str, idle_seconds: int = 900, most_seconds: int = 3600) -> DataFrame:
    """requests with ``hit``: whether a reply was known that was last used less than idle and made less than most seconds ago.

    Requests of one key are gone through in order of time, in one task without being gathered; what is kept is two times.
    """
    place = requests.columns.index(key), requests.columns.index(ts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made, used = None, 0, 0
        for batch in batches:
            hits = []
            for own, time in zip(batch.column(place[0]).to_pylist(), batch.column(place[1]).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist(), strict=True):
                hit = own == at and time - used < idle_seconds * 1_000_000 and time - made < most_seconds * 1_000_000
                at, made, used = own, made if hit else time, time
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], [*batch.schema.names, "hit"])

    ordered = requests.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).repartition(key).sortWithinPartitions(key, ts)
    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField("hit", T.BooleanType())]))
