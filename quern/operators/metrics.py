"""Counters of calls, and what happened between two snapshots of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def totals(rows: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """Per call type: count, sum, largest and first value."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"), F.min_by(value, F.struct(*order)).alias("first_value"))


def difference(now: DataFrame, before: DataFrame, by: str) -> DataFrame:
    """Counts and sums less those of before; the largest stays, and the first value counts only if there was none."""
    old = before.select(by, F.col("n").alias("old_n"), F.col("total").alias("old_total"), F.col("first_value").alias("old_first"))
    none = F.coalesce("old_first", F.lit(0.0)) == 0
    return now.join(old, by, "left").select(
        by, (F.col("n") - F.coalesce("old_n", F.lit(0))).alias("n"), (F.col("total") - F.coalesce("old_total", F.lit(0.0))).alias("total"), "largest",
        F.when(none, F.col("first_value")).otherwise(F.lit(0.0)).alias("first_value"),
    )


def counters(by: str, value: str, calls: tuple[str, ...]) -> list[Column]:
    """Count, sum and largest value of each named call, as aggregates of one row; the last three are those of all other calls."""
    out, known = [], F.coalesce(F.col(by).isin(list(calls)), F.lit(False))
    for k, is_call in enumerate([F.col(by) == c for c in calls] + [~known]):
        own = F.when(is_call, F.col(value))
        out += [F.count_if(is_call).alias(f"n_{k}"), F.sum(own).alias(f"total_{k}"), F.max(own).alias(f"largest_{k}")]
    return out


def observed(rows: DataFrame, by: str, value: str, calls: tuple[str, ...], name: str = "calls") -> tuple[DataFrame, Observation]:
    """rows that count their calls while they are read for something else, and where the counters are found then. For a stream, give the name to CallCounters."""
    watch = Observation(name)
    return rows.observe(name if rows.isStreaming else watch, *counters(by, value, calls)), watch


def counted(found: dict, calls: tuple[str, ...]) -> list[tuple[str | None, int, float, float | None]]:
    """(call, n, total, largest) of the calls that happened; None stands for all others."""
    every = [(c, found[f"n_{k}"], found[f"total_{k}"] or 0.0, found[f"largest_{k}"]) for k, c in enumerate([*calls, None])]
    return [row for row in every if row[1]]


class CallCounters(StreamingQueryListener):
    """Adds up, batch by batch, what streams with observed calls report; no rows are read for it."""

    def __init__(self, calls: tuple[str, ...], name: str = "calls") -> None:
        self.calls, self.name = calls, name
        self.totals: dict[str | None, tuple[int, float, float | None]] = {}

    def add(self, found: Row | dict) -> None:
        for call, n, total, largest in counted(found if isinstance(found, dict) else found.asDict(), self.calls):
            m, sum_, most = self.totals.get(call, (0, 0.0, None))
            self.totals[call] = (m + n, sum_ + total, largest if most is None else max(most, largest))

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.add(found)

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        pass
