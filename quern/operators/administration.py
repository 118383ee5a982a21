"""Reports and guarded changes of seeded items: (id, parent_id, name, sort_order, published, publishable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixed(name: Column, prefix: str) -> Column:
    """Whether the name starts with the prefix, in any case."""
    return F.coalesce(F.startswith(F.lower(name), F.lit(prefix.lower())), F.lit(False))


def paged_children(nodes: DataFrame, parent: str, prefix: str, page: int = 0, size: int = 1000) -> DataFrame:
    """Of one page of the children of a parent, by sort order, those whose name has the prefix."""
    first = nodes.where(F.col("parent_id") == parent).orderBy("sort_order", "id").offset(page * size).limit(size)
    return first.where(prefixed(F.col("name"), prefix))


def status_report(nodes: DataFrame, parent: str, prefix: str) -> DataFrame:
    """One row: children, those with the prefix, published and publishable ones of them, and the names of the first three."""
    own = nodes.where(F.col("parent_id") == parent)
    seeded = prefixed(F.col("name"), prefix)
    samples = own.where(seeded).orderBy("sort_order", "id").limit(3).agg(F.array_sort(F.collect_list(F.struct("sort_order", "id", "name"))).alias("s"))
    report = own.agg(
        F.count("*").alias("total"), F.count_if(seeded).alias("seeded"), F.count_if(seeded & F.col("published")).alias("published"), F.count_if(seeded & F.col("publishable")).alias("publishable")
    )
    # Both are one row.
    both = report.withColumn("one", F.lit(1)).join(F.broadcast(samples.withColumn("one", F.lit(1))), "one")
    return both.select("total", "seeded", "published", "publishable", F.array_join("s.name", ",").alias("samples"))


def seed_report(existing: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """One row: how many rows a load creates, and how many it skips as their name exists in any case."""
    known = existing.select(F.lower(name).alias("low"), F.lit(1).alias("known")).distinct()
    marked = rows.select(F.lower(name).alias("low")).join(known, "low", "left")
    return marked.agg(F.count_if(F.col("known").isNull()).alias("created"), F.count("known").alias("skipped"))


def guarded_cleanup(nodes: DataFrame, wrong: str, right: str, prefix: str, expected: int) -> DataFrame:
    """nodes without the seeded children of the wrong parent, if both parents have exactly the expected number of them; else all nodes."""
    if wrong == right:
        raise ValueError("the parents are the same")
    seeded = prefixed(F.col("name"), prefix)
    count = lambda parent: F.count_if(seeded & (F.col("parent_id") == parent))
    guard = nodes.agg(((count(wrong) == expected) & (count(right) == expected)).alias("clean")).withColumn("one", F.lit(1))  # one row
    doomed = F.col("clean") & seeded & (F.coalesce("parent_id", F.lit("")) == wrong)
    return nodes.withColumn("one", F.lit(1)).join(F.broadcast(guard), "one").where(~doomed).select(*nodes.columns)
