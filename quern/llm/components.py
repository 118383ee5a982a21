"""Connected components of links, as DataFrame rounds over tables in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, map_batches


#: Links that are contracted at once.
LINKS = 20_000


def _contract(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A star forest with the components of a batch's links, smallest number in the middle."""
    a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(names))
    left, right = flat[: len(a)], flat[len(a) :]
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        new = np.minimum(new, new[root])
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(names))
    return pa.RecordBatch.from_arrays([pa.array(names[root[moved]]), pa.array(names[moved])], ["a", "b"])


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and component (its smallest member) of every doc_id in links (a, b long).

    Large-star and small-star rounds alternate until the links are stars; the number of rounds grows
    with the logarithm of the longest chain. No component is gathered anywhere: a star is rows.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    now = scratch.keep(map_batches(links, _contract, "a long, b long").distinct(), batch_rows=LINKS)
    mark = None
    while True:
        # Large star: neighbours above a node go to the smallest of its neighbours and itself.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        up = both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a < b").distinct()
        large = scratch.keep(up)
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        down = large.join(low, "b").select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        small = scratch.keep(down)
        scratch.drop(now, large)
        now = small
        # Which links there are, up to hash collisions of two independent sums.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == mark:
            break
        mark = state
    # All links now lead from members to the smallest of the component.
    return now.select(F.col("b").alias("doc_id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("doc_id"), F.col("a").alias("component")).distinct())
