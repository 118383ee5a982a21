"""A versioned index of candidates in a shared folder: rebuilt, refreshed item by item, read as a snapshot.

A snapshot is a folder of its own. The file ``commits/<version>`` names the folder and the batch of changes that made it, and the highest
one is the current snapshot, so readers never see half of a write; a write that ends before its commit leaves a folder that
nobody reads and ``clean`` removes. Whoever reads old answers compares versions.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index without the changed items, and their new phrasings behind all others."""
    last = index.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last")).withColumn("one", F.lit(1))
    lowest = changed.agg(F.min("pos").alias("low")).withColumn("one", F.lit(1))
    # Both are one row. New places keep their order and distances.
    moved = changed.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").join(F.broadcast(lowest), "one")
    moved = moved.withColumn("pos", F.col("last") + 1 + F.col("pos") - F.col("low")).select(*index.columns)
    return delete(index, changed.select("item_id")).unionByName(moved)


def delete(index: DataFrame, items: DataFrame) -> DataFrame:
    return index.join(items.select("item_id").distinct(), "item_id", "left_anti").select(*index.columns)


class Commit(NamedTuple):
    version: int
    folder: str
    #: The batch of a stream that the snapshot holds, -1 for none.
    batch: int
    #: When it was written, in milliseconds.
    at: int


class ConcurrentWrite(RuntimeError):
    """Another writer has made the next version."""


class IndexStore:
    """Snapshots under one path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, part: str) -> dict[str, int]:
        """Names in a folder and when each was changed."""
        path, files = self._at(part)
        return {s.getPath().getName(): s.getModificationTime() for s in files.listStatus(path)} if files.exists(path) else {}

    def _commit_of(self, name: str, at: int) -> Commit | None:
        """What a commit says; None for one that its writer has not finished."""
        path, files = self._at("commits", name)
        with_text = files.open(path)
        try:
            said = self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_text, "UTF-8").split()
        finally:
            with_text.close()
        return Commit(int(name), said[0], int(said[1]), at) if len(said) == 2 else None

    def current(self) -> Commit | None:
        """The newest commit."""
        for name, at in sorted(((n, t) for n, t in self._listed("commits").items() if n.isdigit()), reverse=True):
            if commit := self._commit_of(name, at):
                return commit
        return None

    def version(self) -> int:
        """The current version; 0 before the first build."""
        commit = self.current()
        return commit.version if commit else 0

    def read(self) -> DataFrame | None:
        commit = self.current()
        return self.spark.read.parquet(f"{self.path}/data/{commit.folder}") if commit else None

    def ready(self) -> bool:
        """Whether there is a snapshot to answer from; callers ask again some seconds later if not."""
        return self.current() is not None

    def holds(self, batch: int | None) -> bool:
        """Whether the current snapshot holds a batch already; batches of a stream come in ascending order, the last one perhaps again."""
        commit = self.current()
        return batch is not None and commit is not None and batch <= commit.batch

    def _commit(self, version: int, folder: str, batch: int) -> None:
        path, files = self._at("commits", f"{version:012d}")
        if files.exists(path):
            raise ConcurrentWrite(f"version {version} is there")
        out = files.create(path, False)
        out.write(f"{folder} {batch}".encode())
        out.close()

    def rebuild(self, candidates: DataFrame, batch: int | None = None) -> int:
        """Write a new snapshot; returns its version. A batch that the current one holds makes no new version."""
        before = self.current()
        if self.holds(batch):
            return before.version
        folder = uuid.uuid4().hex
        candidates.write.parquet(f"{self.path}/data/{folder}")
        version = before.version if before else 0
        self._commit(version + 1, folder, batch if batch is not None else before.batch if before else -1)
        return version + 1

    def build(self, load: Callable[[], DataFrame]) -> bool:
        """Rebuild from what ``load`` gives; False if that fails, and the snapshot of before, or none, stays."""
        try:
            self.rebuild(load())
        except ConcurrentWrite:
            raise
        except Exception as error:  # whatever the source throws: the store answers as before
            print(f"the index was not built: {str(error).splitlines()[0]}")
            return False
        return True

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> int:
        """A snapshot with changed items replaced and removed ones left out."""
        if self.holds(batch):
            return self.version()
        index = self.read()
        if index is None:
            return self.rebuild(changed, batch)
        gone = index if removed is None else delete(index, removed)
        return self.rebuild(upsert(gone, changed), batch)

    def clean(self, grace_seconds: float) -> int:
        """Remove old versions, and folders without a commit, that are older than the grace period; returns how many folders.

        The current version stays, and so does one that became old, or was begun, within the period: readers and writers may use it.
        """
        before = (time.time() - grace_seconds) * 1000
        commits = sorted(filter(None, (self._commit_of(n, t) for n, t in self._listed("commits").items() if n.isdigit())))
        old = [a for a, b in zip(commits, commits[1:], strict=False) if b.at <= before]
        for commit in old:
            path, files = self._at("commits", f"{commit.version:012d}")
            files.delete(path, False)
        kept = {c.folder for c in commits} - {c.folder for c in old}
        gone = [n for n, at in self._listed("data").items() if n not in kept and at <= before]
        for name in gone:
            path, files = self._at("data", name)
            files.delete(path, True)
        return len(gone)
