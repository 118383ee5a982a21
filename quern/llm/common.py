"""Shared plumbing of the training-data operators: tables, scratch tables, Arrow slabs."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into NumPy arrays at once; one longer text is a slab of its own.
SLAB_BYTES = 1 << 20
#: Bits of the filter that spares most rows a shuffle (1 MB, whatever the input).
FILTER_BITS = 1 << 23
#: Rows of an Arrow batch; texts are a few KB, so a batch stays near 2 MB.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as one text may be long; a smaller setting stays."""
    if int(spark.conf.get(BATCH_KEY, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside; the setting of before holds again behind it."""
    before = spark.conf.get(BATCH_KEY, "10000")
    spark.conf.set(BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in a local session, whose workers all see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = f"{scratch_root(spark)}/quern-{label}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, batch_rows: int | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        with batches_of(self.spark, batch_rows or min(BATCH_ROWS, int(self.spark.conf.get(BATCH_KEY, "10000")))):
            df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._quern_path = path
        return kept

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no returned plan reads."""
        for table in tables:
            self._remove(table._quern_path)

    def only(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        left = {table._quern_path for table in tables}
        for k in range(1, self.count + 1):
            if (path := f"{self.base}/{k}") not in left:
                self._remove(path)


def with_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, under the operator's own names, whatever else the table holds."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def give_back() -> None:
    """Return freed memory to the system, as a worker lives on after its task and shares a bounded container."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, ended: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow of a function from batch to batch, and one that is called when a task has no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out
        if ended is not None:
            ended()
        give_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, mask: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of df, all columns, that the mask of their texts keeps."""
    place = df.columns.index(text)
    return map_batches(df, lambda batch: batch.filter(pa.array(mask(batch.column(place)), pa.bool_())), df.schema)


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of df whose key is not in ids (a kept table): only those that a bit filter can't rule out are shuffled."""
    maybe, surely = prefiltered(df, ids.select(F.col("doc_id").alias(key)), key)
    return surely.unionByName(maybe.join(ids.select(F.col("doc_id").alias(key)), key, "left_anti").select(*df.columns))


def prefiltered(rows: DataFrame, wanted: DataFrame, key: str = "doc_id", bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """rows that may have a key of wanted, and those that surely have none, by a bit filter of fixed size."""
    spot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(cast(`{key}` as long)), 64) as int))")
    word, held = (next(n for k in range(10**9) if (n := f"quern_{name}{k or ''}") not in rows.columns) for name in ("word", "bits"))
    words = wanted.where(F.col(key).isNotNull()).select(F.shiftright(spot, 6).alias(word), bit.alias("bit"))
    # At most bits / 64 rows (131,072 by default), and so safe to broadcast.
    words = F.broadcast(words.groupBy(word).agg(F.bit_or("bit").alias(held)))
    marked = rows.withColumn(word, F.shiftright(spot, 6)).join(words, word, "left")
    hit = F.coalesce(F.col(held).bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, end row, byte offsets from 0, UTF-8 bytes); a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, ends[first : end + 1] - ends[first], raw[ends[first] : ends[end]]
        first = end
