"""Readers and writers of the tables that the operators take."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS = "id string, question string, answer string, alternative_questions array<string>, kind string"
SUBMISSION_VALUES = "submission_id decimal(20,0), key string, value string"


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder that the cluster names; in a folder of our own only in a local session where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root}/quern-{label}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


#: Of each open scope the places made in it.
_MADE: list[list[str]] = []


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the shared tables that operators made inside; results have to be written or read by then."""
    _MADE.append([])
    try:
        yield
    finally:
        remove(spark, *_MADE.pop())


def kept(df: DataFrame, path: str) -> DataFrame:
    """df from a table written to the path, which cuts its lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def missing_names(present: Column, required: tuple[str, ...]) -> Column:
    """The required names that an array of names lacks in any case, in their order."""
    low = F.transform(present, lambda p: F.lower(p))
    return F.filter(F.array(*map(F.lit, required)), lambda r: ~F.array_contains(low, F.lower(r)))


def json_items(spark: SparkSession, path: str, expected: int | None = None, multi_line: bool = True) -> DataFrame:
    """Items of a JSON array, or of lines of objects; property names in any case. Another number of items than expected raises."""
    raw = spark.read.option("multiLine", multi_line).json(path)
    by_name = {c.lower().replace("_", ""): c for c in raw.columns}
    schema: T.StructType = T._parse_datatype_string(ITEMS)
    missing = [n for n in ("id", "question", "answer") if n not in by_name]
    if missing:
        raise ValueError(f"items lack {', '.join(missing)}")
    none = F.lit(None)
    out = raw.select(*[(F.col(by_name[k]) if (k := f.name.replace("_", "")) in by_name else none).cast(f.dataType).alias(f.name) for f in schema])
    if expected is not None and (found := out.count()) != expected:
        raise ValueError(f"{found} items instead of {expected}")
    return out


#: The driver of the database that comes with Spark.
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


class Database:
    """Tables of a database, read where they lie: predicates and columns go to it, and so does the choice of the newest rows."""

    def __init__(self, spark: SparkSession, url: str, driver: str, **options: str) -> None:
        self.spark, self.options = spark, {"url": url, "driver": driver} | options

    @staticmethod
    def _name(name: str) -> str:
        """A table's name, as the database folds it."""
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", name):
            raise ValueError(f"no plain name: {name}")
        return name

    def _column(self, name: str) -> str:
        """A column's name, as it is written."""
        return f'"{self._name(name)}"'

    def table(self, name: str) -> DataFrame:
        """In one part, for what a predicate leaves little of."""
        return self.spark.read.format("jdbc").options(dbtable=self._name(name), **self.options).load()

    def in_ranges(self, name: str, key: str, parts: int) -> DataFrame:
        """In so many ranges of a key, from its smallest to its largest value, read side by side."""
        bounds = self.spark.read.format("jdbc").options(query=f"SELECT MIN({self._column(key)}) AS LOW, MAX({self._column(key)}) AS HIGH FROM {self._name(name)}", **self.options)
        low, high = bounds.load().first()
        if low is None or parts < 2:
            return self.table(name)
        ranges = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(int(high) + 1), "numPartitions": str(parts)}
        return self.spark.read.format("jdbc").options(dbtable=name, **ranges, **self.options).load()

    def newest(self, name: str, columns: tuple[str, ...], key: str, take: int, equal: dict[str, str] | None = None) -> DataFrame:
        """The rows of the largest keys, chosen by the database."""
        tests = [f"{self._column(c)} = '{v.replace(chr(39), chr(39) * 2)}'" for c, v in (equal or {}).items()]
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        chosen = f"SELECT {', '.join(map(self._column, columns))} FROM {self._name(name)}{where} ORDER BY {self._column(key)} DESC OFFSET 0 ROWS FETCH NEXT {int(take)} ROWS ONLY"
        return self.spark.read.format("jdbc").options(dbtable=f"({chosen}) newest", **self.options).load()


def knowledge_items(nodes: DataFrame, base: str = "knowledgeBase", item: str = "faqItem") -> DataFrame:
    """Children of the first knowledge base directly below a root, in tree order; none without a base."""
    roots = nodes.where("parent_id is null").select(F.col("id").alias("parent_id"), F.col("sort_order").alias("root_order"))
    found = nodes.where(F.col("type") == base).join(roots, "parent_id")
    first = found.orderBy("root_order", "parent_id", "sort_order", "id").limit(1).select(F.col("id").alias("parent_id"))
    return nodes.where(F.col("type") == item).join(F.broadcast(first), "parent_id")  # one row


def look_up(nodes: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """wanted (id) with the columns of the node of that id; nulls where there is none, or one of another type."""
    return wanted.select("id").join(nodes.where(F.col("type") == kind), "id", "left")
