"""Form submissions: headers with key-value rows, their validation, writing and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fields
from quern.sources.tables import Database, kept, shared_path

REPORT_KEYS = ("fullname", "mobile", "request_type", "message")
MOBILE = r"^09[0-9]{9}$"
STORED_NAME = r"(?i)^[0-9a-f]{32}\.pdf$"
MAX_FILE_BYTES = 5 << 20


def unpivot_values(rows: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """submission_id, key, value: a row per named column, values trimmed and blank ones null."""
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("string") for c in names.values()]))).alias("key", "value")
    long = rows.select(F.col(key).alias("submission_id"), pairs)
    return long.select("submission_id", "key", F.trim(fields.non_blank(F.col("value"))).alias("value"))


def pivot_latest(headers: DataFrame, values: DataFrame, take: int = 50, form: str | None = None, file_key: str = "resume_file") -> DataFrame:
    """The newest submissions with their values as columns; ``take`` from 1 to 100. Headers without values stay."""
    rows = headers if form is None else headers.where(F.col("form_name") == form)
    # The newest headers first, so that only their values are joined.
    newest = rows.orderBy(F.desc("id")).limit(max(1, min(take, 100)))
    joined = newest.select("id", "created_at").join(values.withColumnRenamed("submission_id", "id"), "id", "left")
    picked = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in REPORT_KEYS]
    has_file = F.max(F.when((F.col("key") == file_key) & F.col("value").isNotNull(), 1).otherwise(0)).alias("has_file")
    wide = joined.groupBy("id", "created_at").agg(*picked, has_file)
    return wide.select("id", "created_at", *[F.coalesce(k, F.lit("")).alias(k) for k in REPORT_KEYS[:3]], "message", (F.col("has_file") == 1).alias("has_file"))


def pivot_latest_of(db: Database, headers: str, values: str, take: int = 50, form: str | None = None, key: str = "key") -> DataFrame:
    """pivot_latest over tables of a database, which gives the newest headers and only the values of those; ``key`` names the values' key column."""
    take = max(1, min(take, 100))
    newest = db.newest(headers, ("id", "created_at", "form_name"), "id", take, {"form_name": form} if form else None).toDF("id", "created_at", "form_name")
    ids = [r.id for r in newest.select("id").collect()]  # 100 at most
    own = db.table(values).where(F.col("submission_id").isin(ids))
    return pivot_latest(newest, own.select(F.col("submission_id"), F.col(key).alias("key"), "value"), take)


def look_up(headers: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """id, value of one key; of several rows the smallest value."""
    named = values.where((F.col("key") == key) & F.col("value").isNotNull()).groupBy("submission_id").agg(F.min("value").alias("value"))
    return headers.select("id").join(named.withColumnRenamed("submission_id", "id"), "id")


def form_errors(name: Column, mobile: Column, kind: Column, message: Column, form: Column) -> Column:
    """Names of the fields that fail, in order."""
    short = F.length(F.trim(F.coalesce(name, F.lit(""))))
    checks = [
        ("fullname", (short < 2) | (short > 100)),
        ("mobile", ~F.coalesce(mobile, F.lit("")).rlike(MOBILE)),
        ("request_type", (F.length(F.trim(F.coalesce(kind, F.lit("")))) == 0) | (F.length(kind) > 60)),
        ("message", F.coalesce(F.length(message) > 2000, F.lit(False))),
        ("form", (F.length(F.trim(F.coalesce(form, F.lit("")))) == 0) | (F.length(form) > 80)),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(field)) for field, bad in checks]))


def file_rule(form: Column, has_file: Column) -> Column:
    """Unknown forms, in any case, fail; the job form needs a file, others must not have one."""
    low = F.lower(F.trim(form))
    wrong = F.when(low == fields.JOB_FORM, ~has_file).otherwise(has_file)
    return F.when(~F.coalesce(low.isin(list(fields.FORMS)), F.lit(False)), "unknown_form").when(wrong, "file").otherwise("ok")


def pdf_ok(path: Column, content: Column) -> Column:
    """A PDF by name, size and first bytes."""
    size = F.length(content)
    return F.lower(path).endswith(".pdf") & (size > 0) & (size <= MAX_FILE_BYTES) & (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def not_trapped(hidden: Column) -> Column:
    """False for a filled hidden field."""
    return fields.non_blank(hidden).isNull()


def stored_name_ok(name: Column) -> Column:
    """A name that the library gave to a stored file: no folder, 32 hexadecimal digits, a PDF."""
    return F.coalesce(name.rlike(STORED_NAME), F.lit(False))


def form_definition(name: Column) -> Column:
    """The form's name and numbers as a struct."""
    row = lambda form: F.struct(F.lit(form).alias("form_name"), *[F.lit(v).alias(k) for k, v in zip(("main_meta_id", "post_id", "element_id", "edit_post_id"), fields.FORMS[form], strict=True)])
    known, out = fields.form_name(name), row(fields.DEFAULT_FORM)
    for form in fields.FORMS:
        out = F.when(known == form, row(form)).otherwise(out)
    return out


class SubmissionStore:
    """Headers and values of submissions under one path; a batch is there as a whole or not at all."""

    def __init__(self, spark, path: str) -> None:  # noqa: ANN001
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, *parts: str):  # noqa: ANN202
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, batch_id: int, headers: DataFrame, values: DataFrame) -> bool:
        """Both tables of a batch by one rename; False for a batch that is there already, as streams repeat them."""
        final, files = self._files(f"batch={batch_id}")
        if files.exists(final):
            return False
        # A folder of one's own, so that two writers of a batch don't get in each other's way; a failed try leaves one that nobody reads.
        staged, _ = self._files(f"_staged-{batch_id}-{uuid.uuid4().hex}")
        headers.write.parquet(f"{staged}/headers")
        values.write.parquet(f"{staged}/values")
        if not files.rename(staged, final):
            files.delete(staged, True)
            return False
        return True

    def read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/batch=*/{table}")


def with_ids(rows: DataFrame, last_id: int, *order: str, name: str = "id") -> DataFrame:
    """New ids behind the last, in order of the columns, by a sort over ranges and counts per part.

    The placed rows are kept once: a range exchange that is computed twice samples, and so cuts, anew each time.
    """
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("quern_at", at)
    placed = placed.withColumn("quern_part", F.shiftright("quern_at", 33)).withColumn("quern_at", F.col("quern_at").bitwiseAND((1 << 33) - 1))
    placed = kept(placed, shared_path(rows.sparkSession, "numbered"))
    # A row per part.
    before = Window.orderBy("quern_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("quern_part").agg(F.count("*").alias("quern_n")).select("quern_part", F.coalesce(F.sum("quern_n").over(before), F.lit(0)).alias("quern_start"))
    numbered = placed.join(F.broadcast(starts), "quern_part").withColumn(name, F.col("quern_start") + F.col("quern_at") + last_id + 1)
    return numbered.drop("quern_part", "quern_at", "quern_start")


def seed_missing(existing: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Rows whose name, whatever its case, does not exist yet."""
    known = existing.select(F.lower(name).alias("_low")).distinct()
    return rows.withColumn("_low", F.lower(name)).join(known, "_low", "left_anti").drop("_low")
