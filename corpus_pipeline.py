"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of ``documents``, and others that it may have. Texts of any length are read whole,
and empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, cnn
from quern.llm.common import Scratch, documents, prefiltered, without_ids
from quern.llm.decontam import find_leaks
from quern.llm.jaccard import Threshold, jaccard_components
from quern.llm.pii import pseudonymise, session_key

#: Near duplicates on word shingles: five words, similarity 0.8.
NEAR = Threshold(size=5, percent=80)
#: Pieces that a worker of the last stage keeps in memory, beside what it holds of the stages before.
MEMORY_PIECES = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, each judged by its own text; a null or empty one like one without bytes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cnn.keep_quality(docs, cnn.fit_from_labels(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Documents without words and rows with a null doc_id are in no group and stay; of rows with one doc_id one stays.
    """
    scratch = Scratch(spark, "near")
    found = jaccard_components(docs, NEAR)
    copies = scratch.keep(found.where("doc_id <> component_id").select("doc_id").distinct())
    again = scratch.keep(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    scratch.drop(found)
    left = without_ids(docs, copies)
    if again.isEmpty():
        return left
    maybe, once = prefiltered(left, again)
    keyed = maybe.where("doc_id is not null").dropDuplicates(["doc_id"])
    return once.unionByName(keyed).unionByName(maybe.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those without text or doc_id stay."""
    scratch = Scratch(spark, "leaks")
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(docs, scratch.keep(leaks.select("doc_id").distinct()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; n_chars follows the text, null for a null one."""
    counts = "pii_counts"
    while counts in docs.columns:
        counts += "_"
    done = pseudonymise(docs, session_key(spark), counts=counts)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row, also repeated ones and those with a null doc_id, its ids by byte-level BPE and the digests of ids and of the bytes they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.round_trip(docs, path, pattern, memory_pieces=MEMORY_PIECES)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", token_ids),
]

#: A fitted network is beyond SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage kept is removed when the next one has written its own."""
    scratch = Scratch(spark, "pipeline")
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
