"""The queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, cnn, simple8b, sql
from quern.llm.chat import format_chats
from quern.llm.common import Scratch, documents
from quern.llm.decontam import find_leaks
from quern.llm.jaccard import jaccard_components
from quern.llm.lexical import lexical_topk
from quern.llm.licenses import scan_licenses
from quern.llm.packing import pack_sequences
from quern.llm.pii import pseudonymise, session_key
from quern.llm.quality import quality_rules
from quern.llm.repeats import remove_repeats
from quern.llm.spelling import spelling_variants, word_counts


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text with pseudonyms, and the number of values by kind."""
    counts = F.col("pii_counts")
    total = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, b: a + b)
    kinds = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws(":", e["key"], e["value"]))
    done = pseudonymise(documents(spark, sf_dir, "doc_id", "text"), session_key(spark))
    return done.select("doc_id", "text", total.alias("n_values"), F.array_join(kinds, ",").alias("kinds"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.concat_ws(",", "failed_rules").alias("failed_rules"),
    )


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op4_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark, "ids").path("blocks")
    simple8b.write_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), out, end_id=2)
    read = simple8b.read_digests(spark, out)
    return read.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.round_trip(documents(spark, sf_dir), path, pattern)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.drop("hamming")


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(documents(spark, sf_dir))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", length.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = cnn.score_quality(docs, cnn.fit_from_labels(docs, labels))
    return scored.select("doc_id", cnn.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_topk(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(documents(spark, sf_dir), noise=199))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_pseudonyms": op1_pii_pseudonyms,
        "op2_quality_rules": op2_quality_rules,
        "op3_license_scans": op3_license_scans,
        "op4_simple8b_ids": op4_simple8b_ids,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_decontamination": op6_decontamination,
        "op7_suffix_repeats": op7_suffix_repeats,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_chat_quotations": op9_chat_quotations,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_packing": op11_packing,
        "op12_lexical_search": op12_lexical_search,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": sql.OP2,
        "op3_license_scans": sql.OP3,
        "op6_decontamination": sql.OP6,
        "op7_suffix_repeats": sql.OP7,
        "op9_chat_quotations": sql.OP9,
        "op10_jaccard_join": sql.OP10,
        "op12_lexical_search": sql.OP12,
        "op13_spelling_variants": sql.OP13,
    }
