"""Quality rules: a threshold table compiled into one projection of Spark's own functions.

Defined results: a null or empty text has no words, all counts are 0 and it is rejected (under
``min_words``); rows are judged one by one, so ties, repeated rows and an empty table need no
special case; other columns of the input are not read and not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import with_text

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages in scope.
STOP_WORDS = (
    "the of and to in is it that this for with was are be by on as from he at an a not "
    "le la les de du des et en un une que qui dans pour par sur au pas est avec elle il ou "
    "der die das und zu den mit von ist im dem nicht auch auf für ein eine als sich "
    "el los las y se del con su no lo como por para al es"
).split()


@dataclass(frozen=True)
class Rule:
    """A bound on numerator / denominator, checked without division: low * d <= n and n <= high * d."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None

    def fails(self, columns: dict[str, Column]) -> Column:
        value = columns[self.numerator].cast("double")
        unit = columns[self.denominator].cast("double") if self.denominator else F.lit(1.0)
        low = value < F.lit(float(self.low)) * unit if self.low is not None else F.lit(False)
        high = value > F.lit(float(self.high)) * unit if self.high is not None else F.lit(False)
        return low | high


BASE_RULES = (
    Rule("min_words", "n_words", low=50),
    Rule("repeat_words", "n_repeat_words", "n_words", high=0.5),
)

#: Thresholds on top of the base: lengths, symbols, stop words and lines.
METHOD_RULES = (
    Rule("max_words", "n_words", high=1_000_000),
    Rule("mean_word_chars", "word_chars", "n_words", low=2, high=15),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=0.5),
)


def _windows(words: Column) -> Column:
    """Hashes of the 3-word windows."""
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    )


def _placed(hashes: Column) -> Column:
    """Windows with their places, equal ones side by side; null, and so no sort, if none occurs twice."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed)


def _covered(placed: Column) -> Column:
    """Words inside windows that stand beside an equal one."""
    near = F.transform(
        placed,
        lambda p, k: F.when(
            (F.get(placed, k - 1)["h"] == p["h"]) | (F.get(placed, k + 1)["h"] == p["h"]), p["i"]
        ),
    )
    words = F.flatten(F.transform(F.array_compact(near), lambda i: F.array(i, i + 1, i + 2)))
    return F.size(F.array_distinct(words)).cast("long")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """Per row the counts that rules can name: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    body = F.coalesce(F.col("text"), F.lit(""))
    stops = list(dict.fromkeys(stop_words or STOP_WORDS))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    found = with_text(docs, key, text).select(
        "doc_id",
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    words = F.col("words")
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    hashed = found.select(
        "doc_id", "word_chars", "n_symbols",
        F.size(words).cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        F.when(F.size(words) >= 4, _windows(words)).alias("windows"),
    )
    # One projection a step: a lambda that named an expression instead of a column would compute it for each element.
    placed = hashed.select(*counts, _placed(F.col("windows")).alias("placed"))
    none = F.lit(0).cast("long")
    repeats = F.when(F.col("placed").isNotNull(), _covered(F.col("placed"))).otherwise(none)
    return placed.select(*counts[:-1], repeats.alias("n_repeat_words"), counts[-1])


def apply_rules(measured: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """base_failed, kept, and the names of all failed rules."""
    columns = {c: F.col(c) for c in measured.columns}
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | rule.fails(columns)
    reasons = F.array_compact(F.array(*[F.when(r.fails(columns), F.lit(r.name)) for r in (*base, *rules)]))
    judged = measured.withColumn("base_failed", base_failed).withColumn("failed_rules", reasons)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict per row of docs."""
    return apply_rules(measures(docs, key, text))
