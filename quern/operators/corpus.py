"""Phrasings, postings and corpus statistics.

Candidates are (item_id string, pos long, text, answer, kind, embedding): one row per phrasing of an
item. ``pos`` is the order of the index, which decides ties. Questions are (question_id, question,
embedding).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scores, text
from quern.sources.tables import kept, shared_path

ANSWER, CLARIFICATION = "Answer", "Clarification"


def clean_items(items: DataFrame) -> DataFrame:
    """Trimmed items without blank questions or answers; alternatives trimmed, not blank, each once; kinds parsed."""
    alternatives = F.array_distinct(F.transform(F.filter("alternative_questions", lambda a: F.length(F.trim(a)) > 0), lambda a: F.trim(a)))
    kind = F.when(F.lower(F.trim("kind")) == "clarification", CLARIFICATION).otherwise(ANSWER)
    out = items.select("id", F.trim("question").alias("question"), F.trim("answer").alias("answer"), F.coalesce(alternatives, F.array().cast("array<string>")).alias("alternative_questions"), kind.alias("kind"))
    return out.where((F.length("question") > 0) & (F.length("answer") > 0))


def expand_candidates(items: DataFrame) -> DataFrame:
    """item_id, place, text, answer, kind: the question and its alternatives, trimmed, each once, blanks dropped."""
    texts = F.array_distinct(F.filter(F.transform(F.concat(F.array("question"), F.coalesce("alternative_questions", F.array().cast("array<string>"))), lambda t: F.trim(t)), lambda t: F.length(t) > 0))
    return items.select(F.col("id").alias("item_id"), F.posexplode(texts).alias("place", "text"), "answer", "kind")


def expand_messages(rows: DataFrame, item: str, turn: str, body: str) -> DataFrame:
    """item_id, place, text: the texts of each item by turn, trimmed, each once, blanks dropped; a row per text all the way."""
    said = rows.select(F.col(item).cast("string").alias("item_id"), F.trim(body).alias("text"), F.struct(F.col(turn).alias("turn"), F.col(body).alias("body")).alias("at"))
    each = said.where(F.length("text") > 0).groupBy("item_id", "text").agg(F.min("at").alias("at")).select("item_id", "text", "at.turn", "at.body")
    ordered = each.repartitionByRange("item_id", "turn").sortWithinPartitions("item_id", "turn", "body")
    low = F.monotonically_increasing_id()
    placed = ordered.select("item_id", "text", F.shiftright(low, 33).alias("part"), low.bitwiseAND((1 << 33) - 1).alias("offset"))
    placed = kept(placed, shared_path(rows.sparkSession, "messages"))
    # A row per item and part; items that span parts add up the counts before.
    sizes = placed.groupBy("item_id", "part").agg(F.count("*").alias("n"), F.min("offset").alias("first"))
    earlier = Window.partitionBy("item_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("item_id").alias("item"), F.col("part").alias("of"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("start"))
    joined = placed.join(starts, F.col("item_id").eqNullSafe(F.col("item")) & (F.col("part") == F.col("of")))
    return joined.select("item_id", (F.col("start") + F.col("offset")).cast("int").alias("place"), "text")


def of_kind(candidates: DataFrame, kind: str | None) -> DataFrame:
    """Phrasings of one kind; to be applied before statistics, as these depend on it."""
    return candidates if kind is None else candidates.where(F.col("kind") == kind)


def with_terms(rows: DataFrame, column: str) -> DataFrame:
    """rows and ``terms``: words without stop words, repeats kept."""
    return rows.withColumn("terms", text.without_stop_words(text.tokens(text.normalize(F.col(column)))))


def with_grams(rows: DataFrame, column: str) -> DataFrame:
    """rows and ``grams``: the set of character trigrams."""
    return rows.withColumn("grams", text.trigrams(text.normalize(F.col(column))))


def term_lists(candidates: DataFrame) -> DataFrame:
    """item_id, pos, terms."""
    return with_terms(candidates.select("item_id", "pos", "text"), "text").select("item_id", "pos", "terms")


def gram_lists(candidates: DataFrame) -> DataFrame:
    """item_id, pos, grams."""
    return with_grams(candidates.select("item_id", "pos", "text"), "text").select("item_id", "pos", "grams")


def word_lists(candidates: DataFrame) -> DataFrame:
    """item_id, pos, terms, grams, with each text normalised once for both."""
    normal = candidates.select("item_id", "pos", text.normalize(F.col("text")).alias("normal"))
    return normal.select("item_id", "pos", text.without_stop_words(text.tokens(F.col("normal"))).alias("terms"), text.trigrams(F.col("normal")).alias("grams"))


def kept_once(rows: DataFrame, label: str) -> DataFrame:
    """rows from a table in the shared folder, for what is read several times."""
    return kept(rows, shared_path(rows.sparkSession, label))


def postings(candidates: DataFrame) -> DataFrame:
    """item_id, pos, term, tf, doc_len."""
    return postings_of(term_lists(candidates))


def postings_of(lists: DataFrame) -> DataFrame:
    each = lists.select("item_id", "pos", F.size("terms").alias("doc_len"), F.explode("terms").alias("term"))
    return each.groupBy("item_id", "pos", "term", "doc_len").agg(F.count("*").alias("tf"))


def bm25_corpus(candidates: DataFrame) -> DataFrame:
    """One row: n phrasings and their mean length in terms."""
    return corpus_of(term_lists(candidates))


def corpus_of(lists: DataFrame) -> DataFrame:
    sized = lists.select(F.size("terms").alias("doc_len"))
    return sized.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"))


def bm25_df(posted: DataFrame) -> DataFrame:
    """term, df over phrasings."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def gram_rows(candidates: DataFrame) -> DataFrame:
    """item_id, pos, gram."""
    return gram_lists(candidates).select("item_id", "pos", F.explode("grams").alias("gram"))


def gram_idf(candidates: DataFrame) -> DataFrame:
    """gram, df, idf, and the same unseen_idf in each row."""
    return idf_of(gram_lists(candidates))


def idf_of(lists: DataFrame) -> DataFrame:
    n = lists.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    df = lists.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).withColumn("one", F.lit(1))
    joined = df.join(F.broadcast(n), "one")  # one row
    return joined.select("gram", "df", scores.smoothed_idf(F.col("n"), F.col("df")).alias("idf"), scores.smoothed_idf(F.col("n"), F.lit(0)).alias("unseen_idf"))
