"""Fusion of rankings and the choice between two of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scores
from quern.operators import corpus, ranking

RANKERS = ("semantic", "centroid", "lexical", "bm25")
LEAST_DEPTH = 10


def rankings(questions: DataFrame, candidates: DataFrame, k: int, kind: str | None = None, lists: DataFrame | None = None) -> dict[str, DataFrame]:
    """By name; lists are kept word lists of the candidates of the kind."""
    asks, vectors = _read_once(questions, candidates, kind)
    lists = corpus.kept_once(corpus.word_lists(corpus.of_kind(candidates, kind)), "words") if lists is None else lists
    return {
        "semantic": ranking.semantic_top(asks, vectors, k),
        "centroid": ranking.centroid_top(asks, vectors, k),
        "lexical": ranking.weighted_lexical_top(asks, vectors, k, lists=lists),
        "bm25": ranking.bm25_top(asks, vectors, k, lists=lists),
    }


def _read_once(questions: DataFrame, candidates: DataFrame, kind: str | None) -> tuple[DataFrame, DataFrame]:
    """The questions that are not blank and the vectors of the candidates of a kind, kept, as several rankings read them."""
    asks = corpus.kept_once(ranking.asked(questions).select("question_id", "question", "embedding"), "asked")
    return asks, corpus.kept_once(corpus.of_kind(candidates, kind).select("item_id", "pos", "embedding"), "vectors")


def fuse(ranked: dict[str, DataFrame]) -> DataFrame:
    """All items of any ranking with their ranks and scores, and place in fused order.

    One aggregate over the tagged union is the full outer join of the rankings. Order: fused score,
    number of rankings, best rank, item id.
    """
    tagged = reduce(DataFrame.unionByName, [df.select("question_id", "item_id", F.lit(name).alias("by"), "rank", "score") for name, df in ranked.items()])
    columns = [F.max(F.when(F.col("by") == name, F.col(c))).alias(f"{name}_{c}") for name in RANKERS for c in ("rank", "score")]
    wide = tagged.groupBy("question_id", "item_id").agg(*columns, F.count("*").cast("int").alias("strategies"), F.min("rank").alias("best_rank"))
    fused = reduce(lambda a, b: a + b, [scores.rrf(F.col(f"{name}_rank")) for name in RANKERS])
    wide = wide.withColumn("rrf", fused)
    order = Window.partitionBy("question_id").orderBy(F.round("rrf", 12).desc(), F.desc("strategies"), "best_rank", "item_id")
    return wide.withColumn("place", F.row_number().over(order))


def evidence(questions: DataFrame, candidates: DataFrame, limit: int = 4, kind: str | None = None, lists: DataFrame | None = None) -> DataFrame:
    """Fused evidence; the limit sets how deep each ranking goes (10 at least), not how many rows come."""
    return fuse(rankings(questions, candidates, max(limit, LEAST_DEPTH), kind, lists))


def rerank(questions: DataFrame, candidates: DataFrame, kind: str | None = None) -> DataFrame:
    """The semantic or the centroid winner, by agreement or the larger margin; a margin without runner-up is 1."""
    asks, vectors = _read_once(questions, candidates, kind)
    near = ranking.with_runner_up(ranking.semantic_top(asks, vectors, 2), F.lit(1.0))
    mean = ranking.with_runner_up(ranking.centroid_top(asks, vectors, 2), F.lit(1.0))
    named = lambda df, tag: df.select("question_id", *[F.col(c).alias(f"{tag}_{c}") for c in ("item_id", "score", "margin")])
    both = named(near, "semantic").join(named(mean, "centroid"), "question_id")
    agree = F.col("semantic_item_id") == F.col("centroid_item_id")
    strategy = F.when(agree, "Agreement").when(F.round("semantic_margin", 9) >= F.round("centroid_margin", 9), "Semantic").otherwise("Centroid")
    both = both.withColumn("strategy", strategy)
    return both.withColumn("item_id", F.when(F.col("strategy") == "Centroid", F.col("centroid_item_id")).otherwise(F.col("semantic_item_id")))
