"""Decisions on rankings: thresholds, ambiguity, intents, discriminating terms, exact matches and routing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fields, text
from quern.operators import corpus, fusion, ranking
from quern.sources.tables import kept, shared_path

MIN_SCORE, MIN_MARGIN, NO_MATCH_BELOW, MAX_SUGGESTIONS = 0.88, 0.05, 0.875, 3


def semantic_decision(best: DataFrame, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN, questions: DataFrame | None = None) -> DataFrame:
    """best (a row per question) with ``decision``; questions without a row in it have no match."""
    best = best if questions is None else questions.select("question_id").distinct().join(best, "question_id", "left")
    low = F.col("score").isNull() | (F.round("score", 9) < min_score)
    near = F.col("margin").isNotNull() & (F.round("margin", 9) < min_margin)
    return best.withColumn("decision", F.when(low, "NoMatch").when(near, "Ambiguous").otherwise("Confident"))


def no_match_gate(evidence: DataFrame, below: float = NO_MATCH_BELOW) -> DataFrame:
    """Per question the best semantic score (0 without one) and whether it is in the domain; the bound itself is."""
    best = evidence.groupBy("question_id").agg(F.coalesce(F.max("semantic_score"), F.lit(0.0)).alias("best_score"))
    return best.withColumn("decision", F.when(F.round("best_score", 9) < below, "NoMatch").otherwise("InDomain"))


def ambiguity(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Winners and margins of four rankings, how many agree and how many found anything; only where the semantic one did."""
    tops = {name: ranking.with_runner_up(df) for name, df in fusion.rankings(questions, candidates, 2).items()}
    tagged = reduce(DataFrame.unionByName, [df.select("question_id", F.lit(name).alias("by"), "item_id", "margin") for name, df in tops.items()])
    votes = tagged.groupBy("question_id", "item_id").agg(F.count("*").alias("votes"))
    agreement = votes.groupBy("question_id").agg(F.max("votes").cast("int").alias("agreement"))
    columns = [F.max(F.when(F.col("by") == name, F.col(c))).alias(f"{name}_{c}") for name in fusion.RANKERS for c in ("item_id", "margin")]
    wide = tagged.groupBy("question_id").agg(*columns, F.count("*").cast("int").alias("active"))
    return wide.where("semantic_item_id is not null").join(agreement, "question_id")


def intents(evidence: DataFrame) -> DataFrame:
    """Items that some ranking has first or second, with their support, in order of it."""
    ranks = [F.col(f"{name}_rank") for name in fusion.RANKERS]
    support = lambda test: reduce(lambda a, b: a + b, [F.coalesce(test(r).cast("int"), F.lit(0)) for r in ranks])
    rows = evidence.select("question_id", "item_id", "place", support(lambda r: r == 1).alias("top1"), support(lambda r: r <= 2).alias("top2"), "best_rank").where("top2 > 0")
    order = Window.partitionBy("question_id").orderBy(F.desc("top1"), F.desc("top2"), "best_rank", "place")
    return rows.withColumn("intent_place", F.row_number().over(order)).drop("place")


def intent_gap(found: DataFrame, questions: DataFrame) -> DataFrame:
    """Largest and second-largest support and their gap; zeros without intents."""
    supports = F.reverse(F.sort_array(F.collect_list("top1")))
    wide = found.groupBy("question_id").agg(supports.alias("s"), F.count("*").cast("int").alias("n_intents"))
    joined = ranking.asked(questions).select("question_id").join(wide, "question_id", "left")
    first, second = (F.coalesce(F.get("s", F.lit(k)), F.lit(0)) for k in (0, 1))
    return joined.select("question_id", F.coalesce("n_intents", F.lit(0)).alias("n_intents"), first.alias("max_support"), second.alias("second_support"), (first - second).alias("gap"))


def discriminative_terms(questions: DataFrame, evidence: DataFrame, candidates: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Per evidence item its terms that no other item of the question has, and those that the question names.

    Questions with the same evidence items share them, so terms are compared once for each set of items. lists are kept term
    lists of all phrasings of the items; terms are kept before they are exploded, as they would be made anew for each use of them.
    """
    lists = corpus.kept_once(corpus.term_lists(candidates), "terms") if lists is None else lists
    evidence = kept(evidence.select("question_id", "item_id"), shared_path(evidence.sparkSession, "evidence"))  # read several times
    # At most the evidence of one question in an array.
    sets = evidence.groupBy("question_id").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("set_id", F.sha2(F.to_json("items"), 256))
    own = lists.select("item_id", F.explode("terms").alias("term")).distinct()
    each = sets.select("set_id", "items").dropDuplicates(["set_id"]).select("set_id", F.explode("items").alias("item_id")).join(own, "item_id")
    unique = each.groupBy("set_id", "term").agg(F.count("*").alias("c"), F.min("item_id").alias("item_id")).where("c = 1").select("set_id", "term", "item_id")
    unique = kept(unique, shared_path(evidence.sparkSession, "unique"))
    counts = unique.groupBy("set_id", "item_id").agg(F.count("*").cast("int").alias("n_unique"))
    asked = corpus.kept_once(corpus.with_terms(ranking.asked(questions), "question").select("question_id", F.array_distinct("terms").alias("terms")), "asked")
    named = asked.select("question_id", F.explode("terms").alias("term")).join(sets.select("question_id", "set_id"), "question_id").join(unique, ["set_id", "term"])
    matched = named.groupBy("question_id", "item_id").agg(F.array_sort(F.collect_list("term")).alias("matched"))
    out = evidence.join(sets.select("question_id", "set_id"), "question_id").join(counts, ["set_id", "item_id"], "left").join(matched, ["question_id", "item_id"], "left")
    none = F.array().cast("array<string>")
    return out.select("question_id", "item_id", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), F.coalesce("matched", none).alias("matched"), F.size(F.coalesce("matched", none)).alias("n_matched"))


def exact_match(questions: DataFrame, candidates: DataFrame, kind: str) -> DataFrame:
    """question_id, item_id, pos of the first phrasing of the kind that reads the same after normalisation."""
    return exact_matches(questions, corpus.of_kind(candidates, kind).withColumn("kind", F.lit(kind))).select("question_id", "item_id", "pos")


def exact_matches(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """exact_match of each kind that has one. Texts are normalised once and kept as digests, so no text is shuffled."""
    read = lambda c: F.sha2(text.normalize(F.col(c)), 256).alias("read")
    known = corpus.kept_once(candidates.select("item_id", "pos", "kind", read("text")), "read")
    asks = corpus.kept_once(ranking.asked(questions).select("question_id", read("question")), "asked").where(F.col("read") != F.sha2(F.lit(""), 256))
    first = known.groupBy("read", "kind").agg(F.min_by("item_id", "pos").alias("item_id"), F.min("pos").alias("pos"))
    return asks.join(first, "read").select("question_id", "item_id", "pos", "kind")


def allow_all(pairs: DataFrame) -> Column:
    """The verifier without a model."""
    return F.lit(True)


def suggestions(evidence: DataFrame, items: DataFrame, verifier: Callable[[DataFrame], Column] = allow_all, most: int = MAX_SUGGESTIONS) -> DataFrame:
    """The first accepted Answer items in fused order, at most ``most`` per question."""
    known = items.where(F.col("kind") == corpus.ANSWER).select("item_id", "label")
    pairs = evidence.select("question_id", "item_id", "place").join(known, "item_id")
    accepted = pairs.where(verifier(pairs))
    order = Window.partitionBy("question_id").orderBy("place")
    return accepted.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def route(questions: DataFrame, candidates: DataFrame, items: DataFrame, below: float = NO_MATCH_BELOW, verifier: Callable[[DataFrame], Column] = allow_all) -> DataFrame:
    """response_type, reply item and suggestions of each question that is not blank.

    Exact answers come first, then exact clarifications; what is left goes to the fused evidence, and
    only questions in the domain reach the verifier.
    """
    asks = ranking.asked(questions)
    exact = corpus.kept_once(exact_matches(asks, candidates), "exact")
    answer = exact.where(F.col("kind") == corpus.ANSWER).select("question_id", F.col("item_id").alias("answer_item"))
    clarify = exact.where(F.col("kind") == corpus.CLARIFICATION).select("question_id", F.col("item_id").alias("clarify_item"))
    found = asks.join(answer, "question_id", "left").join(clarify, "question_id", "left")
    found = kept(found, shared_path(questions.sparkSession, "matched"))  # the questions of every ranking
    rest = found.where("answer_item is null and clarify_item is null").select(*questions.columns)
    fused = fusion.evidence(rest, candidates, MAX_SUGGESTIONS, corpus.ANSWER)
    fused = kept(fused, shared_path(questions.sparkSession, "evidence"))  # read twice
    inside = no_match_gate(fused, below).where("decision = 'InDomain'").select("question_id")
    offered = suggestions(fused.join(inside, "question_id", "left_semi"), items, verifier)
    lists = offered.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", "item_id"))).alias("s")).select("question_id", F.transform("s", lambda x: x["item_id"]).alias("suggested"))
    out = found.join(lists, "question_id", "left")
    kind = F.when(F.col("answer_item").isNotNull(), "Answer").when(F.col("clarify_item").isNotNull(), "Clarification").when(F.col("suggested").isNotNull(), "Suggestions").otherwise("Fallback")
    return out.select("question_id", kind.alias("response_type"), F.coalesce("answer_item", "clarify_item").alias("reply_item"), F.coalesce("suggested", F.array().cast("array<string>")).alias("suggestions"))


def select_suggestion(chosen: DataFrame, items: DataFrame) -> DataFrame:
    """Chosen ids that exist and are answers."""
    return chosen.join(items.where(F.col("kind") == corpus.ANSWER), "item_id")


def above(score: Column, threshold: float) -> Column:
    """A verifier of scored pairs: the threshold itself passes, no score doesn't."""
    return F.coalesce(score >= threshold, F.lit(False))


def pools(questions: DataFrame, candidates: DataFrame, limit: int = 4) -> DataFrame:
    """The fused evidence among answers and among clarifications, as ``pool``."""
    parts = [fusion.evidence(questions, candidates, limit, kind).withColumn("pool", F.lit(kind)) for kind in (corpus.ANSWER, corpus.CLARIFICATION)]
    return parts[0].unionByName(parts[1])


def answer_or_clarification(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per question the reranked best answer and the best clarification; null where there is none. Texts are read once, for blanks."""
    questions = corpus.kept_once(ranking.asked(questions).select("question_id", "question", "embedding"), "asked")
    candidates = corpus.kept_once(candidates.select("item_id", "pos", "kind", "embedding"), "vectors")
    out = questions.select("question_id")
    for kind in (corpus.ANSWER, corpus.CLARIFICATION):
        best = fusion.rerank(questions, candidates, kind)
        out = out.join(best.select("question_id", F.col("item_id").alias(f"{kind.lower()}_item_id"), F.col("strategy").alias(f"{kind.lower()}_strategy")), "question_id", "left")
    return out


def projected(evidence: DataFrame, limit: int) -> DataFrame:
    """The first 1 to 10 rows per question: position, item, ranks and scores."""
    if not 1 <= limit <= 10:
        raise ValueError("the limit is from 1 to 10")
    columns = [c for name in fusion.RANKERS for c in (f"{name}_rank", f"{name}_score")]
    return evidence.where(F.col("place") <= limit).select("question_id", F.col("place").alias("position"), "item_id", *columns, "rrf")


def verifier_text(*parts: Column) -> Column:
    return fields.joined_parts(*parts)
