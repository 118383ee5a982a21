from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import corpus, decide, fusion
from quern.plans import catalogue
from tests.test_ranking import ask, candidates

RANKED = "question_id long, rank int, item_id string, pos long, score double"


def ranked(spark, *items):
    return spark.createDataFrame([(1, r, i, 0, 1.0 / r) for i, r in items], RANKED)


def test_fusion_three_middle_ranks_beat_one_first(spark):
    found = fusion.fuse({
        "semantic": ranked(spark, ("A", 1)), "centroid": ranked(spark, ("B", 2)), "lexical": ranked(spark, ("B", 3)), "bm25": ranked(spark, ("B", 2)),
    }).orderBy("place").collect()
    assert [(r.item_id, round(r.rrf, 9), r.strategies) for r in found] == [("B", 0.04813108, 3), ("A", 0.016393443, 1)]


def evidence(spark, *rows):
    schema = "question_id long, item_id string, place int, best_rank int, semantic_rank int, centroid_rank int, lexical_rank int, bm25_rank int, semantic_score double"
    return spark.createDataFrame([(1, i, p, min(x for x in r if x), *r, 0.5) for p, (i, r) in enumerate(rows, 1)], schema)


def test_intents(spark):
    rows = evidence(spark, ("A", (1, 1, 2, 1)), ("B", (2, 2, 1, 3)), ("C", (3, 4, 3, 4)))
    found = decide.intents(rows).orderBy("intent_place").collect()
    assert [(r.item_id, r.top1, r.top2, r.best_rank) for r in found] == [("A", 3, 4, 1), ("B", 1, 3, 1)]
    gap = decide.intent_gap(decide.intents(rows), ask(spark, "q")).first()
    assert (gap.max_support, gap.second_support, gap.gap) == (3, 1, 2)
    none = decide.intent_gap(decide.intents(rows.limit(0)), ask(spark, "q")).first()
    assert tuple(none)[1:] == (0, 0, 0, 0)


def test_semantic_decision(spark):
    best = spark.createDataFrame([(0, None, None), (1, 0.80, 0.10), (2, 0.92, 0.02), (3, 0.95, 0.10), (4, 0.95, None), (5, 0.88, 0.05)], "question_id long, score double, margin double")
    found = {r.question_id: r.decision for r in decide.semantic_decision(best).collect()}
    assert found == {0: "NoMatch", 1: "NoMatch", 2: "Ambiguous", 3: "Confident", 4: "Confident", 5: "Confident"}


def test_no_match_gate_includes_its_bound(spark):
    rows = spark.createDataFrame([(1, 0.8749), (2, 0.875), (3, None), (4, 0.9)], "question_id long, semantic_score double")
    assert {r.question_id: r.decision for r in decide.no_match_gate(rows).collect()} == {1: "NoMatch", 2: "InDomain", 3: "NoMatch", 4: "InDomain"}


def test_rerank_strategies(spark):
    some = candidates(spark, ("A", 0, "x", "Answer", [1.0, 0.0]), ("B", 1, "y", "Answer", [0.0, 1.0]))
    assert fusion.rerank(ask(spark, "q", [1.0, 0.1]), some).first().strategy == "Agreement"
    split = candidates(spark, ("A", 0, "x", "Answer", [1.0, 0.0]), ("A", 1, "x", "Answer", [-0.2, 1.0]), ("B", 2, "y", "Answer", [0.9, 0.3]))
    found = fusion.rerank(ask(spark, "q", [1.0, 0.0]), split).first()
    assert (found.semantic_item_id, found.centroid_item_id, found.strategy, found.item_id) == ("A", "B", "Centroid", "B")
    assert fusion.rerank(ask(spark, " ", [1.0, 0.0]), split).count() == 0


def knowledge(spark):
    return candidates(
        spark, ("A", 0, "reset password", "Answer", [1.0, 0.0]), ("B", 1, "delete account", "Answer", [0.9, 0.4]), ("C", 2, "which account", "Clarification", [0.0, 1.0]),
        ("D", 3, "change name", "Answer", [0.8, 0.6]), ("E", 4, "change mail", "Answer", [0.7, 0.7]),
    )


def routed(spark, question, vector, **options):
    rows = knowledge(spark)
    items = rows.select("item_id", "kind", F.col("text").alias("label"))
    return decide.route(ask(spark, question, vector), rows, items, **options).first()


def test_routing(spark):
    assert tuple(routed(spark, "Reset  PASSWORD!", [0.0, 1.0]))[1:3] == ("Answer", "A")
    assert tuple(routed(spark, "which account?", [1.0, 0.0]))[1:3] == ("Clarification", "C")
    found = routed(spark, "something else", [1.0, 0.0])
    assert found.response_type == "Suggestions" and len(found.suggestions) == 3 and "C" not in found.suggestions
    assert routed(spark, "something else", [-1.0, 0.0]).response_type == "Fallback"
    assert routed(spark, "something else", [1.0, 0.0], verifier=lambda pairs: F.lit(False)).response_type == "Fallback"


def test_exact_match_keeps_kinds_apart(spark):
    rows = knowledge(spark)
    assert decide.exact_match(ask(spark, "which account"), rows, corpus.ANSWER).count() == 0
    assert decide.exact_match(ask(spark, "which account"), rows, corpus.CLARIFICATION).first().item_id == "C"


def test_ambiguity(spark):
    found = decide.ambiguity(ask(spark, "reset password", [1.0, 0.0]), knowledge(spark)).first()
    assert (found.agreement, found.active, found.semantic_item_id) == (4, 4, "A")
    quiet = decide.ambiguity(ask(spark, "qqq", [1.0, 0.0]), knowledge(spark)).first()
    assert (quiet.active, quiet.bm25_item_id) == (2, None)


def test_discriminative_terms(spark):
    rows = knowledge(spark)
    fused = fusion.evidence(ask(spark, "delete my account", [1.0, 0.0]), rows, kind="Answer")
    found = {r.item_id: (r.matched, r.n_matched) for r in decide.discriminative_terms(ask(spark, "delete my account"), fused, rows).collect()}
    assert found["B"] == (["account", "delete"], 2) and found["D"] == ([], 0)


def test_limit_does_not_cut_fused_rows(spark):
    assert fusion.evidence(ask(spark, "account", [1.0, 0.0]), knowledge(spark), limit=1).count() == 5


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_not_normalised_anew_by_what_reads_their_terms(spark):
    rows, asks = knowledge(spark), ask(spark, "delete my account", [1.0, 0.0])
    fused = fusion.evidence(asks, rows, kind="Answer")
    assert "translate(" not in plan(decide.discriminative_terms(asks, fused, rows))
    assert "translate(" not in plan(decide.exact_match(asks, rows, corpus.ANSWER))


def test_terms_may_come_with_the_rankings_lists(spark):
    rows, asks = knowledge(spark), ask(spark, "delete my account", [1.0, 0.0])
    lists = corpus.kept_once(corpus.word_lists(corpus.of_kind(rows, "Answer")), "words")
    shared = decide.discriminative_terms(asks, fusion.evidence(asks, rows, 4, "Answer", lists), rows, lists)
    alone = decide.discriminative_terms(asks, fusion.evidence(asks, rows, 4, "Answer"), rows)
    assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, alone.collect()))


def test_mixed_rows_are_joined_once(spark):
    asks, rows = catalogue.mixed(spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(asks) and "Join" not in plan(rows)


def test_questions_of_both_kinds_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    asks = ask(spark, "reset password", [1.0, 0.0])
    found = decide.answer_or_clarification(asks.mapInArrow(count, asks.schema), knowledge(spark)).first()
    assert (found.answer_item_id, found.clarification_item_id) == ("A", "C") and made.value == 1
