from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import scores
from quern.operators import blocks, cells, corpus, ranking
from quern.plans import catalogue

SCHEMA = "item_id string, pos long, text string, answer string, kind string, embedding array<float>"


def candidates(spark, *rows):
    filled = [(i, p, t, f"answer {i}", k, v) for i, p, t, k, v in rows]
    return spark.createDataFrame(filled, SCHEMA)


def ask(spark, question, vector=None):
    return spark.createDataFrame([(1, question, vector)], "question_id long, question string, embedding array<float>")


def rows(df):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.orderBy("question_id").collect()]


def test_bm25_statistics(spark):
    some = candidates(spark, ("A", 0, "حساب قفل قفل", "Answer", None), ("B", 1, "حساب ورود", "Answer", None))
    assert tuple(corpus.bm25_corpus(some).first()) == (2, 2.5)
    assert dict(corpus.bm25_df(corpus.postings(some)).collect()) == {"حساب": 2, "قفل": 1, "ورود": 1}


def test_bm25_ranking(spark):
    some = candidates(
        spark, ("A", 0, "حساب کاربری من قفل شده است", "Answer", None), ("A", 1, "اکانتم قفل شده", "Answer", None),
        ("B", 2, "نمی‌توانم وارد حساب شوم", "Answer", None), ("B", 3, "ورود به حساب انجام نمی‌شود", "Answer", None),
    )
    assert rows(ranking.bm25_top(ask(spark, "حسابم قفل شده"), some, 3)) == [(1, 1, "A", 1, 1.605183)]


def test_kind_filter_changes_statistics(spark):
    some = candidates(spark, ("A", 0, "alpha beta", "Answer", None), ("B", 1, "alpha alpha alpha", "Clarification", None))
    every = rows(ranking.bm25_top(ask(spark, "alpha"), some, 5))
    answers = rows(ranking.bm25_top(ask(spark, "alpha"), some, 5, "Answer"))
    assert [r[2] for r in every] == ["B", "A"] and [r[2] for r in answers] == ["A"]
    assert answers[0][4] != next(r[4] for r in every if r[2] == "A")


def test_gram_idf(spark):
    some = candidates(spark, *[(i, k, t, "Answer", None) for k, (i, t) in enumerate([("A", "abc xyz"), ("B", "abc def"), ("C", "abc ghi")])])
    found = {r.gram: (round(r.idf, 6), round(r.unseen_idf, 6)) for r in corpus.gram_idf(some).collect()}
    assert found["abc"] == (1.0, 2.386294) and found["xyz"] == (1.693147, 2.386294)
    assert corpus.gram_idf(some.limit(0)).count() == 0
    weighted = ranking.weighted_dice_scores(ask(spark, "abc zzz"), some.where("item_id = 'A'"), some)
    assert rows(weighted.select("question_id", "score")) == [(1, 0.328978)]


@pytest.mark.parametrize(("a", "b", "expected"), [("تغییر رمز عبور", "تغییر رمز عبور", 1.0), ("شماره موبایلم", "شماره موبایل", 0.933333), ("night nacht", "night", 0.666667)])
def test_dice(spark, a, b, expected):
    some = candidates(spark, ("A", 0, b, "Answer", None))
    assert rows(ranking.dice_scores(ask(spark, a), some).select("question_id", "score")) == [(1, expected)]
    assert ranking.dice_scores(ask(spark, ""), some).count() == 0


def test_cosine(spark):
    value = lambda a, b: spark.range(1).select(scores.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    assert value([1.0, 0.0], [2.0, 0.0]) == 1 and value([1.0, 0.0], [-1.0, 0.0]) == -1
    for bad in (([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])):
        with pytest.raises(Exception, match=r"length|zero"):
            value(*bad)


def test_semantic_best(spark):
    some = candidates(spark, ("A", 0, "x", "Answer", [1.0, 0.0]), ("A", 1, "y", "Answer", [0.9, 0.1]), ("B", 2, "z", "Answer", [0.8, 0.6]))
    found = ranking.semantic_best(ask(spark, "q", [1.0, 0.0]), some).first()
    assert (found.item_id, found.pos, found.second_item_id, round(found.margin, 6)) == ("A", 0, "B", 0.2)
    alone = ranking.semantic_best(ask(spark, "q", [1.0, 0.0]), some.where("item_id = 'A'")).first()
    assert alone.margin is None
    assert ranking.semantic_best(ask(spark, "q", [1.0, 0.0]), some.limit(0)).count() == 0
    with pytest.raises(Exception, match="blank"):
        ranking.semantic_best(ask(spark, " ", [1.0, 0.0]), some).collect()


def test_ties_and_negative_scores(spark):
    some = candidates(spark, ("B", 0, "x", "Answer", [-1.0, 0.0]), ("A", 1, "x", "Answer", [1.0, 0.0]), ("B", 2, "x", "Answer", [1.0, 0.0]), ("C", 3, "x", "Answer", [-1.0, 0.0]))
    # Equal scores: the item whose first phrasing comes first; in an item the first phrasing that reaches it.
    assert [r[1:4] for r in rows(ranking.semantic_top(ask(spark, "q", [1.0, 0.0]), some, 5).orderBy("rank"))] == [(1, "B", 2), (2, "A", 1), (3, "C", 3)]


def test_centroids(spark):
    some = candidates(spark, ("A", 0, "x", "Answer", [1.0, 0.0]), ("A", 1, "x", "Answer", [0.0, 1.0]))
    assert [round(x, 6) for x in ranking.centroids(some).first().embedding] == [0.707107, 0.707107]
    ragged = candidates(spark, ("A", 0, "x", "Answer", [1.0, 0.0]), ("A", 1, "x", "Answer", [0.0, 1.0, 2.0]))
    with pytest.raises(Exception, match="length"):
        ranking.centroids(ragged).collect()


def test_hybrid_prefers_lexical_winner(spark):
    some = candidates(spark, ("A", 0, "zzz", "Answer", [0.95, 0.3122499]), ("B", 1, "same words", "Answer", [0.85, 0.5267827]))
    found = ranking.hybrid_best(ask(spark, "same words", [1.0, 0.0]), some).first()
    assert (found.item_id, round(found.score, 4), round(found.second_score, 4)) == ("B", 0.8725, 0.8075)


def test_question_blocks_agree(spark):
    some = candidates(spark, *[(f"i{k % 5}", k, "x", "Answer", [float(k + 1), float(k % 3)]) for k in range(20)])
    asks = spark.createDataFrame([(k, "q", [1.0, float(k)]) for k in range(9)], "question_id long, question string, embedding array<float>")
    near_rows = lambda df: sorted((r.question_id, r.item_id, r.pos, round(r.score, 12)) for r in df.collect())
    whole = near_rows(ranking.cosine_scores(asks, some))
    size, blocks.QUESTION_BLOCK = blocks.QUESTION_BLOCK, 2
    try:
        parted = ranking.cosine_scores(asks, some)
        near = ranking.cosine_scores(asks, some, 2)
        parted, near = near_rows(parted), near_rows(near)
    finally:
        blocks.QUESTION_BLOCK = size
    assert parted == whole and len(whole) == 180
    # By blocks at least the best two items of each question stay, and the tops agree.
    assert set(near) <= set(whole)
    tops = lambda k: sorted((r.question_id, r.rank, r.item_id, r.pos) for r in ranking.semantic_top(asks, some, k).where("rank <= 3").collect())
    rows, best = blocks.ROW_BLOCK, tops(None)
    blocks.ROW_BLOCK = 3
    try:
        assert tops(3) == best
    finally:
        blocks.ROW_BLOCK = rows
    expected = {(r.question_id, r.pos): r.s for r in asks.crossJoin(some.select("pos", F.col("embedding").alias("v"))).select("question_id", "pos", scores.cosine(scores.doubles(F.col("embedding")), scores.doubles(F.col("v"))).alias("s")).collect()}
    assert all(abs(expected[q, pos] - s) < 1e-11 for q, _, pos, s in whole)


def corpus_of_words(spark, n, stop="the"):
    """Phrasings of random words, each with a word that all have; the last items are copies."""
    rng = random.Random(n)
    words = [f"w{k}" for k in range(60)]
    said = [" ".join([stop] * rng.randrange(1, 4) + [words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randrange(1, 25))]) for _ in range(n)]
    said += said[:20]
    some = spark.createDataFrame([(f"i{rng.randrange(80)}", k, t, "Answer" if k % 3 else "Clarification") for k, t in enumerate(said)], "item_id string, pos long, text string, kind string")
    asks = spark.createDataFrame([(k, f"{stop} " + " ".join(rng.sample(words, 6))) for k in range(12)] + [(50, " "), (51, "unheard")], "question_id long, question string")
    return some, asks


@pytest.mark.parametrize("block", [7, 1000])
def test_blocks_leave_only_what_can_be_first(spark, block, monkeypatch):
    """Rows equal all pairs ranked; of those few leave the blocks, though a word stands in every phrasing."""
    monkeypatch.setattr(blocks, "ROW_BLOCK", block)
    some, asks = corpus_of_words(spark, 3000)
    some = some.repartition(2)
    for scored, ranked in ((ranking.bm25_scores, ranking.bm25_top), (ranking.weighted_dice_scores, ranking.weighted_lexical_top), (ranking.dice_scores, ranking.dice_top)):
        pairs, near = scored(asks, some), scored(asks, some, keep=3)
        whole = ranking.top(ranking.best_phrasing(pairs), some, 3)
        key = lambda df: sorted((r.question_id, r.rank, r.item_id, r.pos, round(r.score, 9)) for r in df.collect())
        assert key(ranked(asks, some, 3)) == key(whole) and key(ranked(asks, some, None)) == key(ranking.top(ranking.best_phrasing(pairs), some, None))
        every = pairs.count()
        assert every >= 12 * some.count() and near.count() * (10 if block > 7 else 2) < every
        assert ranked(asks, some, 0).count() == 0 and ranked(asks, some, -1).columns == whole.columns
    monkeypatch.setattr(blocks, "QUESTION_BLOCK", 4)
    assert key(ranking.dice_top(asks, some, 3)) == key(whole)


def test_bm25_blocks_that_cannot_reach_the_threshold_are_left_out():
    limits = blocks.Thresholds(2, 2)
    scores_of = np.array([[5.0, 4.0, 1.0, 4.5], [1.0, 1.0, 1.0, 1.0]])
    kept = limits.survivors(scores_of, np.array([0, 1, 2, 1]), np.arange(2))
    assert kept.tolist() == [[True, False, False, True], [True, True, True, True]]
    assert np.allclose(limits.least, [4.5, 1.0])
    # A later block of lower scores leaves nothing; one question alone is looked at.
    assert not limits.survivors(np.array([[4.0, 3.0]]), np.array([0, 1]), np.array([0])).any()


@pytest.mark.parametrize("spread", [0.03, 0.3, 10.0])
def test_cells_leave_out_what_cannot_be_nearer(spark, spread):
    """Clusters, loose ones and none: the tops equal those of all vectors; of tight clusters little is read."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(30, 12))
    vectors = middle[rng.integers(0, 30, 3000)] + spread * rng.normal(size=(3000, 12))
    vectors[2900:] = vectors[:100]  # ties
    some = spark.createDataFrame([(f"i{k % 211}", k, v.tolist()) for k, v in enumerate(vectors)], "item_id string, pos long, embedding array<double>").repartition(3)
    asks = spark.createDataFrame([(k, "q", v.tolist()) for k, v in enumerate(vectors[::97] + 0.01)], "question_id long, question string, embedding array<double>")
    built, read = cells.build_cells(some, 40, 500), []
    assert built.sizes.sum() == 3000
    key = lambda df: sorted((r.question_id, r.rank, r.item_id, r.pos, round(r.score, 9)) for r in df.collect())
    for k in (1, 5, 400):
        found = ranking.top(ranking.best_phrasing(cells.pruned_scores(asks, built, k, read=read)), built.vectors, k)
        assert key(found) == key(ranking.semantic_top(asks, some, k))
    share = read[1][0] / read[1][1]
    assert share < 0.25 if spread < 0.1 else share <= 1
    assert cells.pruned_top(asks, some.limit(0), 3).count() == 0 and cells.pruned_top(asks.limit(0), some, 3, built).count() == 0 and cells.pruned_top(asks, some, 0, built).count() == 0


def test_centroids_of_many_batches(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(2500, 6))
    some = spark.createDataFrame([(f"i{k % 7}" if k % 2 else "hot", k, v.tolist()) for k, v in enumerate(vectors)], "item_id string, pos long, embedding array<double>").repartition(6)
    found = {r.item_id: (r.pos, np.array(r.embedding)) for r in ranking.centroids(some).collect()}
    for item in {"hot", *(f"i{k}" for k in range(7))}:
        own = [k for k in range(2500) if (f"i{k % 7}" if k % 2 else "hot") == item]
        mean = vectors[own].mean(0)
        assert found[item][0] == own[0] and np.allclose(found[item][1], mean / np.linalg.norm(mean))
    with pytest.raises(Exception, match="zero"):
        ranking.centroids(spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [-1.0])], some.schema)).collect()


def test_items_are_cleaned_and_expanded(spark):
    items = spark.createDataFrame(
        [("A", " Same question ", "a", ["Same question", "Same question", " "], " CLARIFICATION "), ("B", " ", "b", None, None), ("C", "c", "d", None, None)],
        "id string, question string, answer string, alternative_questions array<string>, kind string",
    )
    clean = corpus.clean_items(items)
    assert {r.id: r.kind for r in clean.collect()} == {"A": "Clarification", "C": "Answer"}
    assert [(r.item_id, r.place, r.text) for r in corpus.expand_candidates(clean).orderBy("item_id").collect()] == [("A", 0, "Same question"), ("C", 0, "c")]


def test_expanded_messages_are_never_gathered(spark, tmp_path, monkeypatch):
    rows = [(7, k, f" m{k % 900} " if k % 3 else f"m{k % 900}") for k in range(1800)] + [(8, 1, "b"), (8, 1, "a"), (8, 0, " "), (8, 2, None), (8, 3, "a "), (None, 1, "y"), (None, 0, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    for gather in ("collect_list", "collect_set", "array_agg"):
        monkeypatch.delattr(F, gather)
    done = catalogue.candidate_expansion(spark, str(tmp_path))
    found = {(r.item_id, r.place): r.text for r in done.collect()}
    assert found == {("7", k): f"m{k}" for k in range(900)} | {("8", 0): "a", ("8", 1): "b", (None, 0): "x", (None, 1): "y"} and done.count() == 904


class Caught:
    """Stands for a DataFrame and for a broadcast: catches the function over batches."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def matched(asked, batches, parts=ranking._weight_of_term, **named):
    """The rows that a task gives for batches of phrasings."""
    lists, sent = Caught(), Caught()
    sent.value = asked
    blocks.match_terms(lists, sent, None, named.pop("keep", None), parts, **named)
    return [r for b in lists.run(iter(batches)) for r in b.to_pylist()]


def words_asked(words, weights=None, unseen=1.0):
    return blocks.Asked(pa.chunked_array([pa.array(range(len(words)))]), pa.chunked_array([pa.array(words)]), weights, unseen)


def phrasings(words, items=7):
    return pa.RecordBatch.from_arrays([pa.array([f"i{k % items}" for k in range(len(words))]), pa.array(range(len(words))), pa.array(words)], ["item_id", "pos", "terms"])


def test_words_that_all_questions_have_take_no_memory_by_match():
    """400 words of 500 phrasings and 1,500 questions are 300 million matches; none of them gets a place in memory."""
    words = [f"w{k}" for k in range(400)]
    asked, batch = words_asked([words] * 1500), phrasings([words] * 500)
    tracemalloc.start()
    found = matched(asked, [batch], keep=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) >= 1500 and {r["score"] for r in found} == {400.0}
    assert most < 300e6


@pytest.mark.parametrize(("dense", "common", "fan"), [(2048, 32, 1 << 21), (5, 10**9, 1), (0, 32, 17), (3, 2, 100)])
def test_common_and_rare_words_add_up(dense, common, fan, monkeypatch):
    for name, value in (("DENSE", dense), ("COMMON", common), ("FAN", fan), ("ROW_BLOCK", 7)):
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(dense)
    some = lambda n: [[f"w{min(int(rng.expovariate(0.1)), 59)}" for _ in range(rng.randrange(0, 12))] for _ in range(n)]
    asks, said = [sorted(set(x)) for x in some(30)], some(40)
    weights = pa.table({"term": [f"w{k}" for k in range(50)], "idf": [1.0 + k / 7 for k in range(50)]})
    weight = {f"w{k}": 1.0 + k / 7 if k < 50 else 0.5 for k in range(60)}
    found = matched(words_asked(asks, weights, 0.5), [phrasings(said)], parts=lambda asked, block, doc, term, times: asked.weight[term] * times)
    sums = {(q, d): sum(weight[t] for t in t2 if t in t1) for q, t1 in enumerate(asks) for d, t2 in enumerate(said)}
    assert {(r["question_id"], r["pos"]): round(r["score"], 9) for r in found} == {k: round(v, 9) for k, v in sums.items() if v > 0}


def test_an_item_that_was_better_before_keeps_later_blocks_in(monkeypatch):
    """With as many items as are wanted no item is behind, yet few phrasings of the later blocks leave a task."""
    rng = random.Random(3)
    said = [rng.sample([f"w{k}" for k in range(40)], 12) for _ in range(3000)]
    asked, batch = words_asked([rng.sample([f"w{k}" for k in range(40)], 20) for _ in range(20)]), phrasings(said)
    monkeypatch.setattr(blocks, "ROW_BLOCK", 20)
    best = lambda rows: {k: max(r["score"] for r in rows if (r["question_id"], r["item_id"]) == k) for k in {(r["question_id"], r["item_id"]) for r in rows}}
    found, whole = matched(asked, [batch], keep=10), matched(asked, [batch])
    assert best(found) == best(whole) and len(best(found)) == 140
    assert len(found) * 3 < 150 * 140
    monkeypatch.setattr(blocks, "HELD", 0)
    assert best(matched(asked, [batch], keep=10)) == best(whole)


def test_terms_are_looked_up_for_many_blocks_at_once(monkeypatch):
    asked, batch, calls, look_up = words_asked([["a", "b"], ["b", "c"]]), phrasings([["a", "x"], ["b"], [], ["c", "b"]] * 100), [], blocks.pc.index_in
    monkeypatch.setattr(blocks, "ROW_BLOCK", 10)
    monkeypatch.setattr(blocks.pc, "index_in", lambda *a, **n: calls.append(1) or look_up(*a, **n))
    found = matched(asked, [batch.slice(0, 150), batch.slice(150)])
    assert len(calls) == 2
    assert {(r["question_id"], r["pos"]): r["score"] for r in found} == {(q, p): s for k in range(100) for q, p, s in ((0, 4 * k, 1.0), (0, 4 * k + 1, 1.0), (0, 4 * k + 3, 1.0), (1, 4 * k + 1, 1.0), (1, 4 * k + 3, 2.0))}


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_sums_that_single_precision_cannot_tell_apart(sign, monkeypatch):
    """Weights differ by one part in 10^8: what leaves a task still has the best of each item, with whole scores."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    weights = pa.table({"term": words, "idf": [1.0 + k * 1e-8 for k in range(59)] + [sign]})
    asked, batch = words_asked([rng.sample(words, 40) for _ in range(30)], weights), phrasings([rng.sample(words, 30) for _ in range(2000)])
    assert asked.matrix().dtype == np.float32
    monkeypatch.setattr(blocks, "ROW_BLOCK", 256)

    def best(rows):
        out = {}
        for r in rows:
            key, value = (r["question_id"], r["item_id"]), (round(r["score"], 9), -r["pos"])
            out[key] = max(out.get(key, value), value)
        return out

    found, whole = matched(asked, [batch], keep=3), matched(asked, [batch])
    of_all = best(whole)
    firsts = {q: sorted((v, i) for (p, i), v in of_all.items() if p == q)[-3:] for q in range(30)}
    reached = best(found)
    assert all(reached[q, i] == v for q, of in firsts.items() for v, i in of)
    exact = {(r["question_id"], r["pos"]): r["score"] for r in whole}
    assert len(found) * 4 < len(whole) and all(abs(exact[r["question_id"], r["pos"]] - r["score"]) < 1e-12 for r in found)


def test_questions_are_made_once_for_all_blocks(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    some = spark.createDataFrame([("a", 0, "x y", [1.0, 0.0]), ("b", 1, "y z", [0.5, 1.0])], "item_id string, pos long, text string, embedding array<double>")
    asks = spark.createDataFrame([(k, "x z", [1.0, float(k)]) for k in range(9)], "question_id long, question string, embedding array<double>")
    monkeypatch.setattr(blocks, "QUESTION_BLOCK", 2)
    assert ranking.semantic_top(asks.mapInArrow(count, asks.schema), some, 1).count() == 9
    assert made.value == 9


def test_blends_are_whole_where_a_phrasing_lies(spark, monkeypatch):
    """Both blends equal those of all pairs over several blocks, and no row is written for a pair that can't be among the best two."""
    some, _ = corpus_of_words(spark, 300)
    rng = np.random.default_rng(5)
    vector = {r.pos: rng.normal(size=4).tolist() for r in some.collect()}
    rows_of = [(r.item_id, r.pos, r.text, vector[r.pos]) for r in some.orderBy("pos").collect()]
    some = spark.createDataFrame(rows_of, "item_id string, pos long, text string, embedding array<double>")
    asks = spark.createDataFrame([(p, t, v) for _, p, t, v in rows_of[::40]] + [(999, " ", [1.0, 0.0, 0.0, 0.0])], "question_id long, question string, embedding array<double>")
    grams = {r.pos: set(r.grams) for r in corpus.gram_lists(some).collect()}
    idf = {r.gram: r.idf for r in corpus.gram_idf(some).collect()}
    unit = {p: np.array(v) / np.linalg.norm(v) for p, v in vector.items()}
    monkeypatch.setattr(blocks, "ROW_BLOCK", 50)
    monkeypatch.setattr(blocks, "QUESTION_BLOCK", 5)
    for weight, blend in ((dict.fromkeys(idf, 1.0), ranking.hybrid_best), (idf, ranking.weighted_hybrid_best)):
        found = {r.question_id: (r.item_id, r.pos, round(r.score, 9), r.second_item_id, round(r.second_score, 9)) for r in blend(asks, some).collect()}
        for q in [p for _, p, _, _ in rows_of[::40]]:
            best = {}
            for item, p, _, _ in rows_of:
                size = lambda s: sum(weight[g] for g in s)
                s = round(0.85 * float(unit[q] @ unit[p]) + 0.15 * 2 * size(grams[q] & grams[p]) / (size(grams[q]) + size(grams[p])), 9)
                if item not in best or s > best[item][0]:
                    best[item] = (s, p)
            first = {item: min(p for i, p, _, _ in rows_of if i == item) for item in best}
            a, b = sorted(best, key=lambda i: (-best[i][0], first[i]))[:2]
            assert (found[q][0], found[q][1], found[q][3]) == (a, best[a][1], b)
            assert abs(found[q][2] - best[a][0]) < 1e-8 and abs(found[q][4] - best[b][0]) < 1e-8
        assert len(found) == len(rows_of[::40])
    lists = ranking._gram_vectors(some).withColumn("own", F.size("grams").cast("double"))
    assert ranking._blended(asks, lists, None, 1.0).count() * 5 < len(rows_of) * len(found)
