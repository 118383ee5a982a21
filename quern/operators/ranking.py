"""Rankings of items per question: BM25, weighted and plain Dice, cosine, centroids and blends.

Each returns question_id, rank, item_id, pos (of the best phrasing) and score. Ties in an item go to
the smaller pos, ties between items to the item whose first phrasing comes first. Scores are
ordered after rounding to 9 places, so that the order of additions does not decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import scores
from quern.operators import blocks, corpus

SEMANTIC_SHARE, LEXICAL_SHARE = 0.85, 0.15
#: Grams whose weights are sent to the workers; of more, phrasings get their total weight by a join.
VOCABULARY = 1 << 18


def best_phrasing(scored: DataFrame) -> DataFrame:
    """The best row per question and item, with first_pos, the item's first scored phrasing."""
    best = F.max_by(F.struct("pos", "score"), F.struct(F.round("score", 9), -F.col("pos")))
    return scored.groupBy("question_id", "item_id").agg(best.alias("b")).select("question_id", "item_id", "b.pos", "b.score")


def top(best: DataFrame, candidates: DataFrame, k: int | None) -> DataFrame:
    """The first k items per question (all for None)."""
    first = candidates.groupBy("item_id").agg(F.min("pos").alias("first_pos"))
    order = Window.partitionBy("question_id").orderBy(F.round("score", 9).desc(), "first_pos")
    ranked = best.join(first, "item_id").withColumn("rank", F.row_number().over(order))
    ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    return ranked.select("question_id", "rank", "item_id", "pos", "score")


def no_rows(questions: DataFrame) -> DataFrame:
    """The empty ranking, for a limit below 1: nothing is scored."""
    schema = blocks.scored_schema(questions).add("rank", T.IntegerType())
    return questions.sparkSession.createDataFrame([], schema).select("question_id", "rank", "item_id", "pos", "score")


def _limited(rank: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(rank)
    def run(questions: DataFrame, candidates: DataFrame, k: int | None, *rest: object, **named: object) -> DataFrame:
        return no_rows(questions) if k is not None and k < 1 else rank(questions, candidates, k, *rest, **named)

    return run


def asked(questions: DataFrame) -> DataFrame:
    """Questions that are not blank."""
    return questions.where(F.length(F.trim("question")) > 0)


def _asked_lists(questions: DataFrame, column: str) -> DataFrame:
    """question_id and the set of its terms or grams."""
    rows = corpus.with_terms(asked(questions), "question") if column == "terms" else corpus.with_grams(asked(questions), "question")
    return rows.select("question_id", F.array_distinct(column).alias(column))


def _of_terms(weights: DataFrame, asks: pa.Table, *columns: str) -> pa.Table:
    """term (or gram) and weight of those that a block of questions asks for: as many rows as those at most."""
    terms = asks.column(1).combine_chunks().flatten().unique()
    wanted = weights.sparkSession.createDataFrame(pa.table({columns[0]: terms.cast(pa.string())}))
    return weights.join(F.broadcast(wanted), columns[0], "left_semi").select(*columns).toArrow()


def bm25_scores(questions: DataFrame, candidates: DataFrame, lists: DataFrame | None = None, keep: int | None = None) -> DataFrame:
    """Scores above 0 of phrasings that share a term, as blocks.match_terms gives them; lists are kept term lists of the same phrasings."""
    lists = corpus.kept_once(corpus.term_lists(candidates), "terms") if lists is None else lists
    lists, schema = lists.select("item_id", "pos", "terms"), blocks.scored_schema(questions)
    n, mean_length = corpus.corpus_of(lists).first()
    held = lists.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = corpus.kept_once(held.select("term", scores.bm25_idf(F.lit(n), F.col("df")).alias("idf")), "idf")

    def parts(asked: blocks.Asked, block: pa.RecordBatch, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        length = block.column(2).value_lengths().to_numpy()[doc]
        return asked.weight[term] * times * (scores.K1 + 1.0) / (times + scores.K1 * (1.0 - scores.B + scores.B * length / mean_length))

    def scan(asks: pa.Table) -> tuple[DataFrame, Broadcast]:
        found = _of_terms(weights, asks, "term", "idf")
        sent = lists.sparkSession.sparkContext.broadcast(blocks.Asked(*asks.columns, found, 0.0))
        return blocks.match_terms(lists, sent, schema, keep, parts), sent

    return blocks.in_blocks(_asked_lists(questions, "terms"), scan)


@_limited
def bm25_top(questions: DataFrame, candidates: DataFrame, k: int | None, kind: str | None = None, lists: DataFrame | None = None) -> DataFrame:
    lists = corpus.kept_once(corpus.term_lists(corpus.of_kind(candidates, kind)), "terms") if lists is None else lists
    return top(best_phrasing(bm25_scores(questions, candidates, lists, _all(k))), lists, k)


def _all(k: int | None) -> int:
    """As many items as are wanted; 0 for all of them, of which only the best phrasings count all the same."""
    return k or 0


def _with_totals(lists: DataFrame, idf: DataFrame, unseen: float) -> DataFrame:
    """lists (item_id, pos, grams, others) and ``own``, the weight of all grams of a phrasing."""
    if idf.count() <= VOCABULARY:
        grams = idf.select("gram", "idf").toArrow()
        sent = lists.sparkSession.sparkContext.broadcast((grams["gram"].combine_chunks(), grams["idf"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, weight = sent.value
            weight = np.append(weight, unseen)
            for batch in batches:
                sizes = batch.column(2).value_lengths().to_numpy()
                at = pc.fill_null(pc.index_in(batch.column(2).flatten(), value_set=known), len(weight) - 1).to_numpy()
                own = np.bincount(np.repeat(np.arange(batch.num_rows), sizes), weight[at], batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "own"])

        return lists.mapInArrow(run, T.StructType([*lists.schema.fields, T.StructField("own", T.DoubleType())]))
    each = lists.select("item_id", "pos", F.explode("grams").alias("gram")).join(idf.select("gram", "idf"), "gram", "left")
    totals = each.groupBy("item_id", "pos").agg(F.sum(F.coalesce("idf", F.lit(unseen))).alias("own"))
    return lists.join(totals, ["item_id", "pos"])


def weighted_dice_scores(questions: DataFrame, candidates: DataFrame, statistics: DataFrame | None = None, lists: DataFrame | None = None, keep: int | None = None) -> DataFrame:
    """Twice the shared weight over both sides' weight, for phrasings that share a gram; unseen grams weigh unseen_idf."""
    lists = corpus.kept_once(corpus.gram_lists(candidates), "grams") if lists is None else lists
    lists, schema = lists.select("item_id", "pos", "grams"), blocks.scored_schema(questions)
    idf = corpus.kept_once(corpus.idf_of(lists) if statistics is None else corpus.gram_idf(statistics), "idf")
    unseen = idf.agg(F.max("unseen_idf")).first()[0] or 0.0
    totals = _with_totals(lists, idf, unseen)

    def scan(asks: pa.Table) -> tuple[DataFrame, Broadcast]:
        found = _of_terms(idf, asks, "gram", "idf")
        sent = lists.sparkSession.sparkContext.broadcast(blocks.Asked(*asks.columns, found, unseen))
        return blocks.match_terms(totals, sent, schema, keep, _weight_of_term, _dice), sent

    return blocks.in_blocks(_asked_lists(questions, "grams"), scan)


def _weight_of_term(asked: blocks.Asked, block: pa.RecordBatch, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
    return asked.weight[term]


def _dice(asked: blocks.Asked, block: pa.RecordBatch, q: np.ndarray, c: np.ndarray, both: np.ndarray) -> np.ndarray:
    total = asked.total[q] + block.column("own").to_numpy()[c]
    return np.divide(2.0 * both, total, out=np.zeros_like(both), where=total > 0)


@_limited
def weighted_lexical_top(questions: DataFrame, candidates: DataFrame, k: int | None, kind: str | None = None, lists: DataFrame | None = None) -> DataFrame:
    lists = corpus.kept_once(corpus.gram_lists(corpus.of_kind(candidates, kind)), "grams") if lists is None else lists
    return top(best_phrasing(weighted_dice_scores(questions, candidates, lists=lists, keep=_all(k))), lists, k)


def dice_scores(questions: DataFrame, candidates: DataFrame, lists: DataFrame | None = None, keep: int | None = None) -> DataFrame:
    """Dice of trigram sets for phrasings that share a gram; others have 0."""
    lists = corpus.gram_lists(candidates) if lists is None else lists
    rows = lists.select("item_id", "pos", "grams", F.size("grams").cast("double").alias("own"))
    schema = blocks.scored_schema(questions)

    def scan(asks: pa.Table) -> tuple[DataFrame, Broadcast]:
        sent = lists.sparkSession.sparkContext.broadcast(blocks.Asked(*asks.columns, None, 1.0))
        return blocks.match_terms(rows, sent, schema, keep, _weight_of_term, _dice), sent

    return blocks.in_blocks(_asked_lists(questions, "grams"), scan)


@_limited
def dice_top(questions: DataFrame, candidates: DataFrame, k: int | None) -> DataFrame:
    lists = corpus.kept_once(corpus.gram_lists(candidates), "grams")
    return top(best_phrasing(dice_scores(questions, candidates, lists, _all(k))), lists, k)


def flat_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix, without a copy of each; others raise."""
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) != 1:
        raise ValueError("vectors differ in length")
    return vectors.flatten().to_numpy().reshape(-1, int(sizes[0]))


def unit_rows(vectors: pa.Array | list) -> np.ndarray:
    """Vectors at unit length as rows; ragged or zero ones raise."""
    if not len(vectors):
        return np.zeros((0, 0))
    rows = flat_rows(vectors) if isinstance(vectors, pa.Array) else np.array([np.asarray(v, np.float64) for v in vectors])
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    if (size == 0).any():
        raise ValueError("a vector is zero")
    return rows / size


def cosine_scores(questions: DataFrame, candidates: DataFrame, keep: int | None = None) -> DataFrame:
    """The cosine of questions with phrasings, as products of matrices; negative ones stay.

    With keep (0: all items), a block of phrasings gives a question only those that are the best of their item so
    far and reach its best ``keep`` items, ties included: no other can be the best of one of the best ``keep`` of all.
    Questions are a stated set, sent in blocks.
    """
    rows = candidates.select(F.col("item_id").cast("string").alias("item_id"), F.col("pos").cast("long").alias("pos"), scores.doubles(F.col("embedding")).alias("v"))
    schema = blocks.scored_schema(questions)
    asks = questions.select("question_id", scores.doubles(F.col("embedding")).alias("q"))
    size = blocks.ROW_BLOCK

    def scan(asked: pa.Table) -> tuple[DataFrame, Broadcast]:
        sent = rows.sparkSession.sparkContext.broadcast((asked.column(0).combine_chunks(), unit_rows(asked.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            some, limits = np.arange(len(ids)), blocks.Thresholds(len(ids), keep)
            for batch in batches:
                for first in range(0, batch.num_rows if len(ids) else 0, size):
                    part = batch.slice(first, size)
                    cosine = matrix @ _like(matrix, unit_rows(part.column(2))).T
                    coded = part.column(0).dictionary_encode()
                    q, c = np.nonzero(limits.survivors(cosine, coded.indices.to_numpy(), some, coded.dictionary.to_pylist()))
                    if len(q):
                        yield blocks.emitted(ids, part, q, c, cosine[q, c])

        return rows.mapInArrow(run, schema), sent

    return blocks.in_blocks(asks, scan)


def _like(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The vectors, if they are as long as the rows of the matrix."""
    if vectors.shape[1] != matrix.shape[1]:
        raise ValueError("vectors differ in length")
    return vectors


@_limited
def semantic_top(questions: DataFrame, candidates: DataFrame, k: int | None, kind: str | None = None) -> DataFrame:
    candidates = corpus.of_kind(candidates, kind)
    return top(best_phrasing(cosine_scores(questions, candidates, _all(k))), candidates, k)


#: Items of which a task holds a sum of vectors at once.
HELD_ITEMS = 1 << 14


def centroids(candidates: DataFrame) -> DataFrame:
    """item_id, pos (first phrasing), embedding: the mean of an item's vectors at unit length; ragged or zero ones raise.

    Each task sums whole vectors per item, a batch at a time; what leaves it is a row per item (or per item and HELD_ITEMS others). The
    sums of an item meet in one task, which adds them as they come.
    """
    rows = candidates.select(F.col("item_id").cast("string").alias("item_id"), F.col("pos").cast("long").alias("pos"), scores.doubles(F.col("embedding")).alias("v"))
    names, kinds = ["item_id", "pos", "n", "v"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]

    def packed(held: dict) -> pa.RecordBatch:
        columns = [list(held), [p for p, _, _ in held.values()], [n for _, n, _ in held.values()], [v for _, _, v in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def add(held: dict, item: str, pos: int, n: int, v: np.ndarray) -> None:
        if item in held:
            p, m, w = held[item]
            if len(w) != len(v):
                raise ValueError("vectors of an item differ in length")
            pos, n, v = min(p, pos), m + n, w + v
        held[item] = (pos, n, v)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            if not batch.num_rows:
                continue
            order = np.argsort(codes.indices.to_numpy(), kind="stable")
            starts = np.searchsorted(codes.indices.to_numpy()[order], np.arange(len(codes.dictionary)))
            sums = np.add.reduceat(flat_rows(batch.column(2))[order], starts)
            least = np.minimum.reduceat(batch.column(1).to_numpy()[order], starts).tolist()
            for item, pos, n, v in zip(codes.dictionary.to_pylist(), least, np.diff(np.append(starts, len(order))).tolist(), sums, strict=True):
                add(held, item, pos, n, v)
            if len(held) >= HELD_ITEMS:
                yield packed(held)
                held.clear()
        if held:
            yield packed(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by item, so one item is held beside those that are done."""
        held: dict = {}
        for batch in batches:
            for item, pos, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                add(held, item, pos, n, v.values.to_numpy())
            if len(held) > 1:
                *done, last = held
                yield packed({item: held[item] for item in done})
                held = {last: held[last]}
        if held:
            yield packed(held)

    schema = "item_id string, pos long, n long, v array<double>"
    whole = rows.mapInArrow(summed, schema).repartition("item_id").sortWithinPartitions("item_id").mapInArrow(merged, schema)
    mean = F.transform("v", lambda x: x / F.col("n"))
    return whole.select("item_id", "pos", scores.unit(mean, zero_raises=True).alias("embedding"))


@_limited
def centroid_top(questions: DataFrame, candidates: DataFrame, k: int | None, kind: str | None = None) -> DataFrame:
    means = corpus.kept_once(centroids(corpus.of_kind(candidates, kind)), "means")
    return top(cosine_scores(questions, means, _all(k)), means, k)


def with_runner_up(ranked: DataFrame, single_margin: Column | None = None) -> DataFrame:
    """Per question the best item, the next one and the margin (by default null where there is none)."""
    order = Window.partitionBy("question_id").orderBy("rank")
    both = ranked.where("rank <= 2").select("*", F.lead("item_id").over(order).alias("second_item_id"), F.lead("score").over(order).alias("second_score"))
    margin = F.col("score") - F.col("second_score")
    margin = margin if single_margin is None else F.coalesce(margin, single_margin)
    return both.where("rank = 1").drop("rank").withColumn("margin", margin)


def semantic_best(questions: DataFrame, candidates: DataFrame, kind: str | None = None) -> DataFrame:
    """Best item and runner-up by cosine; blank questions raise."""
    blank = F.raise_error(F.lit("a question is blank")).cast("string")
    checked = questions.withColumn("question", F.when(F.length(F.trim("question")) > 0, F.col("question")).otherwise(blank)).where("question is not null")
    return with_runner_up(semantic_top(checked, candidates, 2, kind))


def _blended(questions: DataFrame, rows: DataFrame, idf: DataFrame | None, unseen: float) -> DataFrame:
    """Blends of cosine and (weighted) Dice that can be the best two items of a question.

    rows: item_id, pos, grams, v and ``own``. Both parts of a pair are reckoned where the phrasing lies, so no pair waits for its grams.
    """
    schema = blocks.scored_schema(questions)
    asks = corpus.with_grams(asked(questions), "question").select("question_id", "grams", scores.doubles(F.col("embedding")).alias("q"))

    def blend(asked: blocks.Asked, block: pa.RecordBatch, q: np.ndarray, c: np.ndarray, both: np.ndarray) -> np.ndarray:
        vectors = _like(asked.vectors, unit_rows(block.column("v")))
        # All phrasings of each question at once, or pairs.
        cosine = asked.vectors[q[:, 0]] @ vectors.T if q.ndim == 2 else np.einsum("ij,ij->i", asked.vectors[q], vectors[c])
        return SEMANTIC_SHARE * cosine + LEXICAL_SHARE * _dice(asked, block, q, c, both)

    def scan(asks: pa.Table) -> tuple[DataFrame, Broadcast]:
        found = None if idf is None else _of_terms(idf, asks, "gram", "idf")
        sent = rows.sparkSession.sparkContext.broadcast(blocks.Asked(*asks.columns[:2], found, unseen, unit_rows(asks.column(2).combine_chunks())))
        return blocks.match_terms(rows, sent, schema, 2, _weight_of_term, blend, every=True), sent

    return blocks.in_blocks(asks, scan)


def _gram_vectors(candidates: DataFrame) -> DataFrame:
    """item_id, pos, grams, v: kept, as every block of questions reads them."""
    rows = corpus.with_grams(candidates, "text").select(F.col("item_id").cast("string").alias("item_id"), F.col("pos").cast("long").alias("pos"), "grams", scores.doubles(F.col("embedding")).alias("v"))
    return corpus.kept_once(rows, "grams")


def hybrid_best(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    lists = _gram_vectors(candidates)
    rows = lists.withColumn("own", F.size("grams").cast("double"))
    return with_runner_up(top(best_phrasing(_blended(questions, rows, None, 1.0)), lists, 2))


def weighted_hybrid_best(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    # As above; weights come from the grams of all phrasings.
    lists = _gram_vectors(candidates)
    idf = corpus.kept_once(corpus.idf_of(lists), "idf")
    unseen = idf.agg(F.max("unseen_idf")).first()[0] or 0.0
    rows = _with_totals(lists, idf, unseen)
    return with_runner_up(top(best_phrasing(_blended(questions, rows, idf, unseen)), lists, 2))
