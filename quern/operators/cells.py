"""Exact search of vectors by cells: parts of the corpus that can't hold a better one are not compared.

Every vector is dealt to the nearest of some centres, taken from a bounded sample, and kept with its angle to that
centre; the table is sorted by cell and angle. For a question, the angle to a vector of a cell is at least the difference
of their angles to the centre (the triangle inequality holds for angles). A first pass compares a question with its nearest
cells, which gives the angle that its k-th item has at least; a second one compares it with what may be nearer in the other cells: a
stretch of each, by angle. So the result is that of comparing all. How much is left out depends on the vectors: clusters
leave much out, vectors without any structure nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import scores
from quern.operators import blocks, corpus, ranking

#: Vectors that centres are chosen from, whatever the corpus holds, and how many centres.
SAMPLE, CENTRES = 4096, 256
#: Cells that a question is compared with first.
NEAREST = 2
#: Rounding of angles: a bound that is closer than this counts as reached.
SLACK = 1e-6


@dataclass
class Cells:
    """vectors: cell, angle, item_id, pos, v (of unit length), by cell and angle; and each cell's centre, size and largest angle."""

    vectors: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray


def _angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(left @ right.T, -1.0, 1.0))


def choose_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before."""
    chosen, near = [0], _angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and near.max() > 1e-9:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _angles(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def build_cells(candidates: DataFrame, centres: int = CENTRES, sample: int = SAMPLE) -> Cells:
    """All vectors in cells, in a kept table. The sample is that of the smallest hashes of places."""
    rows = candidates.select(F.col("item_id").cast("string").alias("item_id"), F.col("pos").cast("long").alias("pos"), scores.doubles(F.col("embedding")).alias("v"))
    some = rows.orderBy(F.xxhash64("pos"), "pos").limit(sample).select("v").collect()
    middle = choose_centres(ranking.unit_rows([r.v for r in some]), centres) if some else np.zeros((0, 0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = ranking.unit_rows(batch.column(2))
            if vectors.shape[1] != middle.shape[1]:
                raise ValueError("vectors differ in length")
            angle = _angles(vectors, middle)
            cell = angle.argmin(1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell]), batch.column(0), batch.column(1), flat], ["cell", "angle", "item_id", "pos", "v"])

    dealt = rows.mapInArrow(deal, "cell int, angle double, item_id string, pos long, v array<double>")
    kept = corpus.kept_once(dealt.repartitionByRange("cell", "angle", "pos").sortWithinPartitions("cell", "angle"), "cells")
    sizes, radii = np.zeros(len(middle), np.int64), np.zeros(len(middle))
    for r in kept.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("most")).collect():  # a row per centre
        sizes[r.cell], radii[r.cell] = r.n, r.most
    return Cells(kept, middle, sizes, radii)


def _compared(cells: Cells, sent: Broadcast, schema: T.StructType, keep: int) -> DataFrame:
    """Scores of the stretches (first, last angle per question and cell; none where last < first) that the broadcast asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, low, high = sent.value
        limits, ids = blocks.Thresholds(len(ids), keep), pa.array(ids)
        for batch in batches:
            cell, angle = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            for a, b in zip(edges, edges[1:], strict=False):
                own = int(cell[a])
                some = np.flatnonzero((low[:, own] <= angle[b - 1]) & (high[:, own] >= angle[a]))
                if not len(some):
                    continue
                # What lies between the smallest and the largest angle that any of them asks for.
                a, b = a + np.searchsorted(angle[a:b], low[some, own].min()), a + np.searchsorted(angle[a:b], high[some, own].max(), "right")
                for first in range(a, b, blocks.ROW_BLOCK):
                    part = batch.slice(first, min(blocks.ROW_BLOCK, b - first)).select(["item_id", "pos", "v"])
                    cosine = matrix[some] @ ranking.flat_rows(part.column(2)).T
                    q, c = np.nonzero(limits.survivors(cosine, part.column(0).dictionary_encode().indices.to_numpy(), some))
                    if len(q):
                        yield blocks.emitted(ids, part, some[q], c, cosine[q, c])

    asked = np.flatnonzero((sent.value[2] <= sent.value[3]).any(axis=0)).tolist()
    rows = cells.vectors if len(asked) == len(cells.centres) else cells.vectors.where(F.col("cell").isin(asked))
    return rows.mapInArrow(run, schema)


def pruned_scores(questions: DataFrame, cells: Cells, k: int, nearest: int = NEAREST, read: list[tuple[int, int]] | None = None) -> DataFrame:
    """Cosines that can be among those of the best k items of a question, as ranking.cosine_scores gives them.

    To ``read``, if given, each block of questions adds how many pairs of a question and a vector it compares at most, and how many there are.
    """
    schema = blocks.scored_schema(questions)
    asks = questions.select("question_id", scores.doubles(F.col("embedding")).alias("q"))
    context = questions.sparkSession.sparkContext

    def scan(asked: pa.Table) -> tuple[DataFrame, Broadcast]:
        ids, matrix = asked.column(0).to_pylist(), ranking.unit_rows(asked.column(1).combine_chunks())
        if not len(ids) or not len(cells.centres):
            sent = context.broadcast(None)
            return questions.sparkSession.createDataFrame([], schema), sent
        away = _angles(matrix, cells.centres)
        first = np.argsort(np.where(cells.sizes > 0, away, np.inf), axis=1, kind="stable")[:, :nearest]
        low, high = np.full(away.shape, np.inf), np.full(away.shape, -np.inf)
        np.put_along_axis(low, first, 0.0, axis=1)
        np.put_along_axis(high, first, np.pi, axis=1)
        one = context.broadcast((ids, matrix, low, high))
        near = corpus.kept_once(_compared(cells, one, schema, k), "near")
        # Per question the score of its k-th item so far; a row each.
        best = ranking.best_phrasing(near).groupBy("question_id").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("s"))
        reached = {r.question_id: r.s[0] for r in best.collect() if r.s}
        limit = np.array([np.arccos(np.clip(reached.get(q, -1.0), -1.0, 1.0)) for q in ids]) + SLACK
        # A vector at an angle t to the centre is at |away - t| or more.
        low2, high2 = np.maximum(away - limit[:, None], 0.0), np.minimum(away + limit[:, None], cells.radii[None, :] + SLACK)
        np.put_along_axis(low2, first, np.inf, axis=1)
        sent = context.broadcast((ids, matrix, low2, high2))
        if read is not None:
            read.append((int(cells.sizes[first].sum() + np.where(low2 <= high2, cells.sizes[None, :], 0).sum()), len(ids) * int(cells.sizes.sum())))
        return near.unionByName(_compared(cells, sent, schema, k)), sent

    return blocks.in_blocks(asks, scan)


def pruned_top(questions: DataFrame, candidates: DataFrame, k: int, cells: Cells | None = None) -> DataFrame:
    """ranking.semantic_top by cells, which are built where none are given."""
    cells = cells or build_cells(candidates)
    return ranking.no_rows(questions) if k < 1 else ranking.top(ranking.best_phrasing(pruned_scores(questions, cells, k)), cells.vectors, k)
