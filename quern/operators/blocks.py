"""Questions against all phrasings, in blocks: what every ranking by sums of matches or by vectors is made of.

A stated set of questions goes out in blocks of bounded size; phrasings stay where they lie. A task scores a block of
its phrasings at once, so every score is whole there, and gives a question only phrasings that can still be the best of an item
among its first ``keep`` items: no pair is shuffled to be summed. Questions are kept once, and with more than one block each
result is written to the shared folder before the next is read, so the driver holds one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import corpus

#: Questions that are compared with all phrasings at once; more are taken in blocks of about this many.
QUESTION_BLOCK = 8192
#: Phrasings that are compared with a block of questions at once.
ROW_BLOCK = 256
#: Terms that are summed by a product of matrices: those that most questions of a block have, one in COMMON at least.
DENSE, COMMON = 2048, 32
#: Matches of other terms with questions that are spread out at once.
FAN = 1 << 21
#: Pairs of an item and a question of which a task holds the best score.
HELD = 1 << 22
#: Phrasings whose terms are looked up at once.
LOOKED_UP = 4096
#: Scores are ordered at nine places, so what is closer than this counts as tied.
TIE = 2e-9
#: What a product in single precision may be off, as a share of itself: (DENSE + 2) roundings of 2^-24, twice over.
ROUGH = 2.5e-4
#: Of pairs that stay, those that are summed anew at once; where more than one in so many stays, the product is made anew.
ANEW, FEW = 1024, 64


def in_blocks(questions: DataFrame, scan: Callable[[pa.Table], tuple[DataFrame, Broadcast]]) -> DataFrame:
    """The union of what ``scan`` gives for each block of questions."""
    questions = corpus.kept_once(questions, "questions")  # else each block would make all of them anew
    count = questions.count()
    if count <= QUESTION_BLOCK:
        return scan(questions.toArrow())[0]
    # Hashes deal evenly; a tenth more blocks keeps each below the size that is sent.
    blocks, done = -(-count * 11 // (10 * QUESTION_BLOCK)), []
    for b in range(blocks):
        found, sent = scan(questions.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b).toArrow())
        done.append(corpus.kept_once(found, "block"))
        sent.unpersist()
    return reduce(DataFrame.unionByName, done)


def scored_schema(questions: DataFrame) -> T.StructType:
    kind = next(f for f in questions.schema if f.name == "question_id").dataType
    return T.StructType([T.StructField("question_id", kind), T.StructField("item_id", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("score", T.DoubleType())])


class Thresholds:
    """What a phrasing has to reach, per question: the score of the ``keep``-th item so far, and its own item's best so far."""

    def __init__(self, questions: int, keep: int | None) -> None:
        self.keep = keep
        self.least = np.full(questions, -np.inf)
        #: The items met first, as many as HELD allows, and what each has reached.
        self.most = HELD // max(questions, 1)
        self.place: dict[str | None, int] = {}
        self.reached = np.full((questions, 0), -np.inf)

    def _places(self, names: list[str | None]) -> np.ndarray:
        """The column of each item in ``reached``; -1 for those that are not held."""
        for name in names:
            if len(self.place) < self.most:
                self.place.setdefault(name, len(self.place))
        if (more := len(self.place) - self.reached.shape[1]) > 0:
            more = max(more, min(self.reached.shape[1], self.most - self.reached.shape[1]))  # room for as many again
            self.reached = np.pad(self.reached, ((0, 0), (0, more)), constant_values=-np.inf)
        return np.array([self.place.get(name, -1) for name in names], np.int64)

    def survivors(self, scores: np.ndarray, items: np.ndarray, some: np.ndarray, names: list[str | None] | None = None, off: np.ndarray | float = 0.0) -> np.ndarray:
        """Which (question of some, phrasing) can be the best of its item among the first items of all.

        An item of this block that is behind ``keep`` others of any block is behind them for good; so is a phrasing behind
        another of its item, also one of an earlier block where the names of the items are given. Ties stay, and so does what
        rough scores can't tell apart: off is what each question's may be off.
        """
        if self.keep is None or not len(items):
            return np.ones(scores.shape, bool)
        tie = TIE + 2 * off
        order = np.argsort(items, kind="stable")
        starts = np.searchsorted(items[order], np.arange(items.max() + 1))
        best = np.maximum.reduceat(scores[:, order], starts, axis=1)
        if names is not None:
            at = self._places(names)
            held, at = np.flatnonzero(at >= 0), at[at >= 0]
            cells = np.ix_(some, at)
            best[:, held] = self.reached[cells] = np.maximum(best[:, held], self.reached[cells])
        if best.shape[1] >= self.keep > 0:
            own = np.partition(best, -self.keep, axis=1)[:, -self.keep] - tie
            self.least[some] = np.maximum(self.least[some], own)
        least = np.maximum(best - np.reshape(tie, (-1, 1)), self.least[some][:, None])
        return scores >= least[:, items]


def emitted(ids: pa.Array, part: pa.RecordBatch, q: np.ndarray, c: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    c = pa.array(c)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), part.column("item_id").take(c), part.column("pos").take(c), pa.array(scores)], ["question_id", "item_id", "pos", "score"])


class Asked:
    """A block of questions as sets of terms: for each term its weight and the questions that have it; for each question its total weight."""

    def __init__(self, ids: pa.ChunkedArray, lists: pa.ChunkedArray, weights: pa.Table | None, unseen: float, vectors: np.ndarray | None = None) -> None:
        """weights: terms that the corpus has and what they weigh, the others weigh ``unseen``; vectors: a row per question."""
        self.ids, self.vectors = ids.combine_chunks(), vectors
        rows = lists.combine_chunks()
        flat = rows.flatten().dictionary_encode()
        self.terms, term = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), pc.fill_null(rows.value_lengths(), 0).to_numpy())
        order = np.argsort(term, kind="stable")
        self.term, self.owner = term[order].astype(np.int32), owner[order].astype(np.int32)
        count = np.bincount(term, minlength=len(self.terms))
        self.first = np.append(0, np.cumsum(count))
        self.weight = np.full(len(self.terms), unseen)
        if weights is not None and weights.num_rows:
            at = pc.index_in(self.terms, value_set=weights.column(0).combine_chunks())
            known = pc.is_valid(at).to_numpy(zero_copy_only=False)
            self.weight[known] = weights.column(1).to_numpy()[at.drop_null().to_numpy()]
        self.total = np.bincount(owner, self.weight[term], len(self.ids))
        #: Of each term its column in the matrix; -1 for those that few questions have.
        self.column = np.full(len(self.terms), -1)
        common = np.argsort(-count, kind="stable")[:DENSE]
        common = common[count[common] * COMMON >= len(self.ids)]
        self.column[common] = np.arange(len(common))
        self.width = len(common)

    def matrix(self) -> np.ndarray:
        """1.0 where a question has a common term."""
        out = np.zeros((len(self.ids), self.width), np.float32)
        column = self.column[self.term]
        out[self.owner[column >= 0], column[column >= 0]] = 1.0
        return out


#: Of matches (phrasing, term, times) in a block, and the block itself, the part of each in a score.
Parts = Callable[[Asked, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Scores from sums of parts: (asked, block, questions, phrasings, sums), where the places of both are arrays that spread to the
#: shape of the sums. An error in the sums makes the same share of the score, or of 1, at most.
Final = Callable[[Asked, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Sums:
    """The parts of matches summed per question of some and phrasing: common terms by a product of matrices, the others spread over their questions."""

    def __init__(self, asked: Asked, matrix: np.ndarray, some: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, fan_most: int) -> None:
        column = asked.column[term]
        common = column >= 0
        self.matrix, self.some = matrix, some
        self.held = np.zeros((rows, asked.width))
        self.held[doc[common], column[common]] = value[common]
        self.rest = np.zeros((len(some), rows))
        #: Errors of rough sums are a share of them only where nothing is taken away.
        self.positive = not len(value) or value.min() >= 0
        doc, term, value = doc[~common], term[~common], value[~common]
        place = None if len(some) == len(matrix) else np.full(len(asked.ids), -1)
        if place is not None:
            place[some] = np.arange(len(some))
        fans = asked.first[term + 1] - asked.first[term]
        reach = np.cumsum(fans)
        cuts = np.unique(np.searchsorted(reach, np.arange(fan_most, reach[-1] if len(reach) else 0, fan_most)))
        for a, b in zip([0, *cuts], [*cuts, len(fans)], strict=True):
            if a == b:
                continue
            fan = fans[a:b]
            ends = np.cumsum(fan)
            owner = asked.owner[np.repeat(asked.first[term[a:b]] - (ends - fan), fan) + np.arange(ends[-1])]
            spot, part = np.repeat(doc[a:b], fan), np.repeat(value[a:b], fan)
            if place is not None:
                owner = place[owner]
                real = owner >= 0
                owner, spot, part = owner[real], spot[real], part[real]
            self.rest += np.bincount(owner.astype(np.int64) * rows + spot, part, len(some) * rows).reshape(self.rest.shape)

    def rough(self) -> np.ndarray:
        """All sums, with common terms added in single precision."""
        asks = self.matrix if len(self.some) == len(self.matrix) else self.matrix[self.some]
        return asks @ self.held.T.astype(np.float32) + self.rest

    def whole(self) -> np.ndarray:
        out = self.rest.copy()
        for a in range(0, len(self.some), ANEW):
            out[a : a + ANEW] += self.matrix[self.some[a : a + ANEW]].astype(np.float64) @ self.held.T
        return out

    def of_pairs(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The sums of the pairs of these places; q are places in some."""
        if len(q) * FEW > self.rest.size:
            return self.whole()[q, c]
        out = self.rest[q, c]
        for a in range(0, len(q), ANEW):
            out[a : a + ANEW] += (self.held[c[a : a + ANEW]] * self.matrix[self.some[q[a : a + ANEW]]]).sum(1)
        return out


def match_terms(lists: DataFrame, sent: Broadcast, schema: T.StructType, keep: int | None, parts: Parts, final: Final | None = None, every: bool = False) -> DataFrame:
    """Scores above 0 of phrasings (item_id, pos, terms, others) that share a term with a question; with ``every`` those of all pairs.

    In a block each term has a largest part, and a question can get no more than the sum of those of its terms. Without a
    final step, questions whose sum can't reach their threshold leave the block out.
    """
    fan_most = FAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = sent.value
        known, matrix, limits = len(asked.terms), asked.matrix(), Thresholds(len(asked.ids), keep)
        top = np.ones(len(asked.ids))  # of each question the highest score so far, or 1
        for part, doc, term, times in _looked_up(asked, batches):
            value = parts(asked, part, doc, term, times)
            some = np.arange(len(asked.ids))
            if final is None:
                most = np.zeros(known)
                np.maximum.at(most, term, value)
                bound = np.bincount(asked.owner, most[asked.term], len(some))
                some = np.flatnonzero((bound > 0) & (bound >= limits.least))
            if not len(some) or not (len(term) or every):
                continue
            sums = Sums(asked, matrix, some, doc, term, value, part.num_rows, fan_most)
            rough = keep is not None and sums.positive
            score = sums.rough() if rough else sums.whole()
            score = score if final is None else final(asked, part, some[:, None], np.arange(part.num_rows), score)
            top[some] = np.maximum(top[some], score.max(1))
            coded = part.column(0).dictionary_encode()
            stay = limits.survivors(score, coded.indices.to_numpy(), some, coded.dictionary.to_pylist(), ROUGH * top[some] if rough else 0.0)
            q, c = np.nonzero(stay if every else stay & (score > 0))
            if len(q):
                of_pairs = score[q, c]
                if rough:
                    of_pairs = sums.of_pairs(q, c)
                    of_pairs = of_pairs if final is None else final(asked, part, some[q], c, of_pairs)
                yield emitted(asked.ids, part, some[q], c, of_pairs)

    return lists.mapInArrow(run, schema)


def _looked_up(asked: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of ROW_BLOCK phrasings with their matches: phrasing, term, times. Terms are looked up for many blocks at once."""
    known = max(len(asked.terms), 1)
    for batch in batches:
        for start in range(0, batch.num_rows if len(asked.ids) else 0, LOOKED_UP):
            rows = batch.slice(start, LOOKED_UP)
            ends = np.cumsum(pc.fill_null(rows.column(2).value_lengths(), 0).to_numpy())
            at = pc.fill_null(pc.index_in(rows.column(2).flatten(), value_set=asked.terms), -1).to_numpy()
            for first in range(0, rows.num_rows, ROW_BLOCK):
                part = rows.slice(first, ROW_BLOCK)
                before = ends[first - 1] if first else 0
                here = ends[first : first + ROW_BLOCK]
                found = at[before : here[-1]]
                doc = np.repeat(np.arange(part.num_rows), np.diff(here, prepend=before))[found >= 0]
                packed, times = np.unique(doc * known + found[found >= 0], return_counts=True)
                yield part, *np.divmod(packed, known), times
