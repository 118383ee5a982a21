"""Ranked lexical search by sort-based accumulation.

The items' terms, as 64-bit hashes, go out in blocks of bounded size. A pass over the texts
keeps, per document, how many terms it has and which of the block's terms it holds how often; a document
without a term isn't one of the counts. Document frequencies, the number of documents and of terms come from
that table. Then each task concatenates (item, document, impact) of all matched postings of a range of
documents, sorts the packed keys by radix, sums impacts by reduceat, and keeps the best documents of
each item in a heap. A document lies in one range, so its sums are whole. What leaves a task is at
most k rows an item; the last selection ranks those.

Scores are whole numbers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is
100 - B + (B n N) div L, and a posting's impact is weight * ((10^9 tf) div (1000 tf + 8 m)).

Defined results: terms are those of whole texts; a null text, or one without terms, is no document; rows with a
null key are left out, of documents as of items; rows of one item_id are one item with the terms of
all; repeated documents count and rank each for itself, equal scores by ascending key; an item without
a term of the corpus gets no row; empty tables give no rows; other columns are not read.
Two different words of the texts that share a 64-bit hash would count as one: for 10^9 different words and 10^6 item terms
the chance of any such pair is 5 in 100,000.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, bounded_batches, give_back, map_batches, slabs, with_text
from quern.llm.wordhash import ALNUM, LOWER, spans, word_hashes

#: Pairs of item and term sent to the workers at once (a few MB); a block holds whole items, one at least.
BLOCK_PAIRS = 1 << 18
#: Matched (item, document, impact) entries that are sorted at once; a document's entries stay together.
CHUNK_ENTRIES = 1 << 20
#: B of a document's m, in percent.
LENGTH_SHARE = 90

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
TOPS = "item_id long, doc_id long, score long"


def _terms(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and where each text's begin."""
    low = LOWER[data]
    starts, ends = spans(low, offsets, ALNUM)
    return word_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of rows (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, own, terms = batch.column(0).to_numpy(), [], []
        for first, _, offsets, data in slabs(batch.column(1)):
            hashes, bounds = _terms(offsets, data)
            own.append(np.repeat(keys[first : first + len(bounds) - 1], np.diff(bounds)))
            terms.append(hashes.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(terms))], ["item_id", "term"])

    return map_batches(items, run, "item_id long, term long").distinct()


class Block:
    """Items and their terms: for each term, in ascending order of hashes, the items that have it."""

    def __init__(self, items: np.ndarray, terms: np.ndarray) -> None:
        self.ids, owner = np.unique(items, return_inverse=True)
        self.vocabulary, at = np.unique(terms.view(np.uint64), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.owner = owner[order].astype(np.int64)
        self.first = np.append(0, np.cumsum(np.bincount(at, minlength=len(self.vocabulary))))
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are terms of the block, and which."""
        maybe = np.flatnonzero(self.quick[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        sure = self.vocabulary[at] == hashes[maybe]
        return maybe[sure], at[sure]


def postings(docs: DataFrame, sent) -> DataFrame:  # noqa: ANN001
    """Per document with a term: its number of terms, and the block's terms that it holds with their occurrences."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, size = sent.value, len(sent.value.vocabulary)
        counts, cuts, terms, tfs = [], [], [], []
        for first, end, offsets, data in slabs(batch.column(1)):
            hashes, bounds = _terms(offsets, data)
            place, term = block.find(hashes)
            doc = np.searchsorted(bounds, place, "right") - 1
            packed, times = np.unique(doc * size + term, return_counts=True)
            counts.append(np.diff(bounds))
            cuts.append(np.diff(np.searchsorted(packed, np.arange(end - first + 1) * size)))
            terms.append(packed % size)
            tfs.append(times)
        n, ends = np.concatenate(counts), np.append(0, np.cumsum(np.concatenate(cuts))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(np.int32))) for x in (terms, tfs)]
        rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
        return rows.filter(pa.array(n > 0))

    return map_batches(docs, run, POSTINGS)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys of 0 and more, a digit of 16 bits at a time (NumPy sorts those by radix)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(keys.max(initial=0)).bit_length(), 16):
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


class Best:
    """The best k documents of each item, in heaps; documents that can't enter are told by two arrays."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.low, self.last = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Scores above 0, each of another document of its item or of an equal row."""
        enters = (score > self.low[item]) | ((score == self.low[item]) & (doc < self.last[item]))
        item, doc, score = item[enters], doc[enters], score[enters]
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        ranks = np.arange(len(item)) - np.searchsorted(item, item)
        some = ranks < self.k
        for i, d, s in zip(item[some].tolist(), doc[some].tolist(), score[some].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -d))
            else:
                heapq.heappushpop(heap, (s, -d))
        for i in np.unique(item[some]).tolist():
            if len(self.heaps[i]) == self.k:
                self.low[i], self.last[i] = self.heaps[i][0][0], -self.heaps[i][0][1]


def accumulate(block: Block, weights: np.ndarray, best: Best, docs: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
    """Add the scores of documents (their m, numbers of postings, and postings one after another) to the best."""
    owner = np.repeat(np.arange(len(docs)), sizes)
    impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner]))
    fan = block.first[terms + 1] - block.first[terms]
    ends = np.append(0, np.cumsum(np.append(0, np.cumsum(fan))[np.cumsum(sizes)] - np.append(0, np.cumsum(fan))[np.cumsum(sizes) - sizes]))
    a = 0
    while a < len(docs):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK_ENTRIES, "right")) - 1)
        some = slice(int(sizes[:a].sum()), int(sizes[:b].sum()))
        each = fan[some]
        total = np.cumsum(each)
        if len(total) and total[-1]:
            spot = np.repeat(block.first[terms[some]] - (total - each), each) + np.arange(total[-1])
            keys = block.owner[spot] * (b - a) + np.repeat(owner[some] - a, each)
            order = radix_order(keys)
            keys = keys[order]
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            score = np.add.reduceat(np.repeat(impact[some], each)[order], begin)
            item, doc = np.divmod(keys[begin], b - a)
            real = score > 0
            best.add(item[real], docs[a + doc[real]], score[real])
        a = b


def tops(found: DataFrame, sent, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:  # noqa: ANN001
    """The best k documents of each item in each task's range of documents."""
    own = found.sparkSession.sparkContext.broadcast(weights)  # a number for each term of the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best = Best(len(block.ids), k)
        for batch in batches:
            docs, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms
            sizes = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            terms, tfs = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            accumulate(block, own.value, best, docs, m, sizes, terms, tfs)
        rows = [(int(block.ids[i]), -d, s) for i, heap in enumerate(best.heaps) for s, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item_id", "doc_id", "score"])
        give_back()

    bounded_batches(found.sparkSession)
    return found.mapInArrow(run, TOPS)


def lexical_topk(docs: DataFrame, items: DataFrame, k: int = 10, block_pairs: int = BLOCK_PAIRS, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lexical")
    rows = with_text(docs, key, text).where("doc_id is not null and text is not null")
    asked = scratch.keep(item_terms(with_text(items, item_key, item_text).where("doc_id is not null and text is not null")))
    count = max(1, -(-asked.count() // block_pairs))
    parts = []
    for b in range(count):
        # About block_pairs pairs of numbers, or one item.
        pairs = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == b).toArrow()
        if not pairs.num_rows:
            continue
        block = Block(pairs["item_id"].to_numpy(), pairs["term"].to_numpy())
        sent = spark.sparkContext.broadcast(block)
        found = scratch.keep(postings(rows, sent))
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # the block's terms at most
        weights = np.zeros(len(block.vocabulary), np.int64)
        for t, df in zip(held["term"].to_pylist(), held["df"].to_pylist(), strict=True):
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        parts.append(scratch.keep(tops(found, sent, weights, n_docs, max(1, n_terms), k)))
        scratch.drop(found)
        sent.unpersist()
    best = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], TOPS)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
