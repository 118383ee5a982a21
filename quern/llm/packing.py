"""Token sequences of several context sizes with next to no padding.

Documents become ids, each with an end id. A document longer than the largest context gives whole
windows of it; what is left, and every shorter document, is routed to a tier: the smallest context
that holds it. Tiers are packed from the longest down: a piece opens a sequence of its tier's
context, and the gap is filled with the longest pieces of shorter tiers that fit. Only where no
whole piece fits is one cut, the longest, whose rest is routed anew; so every sequence is full. The
rest of a task, less than one window, becomes sequences of smaller powers of two, full as well.

A task packs the documents of its own partition, a bounded pool of tokens at a time, so no text
or id moves; only pieces' places are written. Sequences are then numbered without gaps, by tier and
part, from the counts of each part. Step groups hold sequences of one tier and about the same number
of tokens; of each tier they differ by one sequence at most, and the tiers are spread
evenly over the order of steps by arithmetic on the tiers' totals.

Defined results: a null or empty text is a document of the end id alone; rows with a null key and
repeated rows are documents of their own; an empty table gives no pieces; a text of any length is
encoded and cut whole; other columns are not read. Which documents share a sequence follows
the partitions of the table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, bounded_batches, give_back, slabs, with_text
from quern.llm.simple8b import coder_of

#: Context sizes, each half of the one before.
TIERS = (4096, 2048, 1024, 512, 256)
#: Tokens that a task gathers before it packs them (4 bytes each).
POOL_TOKENS = 1 << 20
#: Tokens of a step group: 64 sequences of the largest tier.
STEP_TOKENS = 1 << 18

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, context int, nth long, offset long"

#: A part of a document: its number in the task's memory, its first id and its length.
Piece = tuple[int, int, int]


class Pool:
    """Pieces of at most one window, found by their length."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths: list[int] = []  # ascending, those in use

    def put(self, piece: Piece) -> None:
        if piece[2] not in self.by_length:
            self.by_length[piece[2]] = []
            insort(self.lengths, piece[2])
        self.by_length[piece[2]].append(piece)

    def longest(self, limit: int) -> int:
        """The length of the longest piece of at most limit ids, 0 without one."""
        k = bisect_right(self.lengths, limit)
        return self.lengths[k - 1] if k else 0

    def take(self, length: int) -> Piece:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
            self.lengths.remove(length)
        return piece

    def rest(self) -> list[Piece]:
        return [p for n in reversed(self.lengths) for p in self.by_length[n]]


def fill(pool: Pool, head: int, size: int) -> tuple[list[Piece], int]:
    """A sequence of the given size, opened by a piece of head ids, and the gap that is left when the pool is empty."""
    sequence, gap = [pool.take(head)], size - head
    while gap:
        if fits := pool.longest(gap):
            sequence.append(pool.take(fits))
            gap -= fits
        elif longer := pool.longest(size):
            number, start, length = pool.take(longer)
            sequence.append((number, start, gap))
            pool.put((number, start + gap, length - gap))
            gap = 0
        else:
            break
    return sequence, gap


def pack_tiers(pool: Pool, tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full sequences as (size, pieces), and the pieces left, less than a window together."""
    done: list[tuple[int, list[Piece]]] = []
    for size, below in zip(tiers, (*tiers[1:], 0), strict=True):
        while (head := pool.longest(size)) > below:
            sequence, gap = fill(pool, head, size)
            if gap:
                return done, sequence
            done.append((size, sequence))
    return done, []


def powers(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The pieces as full sequences of descending powers of two: the binary digits of their total."""
    total = sum(p[2] for p in pieces)
    todo, out = list(reversed(pieces)), []
    for bit in range(total.bit_length() - 1, -1, -1):
        size = total & (1 << bit)
        sequence: list[Piece] = []
        while size:
            number, start, length = todo.pop()
            own = min(length, size)
            sequence.append((number, start, own))
            size -= own
            if length > own:
                todo.append((number, start + own, length - own))
        if sequence:
            out.append((1 << bit, sequence))
    return out


class Packer:
    """The pieces of one task: gathers documents, packs a pool when it is full, and carries what is left."""

    def __init__(self, tiers: tuple[int, ...], pool_tokens: int) -> None:
        self.tiers, self.pool_tokens = tiers, pool_tokens
        self.pool, self.held = Pool(), 0
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.made: Counter[int] = Counter()
        self.rows: list[tuple] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        number, window = len(self.docs), self.tiers[0]
        self.docs.append((key, ids))
        whole = len(ids) // window * window
        for start in range(0, whole, window):
            self._emit(window, [(number, start, window)])
        if whole < len(ids):
            self.pool.put((number, whole, len(ids) - whole))
        self.held += len(ids)
        if self.held >= self.pool_tokens:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        done, left = pack_tiers(self.pool, self.tiers)
        for size, sequence in done + (powers(left) if last else []):
            self._emit(size, sequence)
        self.pool, self.held, old, self.docs = Pool(), 0, self.docs, []
        for number, start, length in [] if last else left:
            self.pool.put((len(self.docs), start, length))
            self.docs.append(old[number])
            self.held += length

    def _emit(self, size: int, sequence: list[Piece]) -> None:
        nth, offset = self.made[size], 0
        self.made[size] += 1
        for number, start, length in sequence:
            key, ids = self.docs[number]
            self.rows.append((key, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), size, nth, offset))
            offset += length

    def batch(self, part: int) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True))
        columns.insert(5, [part] * len(self.rows))
        self.rows = []
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with their place in a sequence: the nth of a context size in its part."""
    with open(tokenizer_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # a file of a few MB, read once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, packer = coder_of(sent.value), TaskContext.get().partitionId(), Packer(tiers, pool_tokens)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, end, offsets, data in slabs(batch.column(1)):
                ids, count = coder.encode(offsets, data)
                ids = np.insert(ids.astype("<u4"), np.cumsum(count), end_id)
                ends = np.cumsum(count + 1)
                for k, own in zip(keys[first:end], np.split(ids, ends[:-1]), strict=True):
                    packer.add(k, own)
            if packer.rows:
                yield packer.batch(part)
        packer.flush(last=True)
        if packer.rows:
            yield packer.batch(part)
        give_back()

    bounded_batches(docs.sparkSession)
    return with_text(docs, key, text).mapInArrow(run, PIECES)


def _step(totals: dict[int, int], step_tokens: int) -> Column:
    """The step of a sequence, by its quern_number in its tier.

    A tier of n sequences has j = ceil(n * size / step_tokens) steps of n / j sequences. The steps of all tiers stand in the
    order of (own place + 1/2) / j, larger contexts first where these are equal; a step's rank counts the steps before it.
    """
    steps = {size: -(-n * size // step_tokens) for size, n in totals.items()}
    step = F.lit(None).cast("long")
    for size, j in steps.items():
        own = f"((quern_number * {j}L) div {totals[size]}L)"
        before = [f"((2L * {own} + 1L) * {i}L + {j if other > size else j - 1}L) div {2 * j}L" for other, i in steps.items()]
        step = F.when(F.col("context") == size, F.expr(" + ".join(before))).otherwise(step)
    return step


def number_sequences(scratch: Scratch, pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces (a kept table) with sequence_id, dense from 0 by descending context, and step."""
    counts = scratch.keep(pieces.groupBy("part", "context").agg((F.max("nth") + 1).alias("n")))
    # A row per power of two up to the largest context.
    totals = {r.context: r.n for r in counts.groupBy("context").agg(F.sum("n").alias("n")).orderBy(F.desc("context")).collect()}
    base, bases = 0, F.lit(0).cast("long")
    for size, n in totals.items():
        bases = F.when(F.col("context") == size, F.lit(base).cast("long")).otherwise(bases)
        base += n
    before = Window.partitionBy("context").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "context", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("quern_before"))
    placed = pieces.join(starts, ["part", "context"]).withColumn("quern_number", F.col("quern_before") + F.col("nth"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (bases + F.col("quern_number")).alias("sequence_id"), "offset", "context",
        _step(totals, step_tokens).alias("step"),
    )


def pack_sequences(docs: DataFrame, tokenizer_path: str, end_id: int, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context and step."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(cut_pieces(docs, tokenizer_path, end_id, tiers, pool_tokens, key, text))
    return number_sequences(scratch, pieces, step_tokens)
