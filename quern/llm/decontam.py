"""Benchmark decontamination by fingerprints of item-sized windows.

Each benchmark item, and each window of a document with as many words, is a bag of word shingles
with a SimHash of 256 bits. Fingerprints are cut into RADIUS + 1 blocks; two that differ in at most
RADIUS bits agree in a block, so looking items up block by block finds all of them. What lies within
the radius is verified by the exact weighted Jaccard similarity of the two bags (sum of smaller over
sum of larger counts). A window that shares no shingle with an item has similarity 0, so only windows
around shared shingles get fingerprints; all their starts are tried.

Items are the stated query set: they are sent to the workers in blocks of at most ``block_bytes`` of
text, however many there are, and the documents are read once per block and never shuffled.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; shingles have five words,
those of a shorter item as many as it has.

Defined results: null or empty texts and items match nothing; a document shorter than an item is one
window; whole texts of any length are read; equal items each get their rows; rows with a null key
are dropped; repeated document rows give repeated result rows; empty tables give an empty result;
other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, map_batches, slabs, with_text
from quern.llm.wordhash import ALNUM, LOWER, mix, spans, windows, word_hashes

SHINGLE = 5
BITS = 256
#: Shingle bags at similarity 0.8 differ in about 39 of 256 bits, small bags in about 51 (deviation 6.4).
RADIUS = 90
#: Text of the items that a worker holds at once; their index takes about six times as much.
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, first_word long, n_words long, hamming int, similarity double"


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 per shingle and bit."""
    with np.errstate(over="ignore"):
        parts = [mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(BITS // 64)]
    raw = np.stack(parts, axis=1).astype("<u8").view(np.uint8).reshape(len(hashes), -1)
    return np.unpackbits(raw, axis=1).astype(np.int32) * 2 - 1


def _blocks() -> list[tuple[int, int]]:
    """RADIUS + 1 runs of bits, as even as can be."""
    edges = np.linspace(0, BITS, RADIUS + 2).astype(int).tolist()
    return list(zip(edges, edges[1:], strict=False))


def _block_values(prints: np.ndarray) -> np.ndarray:
    """The number in each block of each fingerprint (bits as 0 and 1)."""
    return np.stack([prints[:, a:b] @ (1 << np.arange(b - a, dtype=np.uint8)) for a, b in _blocks()], axis=1)


@dataclass
class Index:
    """Items of one block as arrays: bags one after another, fingerprints, and all shingles with their items."""

    ids: np.ndarray
    sizes: np.ndarray
    bag_at: np.ndarray  # places of each item's shingles in the next two
    bag_values: np.ndarray
    bag_counts: np.ndarray
    prints: np.ndarray  # a row of bits per item
    values: np.ndarray  # a row of block values per item
    shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # shingle size -> sorted hashes, places, items, filter

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> Index:
        ids, sizes, bags, prints = [], [], [], []
        for item, text in items:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends = spans(data, np.array([0, len(data)]), ALNUM)
            n = len(starts)
            if not n:
                continue
            hashes = windows(word_hashes(data, starts, ends), min(SHINGLE, n))
            ids.append(item)
            sizes.append(n)
            bags.append(np.unique(hashes, return_counts=True))
            prints.append(_signs(hashes).sum(0) >= 0)
        counts = np.array([len(v) for v, _ in bags], np.int64)
        values = np.concatenate([np.zeros(0, np.uint64), *(v for v, _ in bags)])
        owner = np.repeat(np.arange(len(bags), dtype=np.int32), counts)
        width = np.repeat(np.minimum(np.array(sizes, np.int64), SHINGLE), counts)
        shingles = {}
        for size in np.unique(width).tolist():
            mine = np.flatnonzero(width == size)
            mine = mine[np.argsort(values[mine], kind="stable")]
            keys, first = np.unique(values[mine], return_index=True)
            quick = np.zeros(1 << 20, bool)
            quick[(keys >> np.uint64(44)).astype(np.int64)] = True
            shingles[size] = (keys, np.append(first, len(mine)), owner[mine], quick)
        bits = np.array(prints, np.uint8).reshape(len(ids), BITS)
        return cls(
            np.array(ids, np.int64), np.array(sizes, np.int64), np.append(0, np.cumsum(counts)), values, np.concatenate([np.zeros(0, np.int32), *(c.astype(np.int32) for _, c in bags)]),
            bits, _block_values(bits), shingles,
        )

    def near(self, items: list[int], sums: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, item, distance) within the radius, by the blocks; sums are the windows' signed bit sums."""
        own = (sums >= 0).astype(np.uint8)
        values, out = _block_values(own), []
        for item in items:
            some = np.flatnonzero((values == self.values[item]).any(axis=1))
            apart = (own[some] != self.prints[item]).sum(1)
            out += [(int(w), item, int(d)) for w, d in zip(some[apart <= RADIUS], apart[apart <= RADIUS], strict=True)]
        return out

    def similarity(self, item: int, hashes: np.ndarray) -> float:
        a, b = self.bag_at[item : item + 2]
        bag, held = self.bag_values[a:b], self.bag_counts[a:b]
        values, counts = np.unique(hashes, return_counts=True)
        at = np.minimum(np.searchsorted(bag, values), len(bag) - 1)
        shared = int(np.minimum(counts, held[at])[bag[at] == values].sum())
        return shared / (len(hashes) + int(held.sum()) - shared)

    def match(self, words: np.ndarray, hits: dict[int, list[tuple[int, np.ndarray]]], threshold: float) -> dict[int, tuple[float, int, int, int]]:
        """Item to (similarity, first word, words, distance) of its best window; hits: shingle size to (place, items)."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, spots in hits.items():
            hashes = windows(words, size)
            tried: dict[int, set[int]] = defaultdict(set)
            sharing: dict[int, set[int]] = defaultdict(set)  # items of a size that share a shingle with the document
            for place, items in spots:
                for k in items:
                    sharing[int(self.sizes[k])].add(int(k))
                for n in set(self.sizes[items].tolist()):
                    wide = min(n, len(words))
                    tried[n].update(range(max(0, place - wide + size), min(place, len(words) - wide) + 1))
            if not tried:
                continue
            for n, starts in tried.items():
                many = min(n, len(words)) - size + 1  # shingles of a window
                order = np.array(sorted(starts))
                # Windows near each other share their bit sums; far apart ones are summed in stretches.
                for part in np.split(order, np.flatnonzero(np.diff(order) > many) + 1):
                    low = int(part[0])
                    sums = np.zeros((int(part[-1]) - low + many + 1, BITS), np.int32)
                    np.cumsum(_signs(hashes[low : int(part[-1]) + many]), axis=0, out=sums[1:])
                    for w, item, apart in self.near(sorted(sharing[n]), sums[part - low + many] - sums[part - low]):
                        first = int(part[w])
                        similar = self.similarity(item, hashes[first : first + many])
                        if similar >= threshold and (item not in best or (-similar, first) < (-best[item][0], best[item][1])):
                            best[item] = (similar, first, many + size - 1, apart)
        return best


def _scan(index: Index, keys: list, column: pa.Array, threshold: float) -> list[tuple]:
    rows = []
    for first_row, _, offsets, data in slabs(column):
        low = LOWER[data]
        starts, ends = spans(low, offsets, ALNUM)
        words = word_hashes(low, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        hits: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for size, (known, begin, owners, quick) in index.shingles.items():
            runs = windows(words, size)
            maybe = np.flatnonzero(quick[(runs >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, runs[maybe]), len(known) - 1)
            sure = known[at] == runs[maybe]
            maybe, at = maybe[sure], at[sure]
            text = np.searchsorted(bounds, maybe, "right") - 1
            inside = maybe + size <= bounds[text + 1]
            for p, a, t in zip(maybe[inside].tolist(), at[inside].tolist(), text[inside].tolist(), strict=True):
                hits[t][size].append((p - int(bounds[t]), owners[begin[a] : begin[a + 1]]))
        for t, found in hits.items():
            for item, (similar, first, n, apart) in index.match(words[bounds[t] : bounds[t + 1]], found, threshold).items():
                rows.append((keys[first_row + t], int(index.ids[item]), first, n, apart, similar))
    return rows


def _blocks_of_items(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total * 2 // block_bytes)) if total > block_bytes else 1
    if count == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)) == k) for k in range(count)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and item with a window of similarity threshold or more: the best window and its figures."""
    rows = with_text(docs, key, text).where("doc_id is not null and text is not null")
    items = with_text(benchmark, item_key, item_text).where("doc_id is not null and text is not null")
    context = docs.sparkSession.sparkContext

    def scan(block: DataFrame) -> tuple[DataFrame, Broadcast]:
        # At most block_bytes of text: the check above this call.
        sent = context.broadcast(Index.build(sorted((r[0], r[1]) for r in block.collect())))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = _scan(sent.value, batch.column(0).to_pylist(), batch.column(1), threshold)
            if not found:
                return None
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        return map_batches(rows, run, SCHEMA), sent

    parts = _blocks_of_items(items, block_bytes)
    if len(parts) == 1:
        return scan(parts[0])[0]
    # One block of items is held at a time; what it finds is kept before the next is read.
    scratch, done = Scratch(docs.sparkSession, "leaks"), []
    for block in parts:
        found, sent = scan(block)
        done.append(scratch.keep(found))
        sent.unpersist()
    return reduce(DataFrame.unionByName, done)
