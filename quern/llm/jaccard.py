"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams (by hash) is cut into fragments, and what a pair of sets has in common is
counted fragment by fragment and summed per pair, for candidates as for their verification.

Candidates: two sets that link differ in at most D n-grams, D following from the larger size. In more
than D fragments one at least holds the same n-grams of both, so a set gives the hash of its n-grams
in each fragment, and sets that agree in a fragment are listed under that hash. The cuts depend on
the class of sizes that the larger set belongs to; a set gives hashes for its own class and the next,
as sets of other classes are too long or too short for a link. Empty fragments agree without meaning
anything: they are left out, a class has ``spare`` fragments for them, and sets with more empty ones
are also listed under their first n-grams of the order, of which two linked sets share one.

Verification: the n-grams of both sets in each quarter of the order are intersected, and the partial
overlaps are summed per pair. Only pairs that parity bits (a lower bound of how many n-grams stand in one
set only) allow are counted. Counted first is, per set, the pair with that smallest member of a list with
which most fragments agree. What is still in several components goes on: lists with one component or the
members of another list are left out, and each list gives a forest, over components, of the pairs that its
parity bits allow, and the members that have such a pair. When the forests are counted and what links is
joined, the whole sets of those members are compared in their lists, as far as they still are in several
components, and a forest of the links leaves each list. So every link between different components is found,
and no step writes the pairs of a group.

Equal sets are one node. Lists are compared block against block. A list of more than LONG rows, such as that of many texts with
one sentence in common, would take a number of blocks that grows with its square: its members are listed anew, under the first n-grams
of each in an order by how often n-grams occur among them (rare ones first), of which two linked sets share one.
What they all have in common comes last there, and lists nobody. Frequencies are counted in a fixed number of buckets; any
order that is the same for all sets finds all links.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; a text of fewer words than n has one n-gram; keys are expected to be unique, repeated equal
rows give equal result rows, rows with a null key are dropped; texts of any length are read whole;
an empty table gives an empty result; other columns are neither read nor returned. Sets are
compared by 64-bit hashes of their n-grams; equality of sets by 128-bit sums over them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, give_back, map_batches, prefiltered, slabs, with_text, without_ids
from quern.llm.components import connected_components
from quern.llm.wordhash import LOWER, NOT_SPACE, mix, shingle_sets

#: Fewest and most parity bits of a set; between them it has the next power of two from FINE times its size up.
LEAST_BITS, MOST_BITS, FINE = 256, 1 << 14, 1
#: Rows of a list that are compared with one another at once, by parity bits and by whole sets.
LIST_BLOCK, SET_BLOCK = 1000, 200
#: Rows of a list beyond which its members are listed by their rarest n-grams, and buckets in which those are counted (8 MB).
LONG, BUCKETS = 4000, 1 << 20
#: Rows of numbers in an Arrow batch, and rows with parity bits.
NUMBERS, BITS_ROWS = 20_000, 4_000
#: Distinct n-grams counted in one product of matrices.
COLUMNS = 4096
#: Cuts of the order for verification.
QUARTERS = 4
#: Largest over smallest size of a class: wide ones need hashes of a second class less often, narrow ones fewer fragments.
CLASS_RATIO = 1.5


@dataclass(frozen=True)
class Threshold:
    """size-word shingles; sets link at percent of their union or more."""

    size: int = 4
    percent: int = 85

    def prefix(self, n: int) -> int:
        """How many first n-grams of a set of n hold one in common with every partner."""
        return n - -(-self.percent * n // 100) + 1

    def may_link(self, n: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Matrix of pairs that n-grams in one set only (at least apart) leave possible; apart exact: that link."""
        total = n[:, None] + n[None, :]
        least = -(-self.percent * total // (100 + self.percent))
        lengths = 100 * np.minimum(n[:, None], n[None, :]) >= self.percent * np.maximum(n[:, None], n[None, :])
        return lengths & (apart <= total - 2 * least)


@dataclass(frozen=True)
class SizeClass:
    """Sets of start to stop - 1 n-grams; those linked with one of them have least or more."""

    start: int
    stop: int
    least: int
    fragments: int
    spare: int


@lru_cache(maxsize=4)
def _classes(percent: int, upto: int) -> list[SizeClass]:
    """Classes of which only neighbours can be linked, until one holds upto."""
    out, start = [], 1
    while not out or out[-1].stop <= upto:
        stop = max(start + 1, -(-100 * start // percent), ceil(start * CLASS_RATIO))
        least = -(-percent * start // 100)
        apart = 2 * (stop - 1) * (100 - percent) // (100 + percent)
        spare = 0
        for _ in range(8):  # the mean of the empty ones of a set of the least size, and a deviation more
            empty = (apart + 1 + spare) * exp(-least / (apart + 1 + spare))
            spare = min(1 + ceil(empty + sqrt(empty)), apart + 2)
        out.append(SizeClass(start, stop, least, apart + 1 + spare if apart else 0, spare))
        start = stop
    return out


def fragment_hashes(sets: list[np.ndarray], rule: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(set, hash) of each filled fragment of each set, for its own class of sizes and the next, by set."""
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    sizes = np.array([len(s) for s in sets], np.int64)
    # Few different bounds, so few tables.
    classes = _classes(rule.percent, 1 << max(10, int(sizes.max(initial=0)).bit_length() + 1))
    starts, least, fragments, spares = (np.array([getattr(c, name) for c in classes]) for name in ("start", "least", "fragments", "spare"))
    for step in (0, 1):
        number = np.searchsorted(starts, sizes, "right") - 1 + step
        which = np.flatnonzero((sizes > 0) & (fragments[number] > 0) & (sizes >= least[number]))
        if not len(which):
            continue
        number = number[which]
        pieces, spare = fragments[number], spares[number]
        grams = np.concatenate([sets[k] for k in which])
        row = np.repeat(np.arange(len(which)), sizes[which])
        piece = ((grams >> np.uint64(11)).astype(np.float64) * (pieces[row] / float(1 << 53))).astype(np.int64)
        fresh = np.append(True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]))
        at = np.flatnonzero(fresh)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(grams + np.uint64(0x2545F4914F6CDD1D)), at)
            named = mix((piece[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + number[row[at]].astype(np.uint64))
            owners.append(which[row[at]])
            hashes.append(mix(sums + named))
            empty = pieces - np.bincount(row[at], minlength=len(which))
            for r in np.flatnonzero(empty > spare).tolist():
                first = sets[which[r]][: rule.prefix(int(sizes[which[r]]))]
                owners.append(np.full(len(first), which[r]))
                hashes.append(mix(first * np.uint64(3) + np.uint64(int(number[r]) + 1)))
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return owner[order], found[order]


def fragment_lists(docs: DataFrame, rule: Threshold) -> DataFrame:
    """doc_id, n, a 128-bit sum, and the hashes of the fragments of each set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, one, two, counts, hashes = [], [], [], [], []
        for _, _, offsets, data in slabs(batch.column(1)):
            sets = shingle_sets(LOWER[data], offsets, NOT_SPACE, rule.size)
            with np.errstate(over="ignore"):
                for grams in sets:
                    n.append(len(grams))
                    one.append(mix(grams + np.uint64(1)).sum())
                    two.append(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum())
            owner, found = fragment_hashes(sets, rule)
            counts.append(np.bincount(owner, minlength=len(sets)))
            hashes.append(found.view(np.int64))
        ends = np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int32) if counts else np.zeros(1, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)))
        sums = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), *sums, lists], ["doc_id", "n", "sum1", "sum2", "hashes"])

    return map_batches(docs, run, "doc_id long, n int, sum1 long, sum2 long, hashes array<long>")


def shared_lists(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """hash, doc_id and the smallest doc_id of its list (the hub), for lists of two members and more; kept.

    Rows are sorted over ranges of (hash, doc_id), so that a long list may span parts. One pass over a part gives its lists, and a mark for its
    first and its last one, by which those that span parts are put together.
    """
    rows = postings.repartitionByRange("hash", "doc_id").sortWithinPartitions("hash", "doc_id")

    def batch_of(key: np.ndarray, doc: np.ndarray, hub: np.ndarray, mark: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(hub), pa.array(np.full(len(key), mark, np.int32))], ["hash", "doc_id", "hub", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The list at the end of the rows so far: its hash, first and last member, and whether its first row is out.
        held: tuple[int, int, int, bool] | None = None
        # The first list: its hash, first member and length.
        first: tuple[int, int, int] | None = None
        for batch in batches:
            key, doc = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(key):
                continue
            same = np.append(False, (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]))
            if held and (key[0], doc[0]) == (held[0], held[2]):
                same[0] = True
            last = int(doc[-1])
            key, doc = key[~same], doc[~same]
            if first is None:
                first = (int(key[0]), int(doc[0]), 0)
            first = (first[0], first[1], first[2] + int((key == first[0]).sum()))
            if held:
                key, doc = np.append(held[0], key), np.append(held[1], doc)
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            length = np.diff(np.append(begin, len(key)))
            hub = np.repeat(doc[begin], length)
            keep = np.repeat(length > 1, length)
            out = bool(held and held[3])
            if out:
                keep[0] = False
            held = (int(key[-1]), int(hub[-1]), last, bool(length[-1] > 1 or (len(begin) == 1 and out)))
            if keep.any():
                yield batch_of(key[keep], doc[keep], hub[keep], 0)
        if held:
            ends = {first[0]: (first[1], first[2] == 1), held[0]: (held[1], not held[3])}
            for name, (member, alone) in ends.items():
                yield batch_of(*(np.array([x]) for x in (name, member, member)), 1 + alone)
        give_back()

    found = rows.select("hash", "doc_id").mapInArrow(run, "hash long, doc_id long, hub long, mark int").withColumn("part", F.spark_partition_id())
    made = scratch.keep(found, batch_rows=NUMBERS)
    # Two rows of a part at most.
    spanning = F.broadcast(made.where("mark > 0").groupBy("hash").agg(F.min("hub").alias("least"), F.countDistinct("part").alias("parts")).where("parts > 1"))
    inner = made.where("mark = 0").join(spanning, "hash", "left").select("hash", "doc_id", F.coalesce("least", "hub").alias("hub"))
    # The only row of its list in its part.
    alone = made.where("mark = 2").join(spanning, "hash").select("hash", "doc_id", F.col("least").alias("hub"))
    return scratch.keep(inner.unionByName(alone), batch_rows=NUMBERS)


def rare_lists(docs: DataFrame, wanted: DataFrame, rule: Threshold) -> DataFrame:
    """hash and doc_id: the wanted documents under their first n-grams, rare ones first."""
    texts = prefiltered(docs, wanted)[0].select("doc_id", "text")

    def sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [s for _, _, offsets, data in slabs(batch.column(1)) for s in shingle_sets(LOWER[data], offsets, NOT_SPACE, rule.size)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            if sets := sets_of(batch):
                total += np.bincount((np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
        give_back()

    # A row per bucket at most.
    found = texts.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[found["bucket"].to_numpy()] = found["n"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owners, grams = batch.column(0).to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for key, s in zip(keys.tolist(), sets_of(batch), strict=True):
            if not len(s):
                continue
            first = s[np.lexsort((s, sent.value[(s % np.uint64(BUCKETS)).astype(np.int64)]))[: rule.prefix(len(s))]]
            owners.append(np.full(len(first), key))
            grams.append(first)
        return pa.RecordBatch.from_arrays([pa.array(mix(np.concatenate(grams) ^ np.uint64(0x9FB21C651E98DF25)).view(np.int64)), pa.array(np.concatenate(owners))], ["hash", "doc_id"])

    return map_batches(texts, run, "hash long, doc_id long")


def _parity(grams: np.ndarray) -> bytes:
    """Of each residue of the hashes whether it has an odd number of n-grams."""
    wide = min(MOST_BITS, max(LEAST_BITS, 1 << max(FINE * len(grams) - 1, 0).bit_length()))
    parity = np.bincount((grams & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def _of_texts(docs: DataFrame, wanted: DataFrame, rule: Threshold, column: str, make: Callable[[list[np.ndarray]], pa.Array]) -> DataFrame:
    """doc_id, n and what make gives of the sets, a row each, at least of the wanted documents: a bit filter picks the texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s for _, _, offsets, data in slabs(batch.column(1)) for s in shingle_sets(LOWER[data], offsets, NOT_SPACE, rule.size)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), make(sets)], ["doc_id", "n", column.split()[0]])

    made = map_batches(prefiltered(docs, wanted)[0].select("doc_id", "text"), run, f"doc_id long, n int, {column}")
    return made.dropDuplicates(["doc_id"])


def set_bits(docs: DataFrame, wanted: DataFrame, rule: Threshold) -> DataFrame:
    """doc_id, n and parity bits of sets."""
    return _of_texts(docs, wanted, rule, "bits binary", lambda sets: pa.array([_parity(s) for s in sets], pa.binary()))


def whole_sets(docs: DataFrame, wanted: DataFrame, rule: Threshold) -> DataFrame:
    """doc_id, n and the n-grams of sets in each quarter of the order."""
    cuts = np.arange(1, QUARTERS, dtype=np.uint64) * np.uint64((1 << 64) // QUARTERS)

    def quarters(sets: list[np.ndarray]) -> pa.Array:
        ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)
        inner = np.concatenate([np.zeros(1, np.int64), *(np.append(np.searchsorted(s, cuts), len(s)) + e for s, e in zip(sets, ends, strict=False))])
        grams = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        parts = pa.ListArray.from_arrays(pa.array(inner.astype(np.int32)), pa.array(grams))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * QUARTERS), parts)

    return _of_texts(docs, wanted, rule, "parts array<array<long>>", quarters)


def allowed_pairs(pairs: DataFrame, info: DataFrame, rule: Threshold) -> DataFrame:
    """Those pairs (a, b) that sizes and parity bits allow to link."""
    one, two = (info.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab")
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = zip(*(batch.column(k).to_numpy().astype(np.int64) for k in (2, 3)), strict=True)
        bits = zip(*(batch.column(k).to_pylist() for k in (4, 5)), strict=True)
        may = [rule.may_link(np.array(n), _apart(list(b)))[0, 1] for n, b in zip(sizes, bits, strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

    return map_batches(both, run, "a long, b long")


def linked_pairs(pairs: DataFrame, docs: DataFrame, rule: Threshold, scratch: Scratch) -> DataFrame:
    """Those pairs (a, b) that link: partial overlaps of each quarter, summed per pair."""
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = scratch.keep(whole_sets(docs, ends, rule))
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.posexplode("parts").alias("quarter", "left"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.posexplode("parts").alias("quarter", "right"))
    joined = pairs.select("a", "b").join(one, "a").join(two, ["b", "quarter"])
    partial = joined.select("a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).alias("partial"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap"))
    found = scratch.keep(summed.where(F.expr(f"{100 + rule.percent} * overlap >= {rule.percent} * (na + nb)")).select("a", "b"))
    scratch.drop(sets)
    return found


def _apart(bits: list[bytes]) -> np.ndarray:
    """Matrix of how many n-grams two sets have apart, at least: parity bits that differ, at the width of the narrower."""
    width = np.array([len(b) for b in bits])
    out = np.zeros((len(bits), len(bits)), np.int64)
    for w in np.unique(width).tolist():
        # Sets of lengths within the threshold differ in width by one step at most; all others fail by length.
        mine = np.flatnonzero((width == w) | (width == 2 * w))
        rows = np.zeros((len(mine), 8 * w), np.float32)
        for k, i in enumerate(mine.tolist()):
            flags = np.unpackbits(np.frombuffer(bits[i], np.uint8))
            rows[k] = flags if len(flags) == 8 * w else flags[: 8 * w] ^ flags[8 * w :]
        ones = rows.sum(1)
        apart = (ones[:, None] + ones[None, :] - 2 * (rows @ rows.T)).astype(np.int64)
        out[np.ix_(mine, mine)] = np.maximum(out[np.ix_(mine, mine)], apart)
    return out


def _exactly_apart(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of how many n-grams two sets have apart."""
    size = np.array([len(s) for s in sets])
    names, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    twice = counts > 1
    place = np.cumsum(twice) - 1
    held = twice[flat]
    row, column = row[held], place[flat[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(twice.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        member = np.zeros((len(sets), COLUMNS), np.float32)
        member[row[a:b], column[a:b] - first] = 1
        both += member @ member.T
    return size[:, None] + size[None, :] - 2 * both.astype(np.int64)


def _forest(may: np.ndarray, component: np.ndarray) -> np.ndarray:
    """A spanning forest, over components, of the pairs that may link."""
    names, label = np.unique(component, return_inverse=True)
    fresh, out = np.ones(len(names), bool), []
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])
    for first in range(len(names)):
        if not fresh[first]:
            continue
        fresh[first] = False
        todo = [first]
        while todo:
            own = members[todo.pop()]
            near = np.flatnonzero(may[own].any(axis=0) & fresh[label])
            for j in near[np.unique(label[near], return_index=True)[1]].tolist():
                fresh[label[j]] = False
                out.append((int(own[np.argmax(may[own, j])]), j))
                todo.append(int(label[j]))
    return np.array(out, np.int64).reshape(-1, 2)


def _block_rows(lists: DataFrame, block: int, last: str) -> DataFrame:
    """hash, p, q, doc_id, n, component and the last column: each row to the blocks that its block of the list (c rows) meets."""
    blocks = F.ceil(F.col("c") / block).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    dealt = lists.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select(
        "hash", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "doc_id", "n", "component", last
    )
    return dealt.repartition("hash", "p", "q").sortWithinPartitions("hash", "p", "q", "doc_id")


def _by_block(rows: DataFrame, found: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Array], list[np.ndarray]], schema: str) -> DataFrame:
    """What found(doc_ids, sizes, components, last column) gives of each block with several components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        left: pa.Table | None = None
        for batch in _and_end(batches):
            table = left if batch is None else pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            keys = [table.column(k).to_numpy() for k in range(3)]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            edges = [0, *new.tolist()]
            if batch is None:
                edges.append(table.num_rows)
            left = None if batch is None else table.slice(edges[-1]).combine_chunks()
            doc, n, component = (table.column(k).to_numpy() for k in (3, 4, 5))
            parts = []
            for x, y in zip(edges, edges[1:], strict=False):
                if y - x > 1 and (component[x + 1 : y] != component[x]).any():
                    got = found(doc[x:y], n[x:y].astype(np.int64), component[x:y], table.column(6).slice(x, y - x))
                    if len(got[0]):
                        parts.append(np.stack([np.full(len(got[0]), keys[0][x]), *got]) if names[0] == "hash" else np.stack(got))
            if parts:
                merged = np.unique(np.concatenate(parts, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged.astype(np.int64)], names)
        give_back()

    return rows.mapInArrow(run, schema)


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _ends(doc: np.ndarray, pairs: np.ndarray) -> list[np.ndarray]:
    left, right = doc[pairs[:, 0]], doc[pairs[:, 1]]
    return [np.minimum(left, right), np.maximum(left, right)]


def undecided(rows: DataFrame, rule: Threshold) -> DataFrame:
    """Of each list a forest, over components, of the pairs (a, b) that parity bits allow, and (hash, a, null) for the members with such a pair."""

    def found(doc: np.ndarray, n: np.ndarray, component: np.ndarray, bits: pa.Array) -> list[np.ndarray]:
        may = rule.may_link(n, _apart(bits.to_pylist())) & (component[:, None] != component[None, :])
        a, b = _ends(doc, _forest(may, component))
        open_ = doc[may.any(axis=1)]
        return [np.concatenate([a, open_]), np.concatenate([b, open_])]

    # A member stands as a pair with itself until here.
    out = _by_block(rows, found, "hash long, a long, b long")
    pair = F.col("a") != F.col("b")
    return out.select(F.when(~pair, F.col("hash")).alias("hash"), "a", F.when(pair, F.col("b")).alias("b")).distinct()


def decided(rows: DataFrame, rule: Threshold) -> DataFrame:
    """a, b: in each list a forest, over components, of the pairs whose whole sets link."""

    def found(doc: np.ndarray, n: np.ndarray, component: np.ndarray, sets: pa.Array) -> list[np.ndarray]:
        grams = [np.array([g for quarter in parts for g in quarter], np.int64) for parts in sets.to_pylist()]
        return _ends(doc, _forest(rule.may_link(n, _exactly_apart(grams)), component))

    return _by_block(rows, found, "a long, b long").distinct()


def _split_lists(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """hash, doc_id, component and the length c of lists of several components, one of those with the same members."""
    named = shared.select("hash", "doc_id").join(parts, "doc_id", "left").select("hash", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    low, high = F.min("component").alias("low"), F.max("component").alias("high")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), F.col("doc_id"))).alias(f"mark{k}") for k in (1, 2)]
    lists = named.groupBy("hash").agg(F.count("*").alias("c"), low, high, *marks).where("low < high")
    return named.join(lists.groupBy("c", "mark1", "mark2").agg(F.min("hash").alias("hash")).select("hash", "c"), "hash")


def _joined(parts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after more links."""
    if links.isEmpty():
        return parts
    a = parts.select(F.col("doc_id").alias("a"), F.col("component").alias("ca"))
    b = parts.select(F.col("doc_id").alias("b"), F.col("component").alias("cb"))
    over = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    tops = scratch.keep(connected_components(over.distinct(), scratch))
    up = tops.select(F.col("doc_id").alias("component"), F.col("component").alias("top"))
    moved = parts.join(up, "component", "left").select("doc_id", F.coalesce("top", "component").alias("component"))
    return scratch.keep(moved.unionByName(tops).groupBy("doc_id").agg(F.min("component").alias("component")))


def jaccard_components(docs: DataFrame, rule: Threshold = Threshold(), key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = with_text(docs, key, text).where("doc_id is not null")
    sets = scratch.keep(fragment_lists(docs, rule))
    groups = sets.where("n > 0").groupBy("sum1", "sum2", "n").agg(F.min("doc_id").alias("node"))
    named = sets.select("doc_id", "n", "sum1", "sum2").join(groups, ["sum1", "sum2", "n"], "left")
    members = scratch.keep(named.select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")))
    copies = members.where("doc_id <> node").select("doc_id")
    nodes = without_ids(sets.select("doc_id", "hashes"), copies)
    shared = shared_lists(nodes.select(F.explode("hashes").alias("hash"), "doc_id"), scratch)
    scratch.drop(sets)
    info = scratch.keep(set_bits(docs, shared.select("doc_id").distinct(), rule))

    # Each set with that smallest member of a list with which it has most fragments in common.
    agreed = shared.where("doc_id <> hub").groupBy("hub", "doc_id").agg(F.count("*").alias("c"))
    best = agreed.groupBy("doc_id").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub"))
    pairs = scratch.keep(allowed_pairs(best.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")), info, rule))
    parts = scratch.keep(connected_components(linked_pairs(pairs, docs, rule, scratch), scratch))

    # Pairs that connect what may be linked, and the members of lists that may have links.
    lists = scratch.keep(_split_lists(shared, parts))
    long = scratch.keep(lists.where(F.col("c") > LONG).select("doc_id").distinct())
    if not long.isEmpty():
        anew = rare_lists(docs, long, rule).join(long, "doc_id", "left_semi")
        lists = lists.where(F.col("c") <= LONG).unionByName(_split_lists(anew, parts))
    lists = lists.join(info, "doc_id")
    left = scratch.keep(undecided(_block_rows(lists, LIST_BLOCK, "bits"), rule), batch_rows=BITS_ROWS)
    more = linked_pairs(left.where("b is not null").select("a", "b"), docs, rule, scratch)
    parts = _joined(parts, more, scratch)

    # What is left in several components, by whole sets.
    lists = scratch.keep(_split_lists(left.where("b is null").select("hash", F.col("a").alias("doc_id")), parts))
    if not lists.isEmpty():
        rows = lists.join(whole_sets(docs, lists.select("doc_id").distinct(), rule), "doc_id")
        last = scratch.keep(decided(_block_rows(rows, SET_BLOCK, "parts"), rule), batch_rows=SET_BLOCK)
        parts = _joined(parts, last, scratch)
    named = members.join(parts.select(F.col("doc_id").alias("node"), "component"), "node", "left")
    done = scratch.keep(named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")))
    scratch.only(done)
    return done
