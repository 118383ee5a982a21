"""Removal of repeated byte strings by anchors and hashed names, in place of distributed prefix doubling.

A string of LENGTH bytes goes where an equal one starts earlier (a smaller doc_id, or the same
document). Strings have names: 64-bit hashes, equal for equal strings, and no ranks. Positions leave as soon as their name is unique, and one position stands for all
whose names can't differ any more, so that few of them reach the last length:

1. GRAM bytes. Each window of LENGTH bytes holds an anchor, the smallest hash of its GRAM-byte
   strings; equal windows have equal anchors at equal places. Neighbouring windows with one anchor
   form a run. Runs whose anchor's name is unique can't repeat and leave.
2. All bytes of a run. Of runs with equal names the first stays and the others are covered. A first
   whose anchor has no other name leaves too.
3. LENGTH bytes. In the runs left, a worker names each window from one rolling sum; Spark sorts the
   runs by anchor and place, not the names, and of equal names all but the first
   are covered. An anchor with very many runs is dealt out by the names of its windows instead.

Defined results: a null or empty text has no bytes (and an empty kept text); texts below LENGTH bytes lose
nothing; matches never cross documents; keys are expected to be unique; rows with a null key are
dropped; an empty table gives an empty result; other columns are neither read nor returned. Whole
texts are read; a worker holds one slab of texts, and of an anchor at most HOT_RUNS runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, bounded_batches, map_batches, prefiltered, slabs, with_text
from quern.llm.wordhash import _BYTE, _powers, mix

#: A removed string has LENGTH bytes; each holds an anchor, the smallest hash of its GRAM-byte strings.
LENGTH, GRAM = 100, 36
#: Runs of one anchor that a worker compares at once.
HOT_RUNS = 20_000
#: Bytes of text for which hashes are held at once (a longer text is a slab of its own).
SLAB = 1 << 19


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which string_hash takes the hash of any stretch."""
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def string_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal strings."""
    down = _powers(len(sums))[1]
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def anchored_runs(offsets: np.ndarray, data: np.ndarray):
    """Runs of LENGTH-byte windows with one anchor: text, first window, windows, anchor, hash of the anchor's string, hash of all bytes of the run."""
    n = len(data)
    wide = LENGTH - GRAM + 1
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    grams = string_hash(sums, at, at + GRAM)
    # Hash above, place below: the smallest in a window is the leftmost of its smallest hashes.
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (grams >> bits << bits) | at.astype(np.uint64)
    length = 1
    while length < wide:
        more = min(wide - length, length)
        low = np.minimum(low[: len(low) - more], low[more:])
        length += more
    anchor = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)  # of the window from each place
    starts = np.arange(len(anchor))
    text = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + LENGTH <= offsets[text + 1]
    starts, anchor, text = starts[inside], anchor[inside], text[inside]
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    first = starts[new]
    last = starts[np.append(new[1:], len(starts)) - 1]
    return text[new], first, last - first + 1, anchor[new], grams[anchor[new]], string_hash(sums, first, last + LENGTH)


def names_by_doubling(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names of the LENGTH bytes from each start, mixed from the hashes of their quarters, as good as one hash of all."""
    quarter = LENGTH // 4
    with np.errstate(over="ignore"):
        names = [string_hash(sums, starts + k * quarter, starts + (k + 1) * quarter) for k in range(4)]
        for step in (1, 2):
            names = [mix(names[k] * np.uint64(0x9E3779B97F4A7C15) + mix(names[k + 1] + np.uint64(step))) for k in range(0, len(names), 2)]
    return names[0]


def _runs(docs: DataFrame) -> DataFrame:
    """anchor, run (their names), doc_id, low (first window), n (windows) of all texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        parts = []
        for first, _, offsets, data in slabs(batch.column(1), SLAB):
            text, low, n, _, anchor, whole = anchored_runs(offsets, data)
            parts.append((anchor.view(np.int64), whole.view(np.int64), keys[first + text], low - offsets[text], n))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "run", "doc_id", "low", "n"])

    return map_batches(docs, run, "anchor long, run long, doc_id long, low int, n int")


def _named_windows(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """anchor, doc_id, low and the names (packed) of the windows of each open run."""
    wanted = opened.groupBy("doc_id").agg(F.collect_list(F.struct("low", "n", "anchor", "hot")).alias("spots"))  # at most the runs of a text
    texts = prefiltered(docs, opened.select("doc_id"))[0].join(wanted, "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        spots = batch.column(2).to_pylist()
        keys = batch.column(0).to_pylist()
        for first, end, offsets, data in slabs(batch.column(1), SLAB):
            here = [(keys[first + k], int(offsets[k]), spot) for k in range(end - first) for spot in spots[first + k]]
            count = np.array([spot["n"] for _, _, spot in here])
            begin = np.array([at + spot["low"] for _, at, spot in here])
            ends = np.cumsum(count)
            names = names_by_doubling(prefix_sums(data), np.arange(int(ends[-1])) + np.repeat(begin - (ends - count), count)).tobytes()
            stops = (8 * ends).tolist()
            out += [(spot["anchor"], spot["hot"], key, spot["low"], names[stop - 8 * spot["n"] : stop]) for (key, _, spot), stop in zip(here, stops, strict=True)]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "hot", "doc_id", "low", "names"])

    return map_batches(texts.select("doc_id", "text", "spots"), run, "anchor long, hot boolean, doc_id long, low int, names binary")


def _stretches(starts: np.ndarray) -> list[tuple[int, int]]:
    """Covered bytes (from, to) of windows at ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return [(int(s[0]), int(s[-1]) + LENGTH) for s in np.split(starts, cut)]


def _later_windows(named: DataFrame) -> DataFrame:
    """doc_id, start, stop of bytes under windows whose name stands earlier in another run of the anchor."""
    rows = named.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, set()
        for batch in batches:
            out: list[tuple] = []
            for anchor, doc, low, packed in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if anchor != at:
                    at, seen = anchor, set()
                names = np.frombuffer(packed, np.uint64).tolist()
                again = [k for k, name in enumerate(names) if name in seen]
                seen.update(names)
                out += [(doc, a, b) for a, b in _stretches(low + np.array(again, np.int64))]
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "start", "stop"])

    bounded_batches(named.sparkSession)
    return rows.mapInArrow(run, "doc_id long, start int, stop int")


def _later_hot_windows(named: DataFrame) -> DataFrame:
    """The same for anchors of very many runs: a row per window, dealt by its name."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [np.frombuffer(b, np.int64) for b in batch.column(4).to_pylist()]
        count = [len(x) for x in names]
        docs = np.repeat(batch.column(2).to_numpy(), count)
        at = np.concatenate([low + np.arange(n) for low, n in zip(batch.column(3).to_pylist(), count, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(docs), pa.array(at, pa.int32())], ["name", "doc_id", "at"])

    windows = map_batches(named.where("hot"), run, "name long, doc_id long, at int")
    first = windows.groupBy("name").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = windows.join(first, "name").where("first.doc_id <> doc_id or first.at <> at")
    return later.select("doc_id", F.col("at").alias("start"), (F.col("at") + LENGTH).cast("int").alias("stop"))


def covered_bytes(docs: DataFrame, scratch: Scratch, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, start, stop of stretches of bytes to remove; they may overlap."""
    runs = _runs(docs)
    twice = scratch.keep(runs.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    shared = scratch.keep(prefiltered(runs, twice, "anchor", 1 << 26)[0].join(twice, "anchor", "left_semi"))
    scratch.drop(twice)
    classes = scratch.keep(shared.groupBy("anchor", "run").agg(F.min(F.struct("doc_id", "low", "n")).alias("first"), F.count("*").alias("c")))
    repeated = classes.where("c > 1").select("anchor", "run", "first")
    copies = shared.join(repeated, ["anchor", "run"]).where("first.doc_id <> doc_id or first.low <> low")
    whole = scratch.keep(copies.select("doc_id", F.col("low").alias("start"), (F.col("low") + F.col("n") + (LENGTH - 1)).cast("int").alias("stop")))
    many = classes.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1")
    opened = classes.join(many, "anchor").select("first.doc_id", "first.low", "first.n", "anchor", (F.col("runs") > hot_runs).alias("hot"))
    opened = scratch.keep(opened)
    scratch.drop(shared, classes)
    named = scratch.keep(_named_windows(docs, opened))
    found = _later_windows(named)
    if not opened.where("hot").isEmpty():
        found = found.unionByName(_later_hot_windows(named))
    done = scratch.keep(whole.unionByName(found))
    scratch.drop(whole, opened, named)
    return done


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, removed (maximal stretches of start and stop) and kept (the bytes left) of every row."""
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = with_text(docs, key, text).where("doc_id is not null")
    covered = covered_bytes(docs, scratch, hot_runs)
    touched, clean = prefiltered(docs, covered.select("doc_id"))
    each = covered.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))  # at most the runs and windows of a text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, kept = [], [], []
        for data, parts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = data or b""
            merged: list[list[int]] = []
            for a, b in sorted((p["start"], p["stop"]) for p in parts or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *(x for span in merged for x in span), len(data)]
            sizes.append(len(data))
            removed.append([{"start": a, "stop": b} for a, b in merged])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    schema = "doc_id long, n_bytes long, removed array<struct<start: int, stop: int>>, kept binary"
    cut = map_batches(touched.join(each, "doc_id", "left").select("doc_id", "text", "parts"), run, schema)
    body = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    none = F.array().cast("array<struct<start: int, stop: int>>")
    return cut.unionByName(clean.select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), none.alias("removed"), body.alias("kept")))
