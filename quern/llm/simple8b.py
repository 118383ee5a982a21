"""Token ids in files of Simple-8b words.

A document's ids (and an end id) become 64-bit words: the top 4 bits select how many ids share the
other 60. Ids of 30 bits and more are escaped: their lane holds all ones, and the value stands in
a list beside the words. Words come in segments of SEGMENT ids with the offset of each segment, so
that a block is packed and unpacked by array operations over all its segments at once.

The files are Parquet tables of blocks, written by Spark's own writers, so lost executors or
repeated tasks leave no half files. Documents stand in ascending key order: by range over parts,
sorted within one, and a block holds whole documents. A row is (part, block, doc_ids, n_ids,
words, offsets, escapes).

Defined results: a null or empty text holds the end id alone; rows with a null key are dropped;
rows with equal keys are ordered by text; texts of any length are written whole (a block holds one
at least); an empty table gives no blocks; other columns are neither read nor written.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, give_back, map_batches, slabs, with_text
from quern.llm.wordhash import LOWER, NOT_SPACE, spans, word_hashes

#: Ids per word by selector, and the bits of each: 60 bits shared evenly; the first two are runs of zeros.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
SINGLE = 15  #: selector of one id in 60 bits
ESCAPE = (1 << 30) - 1
SEGMENT = 1024
#: Ids that a block gathers before it is written.
BLOCK_IDS = 1 << 16
#: Pieces kept in a worker's memory, of some 40 bytes each.
MEMORY_PIECES = 1_000_000

BLOCK_SCHEMA = "part int, block int, doc_ids array<long>, n_ids array<int>, words binary, offsets array<array<int>>, escapes binary"

#: Bits of each 16-bit value.
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, below 2^32."""
    high = values >> np.uint64(16)
    low = _BITS[values.astype(np.uint16)]
    return np.where(high > 0, _BITS[high.astype(np.uint16)] + np.uint8(16), low) if high.any() else low


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, per segment (and for the end) its first word and its first escaped value, and escaped values of 32-bit ids."""
    ids = ids.astype(np.uint64)
    high = ids >= ESCAPE
    escapes = ids[high].astype("<u4")
    lanes = np.where(high, np.uint64(ESCAPE), ids)
    n = len(lanes)
    if not n:
        return np.zeros(0, "<u8"), np.zeros((1, 2), np.int32), escapes
    # The widest id of each run, by doubling: run lengths from 1 up.
    widest, length = {1: _bits(lanes)}, 1
    selector = np.full(n, SINGLE, np.uint8)
    room = np.minimum(n, (np.arange(n) // SEGMENT + 1) * SEGMENT) - np.arange(n)
    for s in range(len(COUNTS) - 1, -1, -1):
        c, w = COUNTS[s], WIDTHS[s]
        if c > n:
            break
        while length < c:
            more = min(c - length, length)
            m = widest[length]
            widest = {length + more: np.maximum(m[: n - length - more + 1], m[more : n - length + 1])}
            length += more
        narrow = widest[c] <= w
        if not narrow.any():
            break  # nor does any longer run fit its fewer bits
        selector[np.flatnonzero(narrow & (room[: n - c + 1] >= c))] = s
    counts = np.append(np.array(COUNTS), 1)[selector]
    # All segments walk at once from word to word.
    at = np.arange(0, n, SEGMENT)
    ends = np.minimum(at + SEGMENT, n)
    used = np.zeros(n, bool)
    while len(at):
        used[at] = True
        at = at + counts[at]
        on = at < ends
        at, ends = at[on], ends[on]
    starts = np.flatnonzero(used)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        c, w = (1, 60) if s == SINGLE else (COUNTS[s], WIDTHS[s])
        if w:
            for k in range(c):
                words[mine] |= lanes[starts[mine] + k] << np.uint64(k * w)
    heads = np.arange(0, n, SEGMENT)
    first_words = np.append(np.searchsorted(starts, heads), len(starts))
    first_escapes = np.append(np.searchsorted(np.flatnonzero(high), heads), len(escapes))
    return words.astype("<u8"), np.stack([first_words, first_escapes], axis=1).astype(np.int32), escapes


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of the words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.append(np.array(COUNTS), 1)[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for s in np.unique(selector).tolist():
        c, w = (1, 60) if s == SINGLE else (COUNTS[s], WIDTHS[s])
        if not w:
            continue
        mine = np.flatnonzero(selector == s)
        for k in range(c):
            out[starts[mine] + k] = (words[mine] >> np.uint64(k * w)) & np.uint64((1 << w) - 1)
    high = np.flatnonzero(out == ESCAPE)
    if len(high):
        out[high] = escapes
    return out.astype("<u4")


def unpack_span(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, first: int, stop: int) -> np.ndarray:
    """The ids at places first to stop - 1 of a block, from the words of their segments alone."""
    if stop <= first:
        return np.zeros(0, "<u4")
    low, high = first // SEGMENT, -(-stop // SEGMENT)
    (word, escape), (word_end, escape_end) = offsets[low].tolist(), offsets[high].tolist()
    return unpack(words[word:word_end], escapes[escape:escape_end])[first - low * SEGMENT : stop - low * SEGMENT]


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level models write bytes: printable ones stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Kinds of bytes, after lower-casing A-Z: white space, letters, marks and digits that any library takes apart alike, the rest.
SPACE, LETTER, MARK, DIGIT, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[97:123] = LETTER
KINDS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK  # without the apostrophe
KINDS[48:58] = DIGIT
#: The second byte of a small letter of Latin-1 (behind 0xC3).
SECOND = np.zeros(256, bool)
SECOND[[*range(0xA0, 0xB7), *range(0xB8, 0xC0)]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the pieces that have ids of their own.

    Between white space, runs of letters, runs of marks, and single digits; a chunk that holds
    anything else is one piece.
    """
    starts, ends = spans(data, offsets, NOT_SPACE)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint8)
    kind = KINDS[data]
    if (data == 0xC3).any():
        lead = np.flatnonzero((data[:-1] == 0xC3) & SECOND[data[1:]])
        kind[lead] = kind[lead + 1] = LETTER
    odd = np.append(0, np.cumsum(kind == OTHER, dtype=np.int64))
    mixed = odd[ends] > odd[starts]
    # In plain chunks a piece starts where the kind changes, and at each digit.
    fresh = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    fresh &= kind != SPACE
    for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        fresh[a:b] = False
        kind[a:b] = OTHER
    fresh[starts] = True
    begin = np.flatnonzero(fresh)
    # A piece ends where the next one of its chunk starts, or with the chunk.
    chunk_end = ends[np.searchsorted(starts, begin, "right") - 1]
    return begin, np.minimum(np.append(begin[1:], len(data)), chunk_end), kind[begin]


#: The normaliser, pre-tokenizer and model settings that take a text apart as units() does.
BY_UNITS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
    },
)


class UnitCoder:
    """Ids of whole texts by a tokenizer of the tokenizers library.

    A tokenizer whose file declares the parts BY_UNITS gives a text the ids of its pieces, one after
    another; the ids of pieces met before come from a bounded memory, new ones from the library.
    Any other tokenizer encodes each text whole.
    """

    def __init__(self, raw: bytes) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(raw.decode())
        self.model = self.whole.model
        plan = json.loads(raw)
        added = plan.get("added_tokens", [])
        literal = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in added)
        self.special = [t["content"].lower().encode() for t in added]
        self.letters = _byte_letters()
        self.memory_clear()
        model = {k: v for k, v in plan["model"].items() if k not in ("vocab", "merges")}
        self.by_units = bool(literal and not plan.get("post_processor") and (plan.get("normalizer"), plan.get("pre_tokenizer"), model) == BY_UNITS)

    def memory_clear(self) -> None:
        """Pieces by hash, ascending, and of each its row; of each row the place and number of its ids."""
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids_of_rows = np.zeros(0, np.uint32)
        self.met = np.zeros(0, bool)

    def ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], kinds: list[int]) -> None:
        """Ids of new pieces: a word by the library's model alone, which is quicker, the others by all of it."""
        flat: list[int] = []
        counts: list[int] = []
        tokenize, letters = self.model.tokenize, self.letters
        for piece, kind in zip(pieces, kinds, strict=True):
            if kind != LETTER:
                own = self.ids(piece.decode())
            elif piece.isascii():
                own = [t.id for t in tokenize(piece.decode())]
            else:
                own = [t.id for t in tokenize(piece.decode("latin-1").translate(letters))]
            flat += own
            counts.append(len(own))
        count = np.array(counts, np.int64)
        rows = len(self.count) + np.arange(len(count))
        self.begin = np.append(self.begin, len(self.ids_of_rows) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.ids_of_rows = np.append(self.ids_of_rows, np.array(flat, np.uint32))
        self.met = np.append(self.met, np.ones(len(count), bool))
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.rows = np.insert(self.keys, at, hashes), np.insert(self.rows, at, rows)

    def _forget(self) -> None:
        """Keep what was met since the last time, if that is little enough."""
        keep = self.met[self.rows]
        if keep.sum() > MEMORY_PIECES // 2:
            self.memory_clear()
            return
        old = self.rows[keep]
        self.keys, self.rows = self.keys[keep], np.arange(len(old))
        self.ids_of_rows = self.ids_of_rows[_stretches(self.begin[old], self.count[old])]
        self.count = self.count[old]
        self.begin = np.cumsum(self.count) - self.count
        self.met = np.zeros(len(old), bool)

    def _by_units(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        low = LOWER[data]
        starts, ends, kinds = units(low, offsets)
        hashes, place, which = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(hashes) > MEMORY_PIECES:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = self.keys[at] != hashes if len(self.keys) else np.ones(len(hashes), bool)
        if new.any():
            spot = place[new]
            raw = low.tobytes()
            self._learn(hashes[new], [raw[a:b] for a, b in zip(starts[spot].tolist(), ends[spot].tolist(), strict=True)], kinds[spot].tolist())
            at = np.searchsorted(self.keys, hashes)
        rows = self.rows[at]
        self.met[rows] = True
        rows = rows[which]
        count = self.count[rows]
        ids = self.ids_of_rows[_stretches(self.begin[rows], count)]
        until = np.append(0, np.cumsum(count))[np.searchsorted(starts, offsets)]
        return ids, np.diff(until)

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (offsets into their UTF-8 bytes), and how many each text has."""
        raw = data.tobytes()
        if self.by_units:
            low = raw.lower()
            if not any(w in low for w in self.special):
                return self._by_units(offsets, data)
        # A special token counts only as it is written, so such texts go whole to the library.
        parts = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
            if self.by_units and not any(w in raw[a:b].lower() for w in self.special):
                parts.append(self._by_units(np.array([0, b - a]), data[a:b])[0])
            else:
                parts.append(np.array(self.ids(raw[a:b].decode()), np.uint32))
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)


def _stretches(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each stretch, one after another."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _as_slab(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)


_LOADED: dict[int, UnitCoder] = {}


def coder_of(raw: bytes) -> UnitCoder:
    """One coder per worker and tokenizer, kept from task to task."""
    key = zlib.crc32(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = UnitCoder(raw)
    return _LOADED[key]


def write_ids(docs: DataFrame, tokenizer_path: str, out: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all whole texts, each with the end id, in ascending key order to the folder out."""
    with open(tokenizer_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # a file of a few MB, read once
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.list_(pa.int32())), pa.binary()]
    names = [field.split()[0] for field in BLOCK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, block = coder_of(sent.value), TaskContext.get().partitionId(), 0
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def rows() -> pa.RecordBatch:
            nonlocal block, keys, counts, parts, held
            words, offsets, escapes = pack(np.concatenate(parts))
            columns = [[part], [block], [np.concatenate(keys)], [np.concatenate(counts)], [words.tobytes()], [offsets.tolist()], [escapes.tobytes()]]
            block += 1
            keys, counts, parts, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            own = batch.column(0).to_numpy()
            for first, end, offsets, data in slabs(batch.column(1)):
                ids, count = coder.encode(offsets, data)
                ids = np.insert(ids, np.cumsum(count), end_id)
                count = count + 1
                ends = np.cumsum(count)
                # Blocks of whole documents: as many as fill it, one at least.
                a = 0
                while a < end - first:
                    done = int(ends[a - 1]) if a else 0
                    b = min(end - first, int(np.searchsorted(ends, done + BLOCK_IDS - held)) + 1)
                    keys.append(own[first + a : first + b])
                    counts.append(count[a:b])
                    parts.append(ids[done : int(ends[b - 1])])
                    held += int(ends[b - 1]) - done
                    a = b
                    if held >= BLOCK_IDS:
                        yield rows()
        if held:
            yield rows()
        give_back()

    bounded_batches(docs.sparkSession)
    rows_in = with_text(docs, key, text).where("doc_id is not null")
    ordered = rows_in.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(out)


def read_ids(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_ids and ids (binary, little-endian unsigned 32-bit) from the files.

    With wanted (doc_id), those documents alone, each decoded from its own segments.
    """
    if wanted is None:
        return _placed(spark, path, _decoded(spark, path, digest=False))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    asked = F.col("quern_wanted")
    listed = blocks.select("part", "block", F.posexplode("doc_ids").alias("place", "doc_id")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    places = listed.groupBy("part", "block").agg(F.collect_list("place").alias("quern_wanted"))  # at most the documents of a block
    some = blocks.join(places, ["part", "block"]).select("part", "block", "doc_ids", "n_ids", "words", "offsets", "escapes", asked)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for part, block, doc_ids, n_ids, words, offsets, escapes, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends = np.cumsum(n_ids).tolist()
            packed = np.frombuffer(words, "<u8"), np.array(offsets), np.frombuffer(escapes, "<u4")
            for k in sorted(places):
                out.append((part, block, k, doc_ids[k], ends[k] - n_ids[k], n_ids[k], unpack_span(*packed, ends[k] - n_ids[k], ends[k]).tobytes()))
        return _document_rows(out, "ids", pa.binary())

    return _placed(spark, path, map_batches(some, run, DOCUMENT_SCHEMA + "ids binary"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_ids, with the crc32 of the decoded ids in place of the ids."""
    return _placed(spark, path, _decoded(spark, path, digest=True))


DOCUMENT_SCHEMA = "part int, block int, place int, doc_id long, inside long, n_ids long, "


def _document_rows(rows: list[tuple], last: str, kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind]
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "block", "place", "doc_id", "inside", "n_ids", last])


def _decoded(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    """part, block, place, doc_id, ids before it in the block, n_ids and ids or their crc32."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    last, kind = ("crc", pa.int64()) if digest else ("ids", pa.binary())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for part, block, doc_ids, n_ids, words, escapes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = unpack(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u4")).tobytes()
            ends = np.cumsum(n_ids).tolist()
            for k, (doc, n, stop) in enumerate(zip(doc_ids, n_ids, ends, strict=True)):
                own = ids[4 * (stop - n) : 4 * stop]
                out.append((part, block, k, doc, stop - n, n, zlib.crc32(own) if digest else own))
        return _document_rows(out, last, kind)

    return map_batches(blocks.select("part", "block", "doc_ids", "n_ids", "words", "escapes"), run, DOCUMENT_SCHEMA + f"{last} {'long' if digest else 'binary'}")


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """doc_id, start, n_ids and the last column: ids before a block are sums of whole parts (one small row a part), then of the blocks before in its part."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.select("part", "block", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("block_start")).join(parts, "part")
    return rows.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("part_start") + F.col("block_start") + F.col("inside")).cast("long").alias("start"), "n_ids", rows.columns[-1]
    )
