"""Byte-level BPE by merge replay over blocks of the corpus.

The pieces of a block of documents are gathered, each new one once, and the merges are replayed over
all of them together: an inverted index from merge rank (that is, from the token that a pair forms)
to the places of the pair is worked off in rank order, and each merge changes only the pairs of its
two neighbours. Pieces met before come from a bounded memory of their ids, so that what a worker
holds does not grow with the corpus. The ids are those of greedy lowest-rank merging of each piece
by itself, because pieces never touch, and so it may be done in parts: a replay takes pieces of REPLAY_BYTES at a time, in arrays
of numbers, and what is kept of pieces goes at the end of a task, as a worker lives on beside those of other stages.

Defined results: a null or empty text has no ids; decoding no ids gives no bytes; ids outside the
vocabulary raise; texts are encoded whole at any length; rows are handled one by one (ties,
repeated rows, null keys, empty tables) and other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import map_batches, with_text

#: Pieces kept in each of the two generations of a worker's memory.
MEMORY_PIECES = 200_000
# Letters and numbers of later Unicode versions than 16, by which the pieces are defined; regular expressions here may know them.
LATE_LETTERS = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
LATE_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
#: Characters of text whose pieces are gathered before a replay.
BLOCK_CHARS = 1 << 19
#: Bytes of new pieces that are replayed at once; one longer piece is replayed by itself.
REPLAY_BYTES = 1 << 18


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def _ranges(listed: str) -> str:
    """The inside of a class of characters."""
    return "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in listed.split())


class MergeReplay:
    """A vocabulary of byte strings by rank, its piece pattern, and a memory of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        # White space as Unicode defines it; some regex engines count more control characters in.
        plain = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(plain)
        # The same with letters and numbers of Unicode 16 alone, for texts in which that matters.
        letters, numbers = (_ranges(late) for late in (LATE_LETTERS, LATE_NUMBERS))
        pinned = plain.replace(r"\p{L}", rf"[\p{{L}}--[{letters}]]").replace(r"\p{N}", rf"[\p{{N}}--[{numbers}]]")
        self.pinned, self.late = regex.compile(pinned, regex.V1), re.compile(f"[{letters}{numbers}]")
        #: What two neighbours form: left * size + right to rank.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        at = self.single
        self.byte_pairs = np.array([[self.pairs.get(x * self.size + y, -1) for y in at] for x in at], np.int64)
        self.memory = MEMORY_PIECES
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return (self.pinned if not text.isascii() and self.late.search(text) else self.pattern).findall(text)

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece after all merges, in rank order over all pieces at once."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        bounds = np.cumsum([0, *map(len, pieces)])
        n, size, pair = len(data), self.size, self.pairs.get
        last = np.zeros(n, bool)
        last[bounds[1:] - 1] = True
        # Four bytes a number, as lists of numbers take forty.
        ids = array("i", np.array(self.single, np.int32)[data].tobytes())
        after = array("i", np.where(last, -1, np.arange(1, n + 1)).astype(np.int32).tobytes())
        before = array("i", np.where(np.append(True, last[:-1])[:n], -1, np.arange(-1, n - 1)).astype(np.int32).tobytes())
        # The inverted index: rank to the places of its pairs, built at once for the pairs of bytes.
        first = np.append(np.where(last[:-1], -1, self.byte_pairs[data[:-1], data[1:]]), -1)[:n]
        hits = np.flatnonzero(first >= 0)
        hits = hits[np.argsort(first[hits], kind="stable")]
        todo, starts = np.unique(first[hits], return_index=True)
        parts = np.split(hits, starts[1:]) if len(hits) else []
        todo = todo.tolist()  # ascending, and so a heap
        places = {r: array("i", part.astype(np.int32).tobytes()) for r, part in zip(todo, parts, strict=True)}
        ends = array("i", bounds.astype(np.int32).tobytes())
        while todo:
            r = heappop(todo)
            spots = places.pop(r)
            if len(spots) > 1:
                spots = sorted(spots)
            held: set[int] = set()  # pieces in which this merge made a pair of a lower rank, which goes first
            again = array("i")
            for i in spots:
                j = after[i]
                if j < 0 or ids[i] < 0 or pair(ids[i] * size + ids[j]) != r:
                    continue
                if held and bisect_right(ends, i) in held:
                    again.append(i)
                    continue
                k = after[j]
                ids[i] = r
                ids[j] = -1
                after[i] = k
                if k >= 0:
                    before[k] = i
                    new = pair(r * size + ids[k])
                    if new is not None:
                        if new in places:
                            places[new].append(i)
                        else:
                            places[new] = array("i", (i,))
                            heappush(todo, new)
                        if new < r:
                            held.add(bisect_right(ends, i))
                h = before[i]
                if h >= 0:
                    new = pair(ids[h] * size + r)
                    if new is not None:
                        if new in places:
                            places[new].append(h)
                        else:
                            places[new] = array("i", (h,))
                            heappush(todo, new)
                        if new < r:
                            held.add(bisect_right(ends, i))
            if again:
                if r in places:
                    places[r] += again
                else:
                    places[r] = again
                    heappush(todo, r)
        left = np.frombuffer(ids, np.int32)
        alive = left >= 0
        cuts = np.append(0, np.cumsum(alive))[bounds].tolist()
        packed = left[alive].astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        if len(self.young) > self.memory:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        fresh: list[str] = []
        for piece in set().union(*split).difference(young):
            kept = old.get(piece)
            if kept is None:
                whole = self.ranks.get(piece.encode())
                if whole is None:
                    fresh.append(piece)
                    continue
                kept = whole.to_bytes(4, "little")
            young[piece] = kept
        for part in _parts(fresh):
            young.update(zip(part, self.replay([p.encode() for p in part]), strict=True))
        return [b"".join(map(young.__getitem__, pieces)) for pieces in split]

    def forget(self) -> None:
        """Give up the pieces met before."""
        self.young, self.old = {}, {}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _parts(pieces: list[str]) -> Iterator[list[str]]:
    """The pieces in runs of about REPLAY_BYTES."""
    part, size = [], 0
    for piece in pieces:
        length = len(piece) if piece.isascii() else len(piece.encode())
        if part and size + length > REPLAY_BYTES:
            yield part
            part, size = [], 0
        part.append(piece)
        size += length
    if part:
        yield part


_LOADED: dict[int, MergeReplay] = {}


def _coder(raw: bytes, pattern: str) -> MergeReplay:
    """One coder per worker and vocabulary, kept from task to task."""
    key = zlib.crc32(raw + pattern.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = MergeReplay(load_ranks(raw), pattern)
    return _LOADED[key]


def _vocabulary(docs: DataFrame, path: str):  # noqa: ANN202
    """The vocabulary file, read once on the driver (about 1 MB) and sent to the workers."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def _encoded(coder: MergeReplay, texts: pa.Array) -> list[bytes]:
    """Ids per text, in blocks of bounded size."""
    out: list[bytes] = []
    block: list[str] = []
    size = 0
    for t in texts.to_pylist():
        block.append(t or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            out += coder.encode(block)
            block, size = [], 0
    return out + coder.encode(block)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of the whole text by the ranks in the file."""
    sent = _vocabulary(docs, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _encoded(_coder(sent.value, pattern), batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(with_text(docs, key, text), run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", memory_pieces: int = MEMORY_PIECES) -> DataFrame:
    """As encode and then decode, in one pass over a worker, which keeps twice so many pieces at most, and none behind its task."""
    sent = _vocabulary(docs, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(sent.value, pattern)
        coder.memory = memory_pieces
        ids = _encoded(coder, batch.column(1))
        back = [coder.decode(x) for x in ids]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(with_text(docs, key, text), run, "doc_id long, ids binary, decoded binary", lambda: _coder(sent.value, pattern).forget())


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (the bytes of the ids' tokens, one after another)."""
    sent = _vocabulary(encoded, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(sent.value, pattern)
        texts = [coder.decode(ids or b"") for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")
