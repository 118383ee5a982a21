"""Quality classifier: a byte-level convolutional network in NumPy.

Learned filters slide over all bytes of the whole document; each of the overlapping chunks that
cover it takes the strongest answer of every filter (max pooling); a small dense layer turns that
into a logit per chunk, and the mean over the chunks into one probability. Filters are sums of
learned values per byte and place, so two bytes at a time are looked up in a table of byte pairs.

The network is fitted on the driver on at most ``sample_rows`` labelled rows and ``sample_bytes`` of their
texts, chosen by a hash of the key, of the labels that ``held_out`` leaves; everything else reads all rows.

Defined results: a null or empty text is one chunk of no bytes and gets the score that the biases
give; a text of any length is scored chunk by chunk in bounded memory; without usable labels all
scores are 0.5; a key with several labels counts each of them; repeated rows count once for fitting and
are scored one by one, as are those with a null key; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, keep_rows, map_batches, slabs, with_text

WIDTH = 4
BLOCK = 256  #: stride; a chunk is two blocks
SLICE = 128  #: blocks convolved at once


@dataclass
class Network:
    """filters: [WIDTH, 256, f]; dense layers from f + 1 (the chunk's length) to hidden to 1."""

    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, filters: int = 32, hidden: int = 16, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        kernel = rng.normal(0, 0.35, (WIDTH, 256, filters)).astype(np.float32)
        kernel[:, 0] = 0  # padding
        dense = rng.normal(0, (filters + 1) ** -0.5, (filters + 1, hidden)).astype(np.float32)
        out = rng.normal(0, hidden**-0.5, hidden).astype(np.float32)
        return cls(kernel, np.zeros(filters, np.float32), dense, np.zeros(hidden, np.float32), out, np.zeros(1, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Answers by byte pair for the first and the last two places of a filter."""
        k = self.filters
        return tuple((k[p][:, None, :] + k[p + 1][None, :, :]).reshape(65536, -1) for p in (0, 2))


def padded(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with each text filled up to whole blocks (WIDTH - 1 padding bytes at least), blocks per text, byte lengths."""
    lengths = np.diff(offsets)
    blocks = np.maximum(1, -(-(lengths + WIDTH - 1) // BLOCK))
    ends = np.cumsum(blocks) * BLOCK
    out = np.zeros(int(ends[-1]) + WIDTH, np.uint8)
    where = np.arange(len(data)) + np.repeat(ends - blocks * BLOCK - offsets[:-1], lengths)
    out[where] = data
    return out, blocks, lengths


def block_maxima(net_pairs: tuple[np.ndarray, np.ndarray], data: np.ndarray, blocks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The strongest answer of each filter in each block (and where it stands, when fitting)."""
    total, n_filters = int(blocks.sum()), net_pairs[0].shape[1]
    best = np.empty((total, n_filters), np.float32)
    at = np.empty((total, n_filters), np.int64) if places else None
    last = np.zeros(total, bool)
    last[np.cumsum(blocks) - 1] = True
    pair = data[:-1].astype(np.int32) * 256 + data[1:]
    for a in range(0, total, SLICE):
        b = min(total, a + SLICE)
        n = (b - a) * BLOCK
        answer = np.take(net_pairs[0], pair[a * BLOCK : a * BLOCK + n], axis=0)
        answer += np.take(net_pairs[1], pair[a * BLOCK + 2 : a * BLOCK + 2 + n], axis=0)
        answer = answer.reshape(b - a, BLOCK, n_filters)
        answer[last[a:b], 1 - WIDTH :] = -np.inf  # windows that would reach the next text
        if places:
            here = answer.argmax(axis=1)
            best[a:b] = np.take_along_axis(answer, here[:, None, :], axis=1)[:, 0]
            at[a:b] = here + (np.arange(a, b) * BLOCK)[:, None]
        else:
            answer.max(axis=1, out=best[a:b])
    return best, at


def chunk_table(blocks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk its first and second block, its text and the share of it that has bytes."""
    chunks = np.maximum(1, blocks - 1)
    text = np.repeat(np.arange(len(blocks)), chunks)
    k = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = np.repeat(np.cumsum(blocks) - blocks, chunks) + k
    second = np.minimum(first + 1, np.repeat(np.cumsum(blocks) - 1, chunks))
    filled = np.clip(lengths[text] - k * BLOCK, 0, 2 * BLOCK) / (2.0 * BLOCK)
    return first, second, text, filled.astype(np.float32)


def logits(net: Network, net_pairs: tuple[np.ndarray, np.ndarray], offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    filled_up, blocks, lengths = padded(offsets, data)
    best, _ = block_maxima(net_pairs, filled_up, blocks)
    first, second, text, filled = chunk_table(blocks, lengths)
    seen = np.maximum(np.maximum(best[first], best[second]) + net.bias, 0)
    hidden = np.maximum(seen @ net.dense[:-1] + filled[:, None] * net.dense[-1] + net.dense_bias, 0)
    each = hidden @ net.out + net.out_bias[0]
    return np.bincount(text, each, len(blocks)) / np.bincount(text, minlength=len(blocks))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[bytes], labels: list[int], epochs: int = 10, batch: int = 24, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the logistic loss, both classes weighted alike."""
    net = Network.fresh(seed=seed)
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        if len(y):
            net.out_bias[:] = 4.0 if y[0] else -4.0
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    first_moment, second_moment = ([np.zeros_like(a) for a in net.arrays()] for _ in range(2))
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            rows = order[a : a + batch]
            parts = [np.frombuffer(texts[i], np.uint8) for i in rows]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            gradient = _gradient(net, offsets, np.concatenate(parts), y[rows], weight[rows])
            step += 1
            pace = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, m, v in zip(net.arrays(), gradient, first_moment, second_moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            net.filters[:, 0] = 0
    return net


def _gradient(net: Network, offsets: np.ndarray, data: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    filled_up, blocks, lengths = padded(offsets, data)
    best, at = block_maxima(net.pairs(), filled_up, blocks, places=True)
    first, second, text, filled = chunk_table(blocks, lengths)
    later = best[second] > best[first]
    seen = np.maximum(np.where(later, best[second], best[first]) + net.bias, 0)
    hidden = np.maximum(seen @ net.dense[:-1] + filled[:, None] * net.dense[-1] + net.dense_bias, 0)
    chunks = np.bincount(text, minlength=len(blocks))
    logit = np.bincount(text, hidden @ net.out + net.out_bias[0], len(blocks)) / chunks
    by_text = (sigmoid(logit) - y) * weight / len(y)
    by_chunk = (by_text / chunks)[text].astype(np.float32)
    to_hidden = by_chunk[:, None] * net.out * (hidden > 0)
    to_seen = (to_hidden @ net.dense[:-1].T) * (seen > 0)
    place = np.where(later, at[second], at[first])
    to_filters = np.zeros_like(net.filters)
    column = np.broadcast_to(np.arange(place.shape[1]), place.shape)
    for k in range(WIDTH):
        np.add.at(to_filters[k], (filled_up[place + k], column), to_seen)
    dense = np.vstack([seen.T @ to_hidden, (filled @ to_hidden)[None]])
    return [to_filters, to_seen.sum(0), dense, to_hidden.sum(0), hidden.T @ by_chunk, by_chunk.sum(keepdims=True)]


def held_out(key: Column) -> Column:
    """Rows never used for fitting: crc32 of the key as text is a multiple of 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def sample_of_labels(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[tuple[int, str]]:
    """(label, text) of at most sample_rows labelled rows that are not held out and sample_bytes of texts, by a hash of the key.

    A row whose text would pass the bytes left is left out, and the next ones are tried.
    """
    marked = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    # At most sample_rows rows are broadcast. The texts are read once, into a table of that many rows; of these first the lengths are looked at.
    scratch = Scratch(docs.sparkSession, "labels")
    rows = scratch.keep(with_text(docs, key, text).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")))
    mark = F.xxhash64("text")
    sized = rows.select(F.xxhash64("doc_id").alias("place"), "doc_id", "label", F.octet_length("text").alias("n"), mark.alias("mark")).collect()
    fits, left = set(), sample_bytes
    for _, doc, own, n, m in sorted(set(map(tuple, sized))):
        if n < left:
            fits.add((doc, own, m))
            left -= n
    if not fits:
        scratch.drop(rows)
        return []
    wanted = docs.sparkSession.createDataFrame(sorted(fits), "doc_id long, label int, mark long")
    found = rows.withColumn("mark", mark).join(F.broadcast(wanted), ["doc_id", "label", "mark"]).select("doc_id", "label", "text").distinct().collect()
    scratch.drop(rows)
    found.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1], r[2]))
    return [(r[1], r[2]) for r in found]


def fit_from_labels(docs: DataFrame, labels: DataFrame, sample_rows: int = 2500, sample_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """A network from at most sample_rows labelled rows, and sample_bytes of their texts, that are not held out."""
    rows = sample_of_labels(docs, labels, sample_rows, sample_bytes, key, text, label)
    return fit([t.encode() for _, t in rows], [own for own, _ in rows])


def _scorer(docs: DataFrame, net: Network) -> Callable[[pa.Array], np.ndarray]:
    """Scores of a column of texts; the network is sent once (a few 100 KB, whatever the input)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    made: dict[str, tuple] = {}

    def scores(texts: pa.Array) -> np.ndarray:
        own = sent.value
        pairs = made.get("pairs") or made.setdefault("pairs", own.pairs())
        parts = [logits(own, pairs, offsets, data) for _, _, offsets, data in slabs(texts)]
        return sigmoid(np.concatenate(parts)) if parts else np.zeros(0)

    return scores


def score_quality(docs: DataFrame, net: Network, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the score of its whole text and the class from the threshold up."""
    scores = _scorer(docs, net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = scores(batch.column(1))
        picked = (score >= threshold).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(picked)], ["doc_id", "score", "predicted"])

    return map_batches(with_text(docs, key, text), run, "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, net: Network, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose whole text scores the threshold or more."""
    scores = _scorer(docs, net)
    return keep_rows(docs, text, lambda texts: scores(texts) >= threshold)
