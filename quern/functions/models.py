"""Pluggable models: a callable per worker, wrapped as a pandas UDF that loads it once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "query: "):  # noqa: ANN201
    """A column function from text to a vector of unit length; ``load`` gives the model. Blank text raises."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            if (texts.fillna("").str.strip() == "").any():
                raise ValueError("a text is blank")
            vectors = np.asarray(model([prefix + t.strip() for t in texts]), np.float64)
            size = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list((vectors / np.where(size > 0, size, 1)).astype(np.float32)))

    return run


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of token vectors under a mask: [rows, tokens, width] to [rows, width]."""
    weight = mask[..., None].astype(np.float64)
    return (tokens * weight).sum(1) / np.maximum(weight.sum(1), 1)


def pair_scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]):  # noqa: ANN201
    """A column function from question and candidate text to a score."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, candidates in parts:
            yield pd.Series(np.asarray(model(list(questions), list(candidates)), np.float64))

    return run


BEGIN, END, UNKNOWN, MOST_IDS = 0, 2, 3, 510


def model_ids(pieces: list[int], most: int = MOST_IDS) -> list[int]:
    """Ids of a text for the embedding model: pieces one up, the unknown one (0) as 3, cut to the most, between begin and end."""
    return [BEGIN, *[UNKNOWN if p == 0 else p + 1 for p in pieces][:most], END]


def pair_ids(question: list[int], candidate: list[int]) -> list[int]:
    """Ids of a pair for the relevance model: begin, question, end, end, candidate, end, with room for 508 of both."""
    left, right = trim_pair(model_ids(question, len(question))[1:-1], model_ids(candidate, len(candidate))[1:-1])
    return [BEGIN, *left, END, END, *right, END]


def piece_tokenizer(model: bytes):  # noqa: ANN201
    """A column function from two texts to the ids of the pair, by a SentencePiece model loaded once per worker."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        for questions, candidates in parts:
            both = zip(pieces.encode(list(questions.fillna(""))), pieces.encode(list(candidates.fillna(""))), strict=True)
            yield pd.Series([pair_ids(q, c) for q, c in both])

    return run


def trim_pair(left: list[int], right: list[int], room: int = 508) -> tuple[list[int], list[int]]:
    """Two token lists cut to the room, the longer first; of equal ones the left."""
    left, right = list(left), list(right)
    over = len(left) + len(right) - room
    while over > 0:
        (right if len(right) > len(left) else left).pop()
        over -= 1
    return left, right


def hashed_vectors(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in without model files: signed counts of words by hash."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for row, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[row, h % width] += 1 if h & (1 << 20) else -1
        return out

    return run
