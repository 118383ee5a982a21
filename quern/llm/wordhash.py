"""Vectorised words of many texts: starts, ends and 64-bit hashes from byte classes, without a Python loop per word."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space of ASCII ends.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of digits, a-z and all that isn't ASCII (for bytes already in lower case).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none reaches over the end of its text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets[offsets <= n]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | fresh[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal words wherever they stand."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words (order counts); also those that cross texts, for the caller to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += mix(words[k : k + n] + _PLACES[k]) * _PLACES[k]
        return mix(total + np.uint64(size))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of size words; a text of fewer words has its whole sequence as one, a text without words has none."""
    starts, ends = spans(data, offsets, member)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets[:-1])
    last = np.append(first[1:], len(starts))
    runs = windows(words, size)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(windows(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
