"""Numpy helpers for text in Arrow batches: pieces of bounded size, words, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Base of the rolling hashes: odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(None)
def byte_codes(fold: bool) -> np.ndarray:
    """A random 64-bit number for each byte; with fold, the same for A-Z as for a-z."""
    codes = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


_POWERS = {"n": 0, "up": None, "down": None}
#: Longest table that a worker keeps; a longer text has its own while it is read.
KEPT_POWERS = 1 << 21


def both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > KEPT_POWERS:
        return powers(BASE, n), powers(INVERSE, n)
    if _POWERS["n"] < n:
        size = max(n, 1 << 16)
        _POWERS.update(n=size, up=powers(BASE, size), down=powers(INVERSE, size))
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that their order is as good as random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any spans of a byte array, each in constant time."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        self.up, self.down = both_powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_codes(fold)[data] * self.up[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def pieces(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about ``most`` bytes together; a longer text is a piece alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank after each as one array, and where each begins (one more at the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return data, at


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-blank bytes."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~BLANK[data]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
