"""Hashed sets of word shingles, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240117)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (A-Z lower-cased) of a batch, and the bounds of each text's words."""
    data = np.frombuffer(b" ".join(t.lower() for t in texts), dtype=np.uint8)
    letter = ~_SPACE[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    at = np.flatnonzero(letter)
    starts = np.flatnonzero(first)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths))))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds
    begin = np.flatnonzero(first[at])  # index of each word's first letter among the letters
    size = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, size)
    powers = np.full(int(size.max()), _STEP, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return mix(np.add.reduceat(_BYTE[data[at]] * powers[place], begin) + size.astype(np.uint64)), bounds


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; a shorter text is one shingle."""
    words, bounds = word_hashes([t.encode() for t in texts])
    n = len(words) - WORDS + 1
    if n > 0:
        rolled = mix(sum(words[k : k + n] * _PLACE[k] for k in range(WORDS)))
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= WORDS:
            own = np.sort(rolled[a : b - WORDS + 1])
            keep = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
