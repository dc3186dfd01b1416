"""Vectorised word kernels over UTF-8 bytes: words ``[^\\x20\\x09-\\x0D]+``, 64-bit hashes, shingles.

A word's hash is a polynomial over its bytes modulo 2^64, finished by a mixer; distinct words of a
corpus of 10^9 words share one with probability below 0.03. Everything is a fixed function of the
bytes, so all tasks agree.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_SEEDS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix finisher on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]))
        _inverses = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse, np.uint64)]))
    return _powers, _inverses


class SpanHasher:
    """64-bit hashes of byte spans [start, end) of data; what all spans share is computed once."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.prefix = np.empty(len(data) + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.prefix[ends] - self.prefix[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of data."""
    return SpanHasher(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def words(offsets: np.ndarray, data: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) in bytes: words of all rows in order; row i has words first[i] .. first[i + 1]."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, first) for rows of text."""
    starts, ends, first = words(offsets, data)
    return span_hashes(LOWER[data], starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than ``size`` make one whole shingle, none make none."""
    n = len(hashes)
    out = []
    if n >= size:
        rolled = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            rolled += mix(hashes[k : n - size + 1 + k] ^ np.uint64(_SEEDS[k % len(_SEEDS)] + k // len(_SEEDS))) * np.uint64(_SEEDS[k % len(_SEEDS)])
        rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            seeds = np.array(_SEEDS * (size // len(_SEEDS) + 1), np.uint64)[: b - a]
            out.append(mix(np.add.reduce(mix(hashes[a:b] ^ seeds) * seeds, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
