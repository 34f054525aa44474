"""Hashes of words and of word shingles, computed with whole arrays.

A word is a maximal run of ASCII letters, digits and underscores and of any
non-ASCII characters, in lower case.
"""

from __future__ import annotations

import numpy as np

_WORD_BYTE = np.zeros(256, np.uint8)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
#: Odd numbers: the base of the words' polynomial hash with its inverse modulo 2**64, the factors of a shingle's words, and of the mixing.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = [_powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """The 64-bit hash of each word, in order."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    inside = _WORD_BYTE[raw]
    starts = np.flatnonzero(inside[1:] > inside[:-1]) + 1
    if len(raw) and inside[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(raw) > len(_POWERS[0]):
        _POWERS[:] = [_powers(_BASE, 2 * len(raw)), _powers(_INVERSE, 2 * len(raw))]
    sums = np.add.reduceat((raw * inside + inside).astype(np.uint64) * _POWERS[0][: len(raw)], starts)
    return mixed(sums * _POWERS[1][starts])


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of width words; a text with fewer words has one run, a text without words none."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += words[k : n - width + 1 + k] * np.uint64((_BASE * (2 * k + 3)) % (1 << 64) | 1)
    return np.unique(mixed(out + np.uint64(width)))
