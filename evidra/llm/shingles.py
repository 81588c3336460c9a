"""Hashes of five-word shingles, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: bytes) -> np.ndarray:
    """Of each word: A-Z lower-cased, parted by space and the bytes 9 to 13."""
    words = data.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """One hash for each run of ``k`` words, with repeats; with fewer words one for all of them; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = words[: n - k + 1].copy()
    for j in range(1, k):
        out = out * _MUL + words[j : n - k + 1 + j]
    return mixed(out + _U(k))


def shingle_set(data: bytes | None, k: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(data or b""), k))
