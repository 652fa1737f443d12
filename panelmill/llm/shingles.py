"""Hashed word shingles and MinHash signatures of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)
BLOCK = 4096

_is_word: np.ndarray | None = None


def word_points() -> np.ndarray:
    """For each code point whether it belongs to words: letters, digits, marks inside words (underscore too)."""
    global _is_word
    if _is_word is None:
        _is_word = np.array([chr(i).isalnum() for i in range(0x110000)], bool)
        _is_word[0x5F] = True
    return _is_word


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_B
    h = (h ^ (h >> np.uint64(27))) * MIX_C
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text, in order; words are runs of letters, digits and underscores."""
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_points()[points]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    offset = at - np.repeat(starts, sizes)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), MIX_A, np.uint64)]))
    char = mix(points[at].astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(char * power[offset], np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; of a text with fewer words, one of them all; of none, nothing."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(k, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * MIX_A + words[j : len(words) - n + 1 + j]
    return np.unique(mix(out + np.uint64(n)))


def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each permutation's 32-bit values; blocks bound the memory."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(hashes), BLOCK):
        part = hashes[lo : lo + BLOCK]
        for j in range(0, len(a), 16):
            values = (part[None, :] * a[j : j + 16, None] + b[j : j + 16, None]) >> np.uint64(32)
            least[j : j + 16] = np.minimum(least[j : j + 16], values.min(axis=1).astype(np.uint32))
    return least
