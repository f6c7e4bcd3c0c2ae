"""Five-word shingles as 64-bit hashes, computed batch-wise with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_CACHE_WORDS = 250_000
_cache: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space only: bytes.lower and bytes.split have exactly these classes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, through a bounded per-worker cache."""
    found = list(map(_cache.get, words))
    if None in found:
        if len(_cache) > _CACHE_WORDS:
            _cache.clear()
        digest = xxhash.xxh3_64_intdigest
        for i, h in enumerate(found):
            if h is None:
                w = words[i]
                found[i] = h = digest(w)
                if len(w) <= 64:
                    _cache[w] = h
    return np.array(found, np.uint64)


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all shingles in order, repeats included. Fewer words than size: the whole sequence as one. No words: none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(size, len(h))
    m = len(h) - k + 1
    out = np.full(m, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : i + m]) * _MULTIPLIER
        out ^= out >> _SHIFT
    return out


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of 64 bits (two different shingles of a pair of texts meet with chance 2**-64)."""
    return np.unique(shingle_hashes(text, size))
