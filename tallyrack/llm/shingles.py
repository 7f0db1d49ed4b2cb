"""Words and word shingles as 64-bit numbers, for many texts at once."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\W_]+")
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of the number."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def factors(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers; the same in every task."""
    return mixed(np.arange(seed * 1000 + 1, seed * 1000 + n + 1, dtype=np.uint64) * STEP) | np.uint64(1)


class Shingler:
    """Shingles of ``width`` words; a text of fewer words is one shingle, one of none has none."""

    def __init__(self, width: int = 5, cache_words: int = 150_000):
        from xxhash import xxh3_64_intdigest

        self.width, self.hash = width, xxh3_64_intdigest
        self.cache: dict[str, int] = {}
        self.cache_words = cache_words

    def words(self, text: str) -> list[str]:
        return WORD.findall(text.lower())

    def numbers(self, words: list[str]) -> np.ndarray:
        cache, make = self.cache, self.hash
        try:
            return np.array([cache[w] for w in words], np.uint64)
        except KeyError:
            if len(cache) > self.cache_words:
                cache.clear()
            for w in [w for w in set(words) if w not in cache]:
                cache[w] = make(w)
            return np.array([cache[w] for w in words], np.uint64)

    def shingles(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of all texts, one after the other, and where each text starts."""
        w = self.width
        sizes = np.array([len(x) for x in numbers], np.int64)
        counts = np.where(sizes >= w, sizes - w + 1, np.minimum(sizes, 1))
        starts = np.concatenate([[0], np.cumsum(counts)])
        every = np.concatenate([*numbers, np.zeros(w, np.uint64)])
        rolled = np.zeros(len(every) - w, np.uint64)
        for k in range(w):
            rolled = rolled * STEP + every[k : len(every) - w + k]
        if not len(rolled):
            return rolled, starts
        first = np.cumsum(sizes) - sizes
        out = rolled[np.repeat(first - starts[:-1], counts) + np.arange(starts[-1])]
        for i in np.flatnonzero((sizes > 0) & (sizes < w)):
            total = int(sizes[i])
            for x in numbers[i].tolist():
                total = (total * int(STEP) + x) % (1 << 64)
            out[starts[i]] = total
        return mixed(out), starts
