"""Distinct word shingles of a text as sorted 64-bit hashes, and their dealing out by hash range in packed rows."""

import numpy as np
import xxhash

from tessaxis.llm.common import words

MIX = np.uint64(0x9E3779B97F4A7C15)
MEMO_ENTRIES = 60_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads all input bits (Stafford's variant 13)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes shingles of n words to 56 bits, the upper ones of 64; a text of fewer words, but not none, has one shingle, its whole sequence."""

    def __init__(self, n: int):
        self.n, self._memo = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = words(text)
        if not found:
            return np.array([], np.uint64)
        memo = self._memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        try:
            h = np.array([memo[w] for w in found], np.uint64)
        except KeyError:
            for w in found:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([memo[w] for w in found], np.uint64)
        k = min(self.n, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = mix(out * MIX + h[i : len(h) - k + 1 + i])
        return np.unique(mix(out + np.uint64(k)) << np.uint64(8))


def signature(shingles: np.ndarray) -> int:
    """A 64-bit hash of the whole set, as a signed number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())))) if len(shingles) else 0


def range_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the 64-bit space each hash lies in."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
