"""Word and word-window hashes of many texts at once with numpy, for use inside tasks.

A word hash is a polynomial over its bytes (each byte first mapped to a random 64-bit number); a
window hash is the Rabin-Karp polynomial over word hashes, taken from prefix sums.  All arithmetic
is modulo 2**64 with odd bases, which have inverses.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1


def mix(x):
    """The splitmix64 finaliser: spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of words and windows; tables of powers grow with need."""

    def __init__(self):
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        self.word_byte = ~space
        self.bases = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
        self.powers = {}
        self.inverses = {}

    def _power(self, which: str, n: int, inverse: bool = False):
        held = self.inverses if inverse else self.powers
        if which not in held or len(held[which]) < n:
            base = self.bases[which]
            base = pow(base, -1, 1 << 64) if inverse else base
            out = np.full(max(n, 4096), base, dtype=np.uint64)
            out[0] = 1
            np.cumprod(out, out=out)
            held[which] = out
        return held[which]

    def words(self, data: np.ndarray):
        """Word hashes of a byte array and the byte offset at which each word begins."""
        inside = self.word_byte[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        lengths = ends - starts
        first = np.zeros(len(starts), np.int64)
        np.cumsum(lengths[:-1], out=first[1:])
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
        value = self.byte[data[inside]] * self._power("byte", int(lengths.max()))[place]
        return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)), starts

    def windows(self, word_hashes: np.ndarray, k: int) -> np.ndarray:
        """Rabin-Karp hash of each run of ``k`` words (empty if there are fewer)."""
        n = len(word_hashes)
        if n < k:
            return np.zeros(0, np.uint64)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes * self._power("word", n, inverse=True)[:n], out=prefix[1:])
        return mix((prefix[k:] - prefix[:-k]) * self._power("word", n + k)[k - 1 : n])

    def whole(self, word_hashes: np.ndarray) -> int:
        """Hash of a whole sequence of words."""
        n = len(word_hashes)
        h = (word_hashes * self._power("word", n + 1)[:n]).sum(dtype=np.uint64) + np.uint64(n)
        return int(mix(np.array([h], np.uint64))[0])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
