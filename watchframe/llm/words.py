"""Words of texts as 64-bit hashes, by bytes: splitting, hashing, windows."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z lower-cased, and everything but digits, letters and bytes beyond ASCII as a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class WordHashes:
    """64-bit hash of each word, remembered for up to ``memory`` words."""

    def __init__(self, memory: int = 400_000):
        self.memory, self.known = memory, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.memory:
                known.clear()
                new = set(words)
            digest = xxhash.xxh3_64_intdigest
            known.update({w: digest(w) for w in new})
        return np.fromiter([known[w] for w in words], np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that looks random."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A run's hash is a polynomial in this odd number modulo 2**64, mixed; so many bytes are summed up at once.
BASE, PIECE = 0x9E3779B97F4A7C15, 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class RunHashes:
    """Hashes of runs of bytes (ascending, not overlapping) from running sums, a bounded piece of bytes at a time."""

    def __init__(self, piece: int | None = None):
        self.piece = piece or PIECE
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            low = int(start[at])
            stop = max(at + 1, int(np.searchsorted(end, low + self.piece, "right")))
            size = int(end[stop - 1]) - low
            if size > len(self.up):
                self.up, self.down = _powers(BASE, max(size, self.piece)), _powers(pow(BASE, -1, 1 << 64), max(size, self.piece))
            sums = np.zeros(size + 1, np.uint64)
            # digits from one up, so runs of different lengths differ; the start is divided out
            np.add(raw[low:low + size], 1, out=sums[1:], dtype=np.uint64)
            sums[1:] *= self.up[:size]
            np.cumsum(sums, out=sums)
            a, z = start[at:stop] - low, end[at:stop] - low
            out[at:stop] = mixed((sums[z] - sums[a]) * self.down[a])
            at = stop
        return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order; runs of different sizes differ."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size))
    for j in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + n]
    return mixed(total)


def bounds(lists: list[list]) -> np.ndarray:
    """Start of each list in their concatenation, and the end."""
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
