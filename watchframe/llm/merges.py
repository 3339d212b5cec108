"""Byte-pair merges by segment trees over the ranks of adjacent pairs.

A pre-token's symbols are the positions of a tree whose leaf i holds ``rank * width + i``
for the pair that starts at i (or NONE).  The root therefore names the leftmost pair of the
lowest rank; a merge changes three leaves, whose paths are recomputed in logarithmic time,
until the root says that no pair can be merged.  ``encode_many`` does so for many short
pre-tokens at once, one numpy row a tree; ``encode_long`` for a single long one.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import regex

NONE = np.iinfo(np.int64).max
LONG = 128
#: White space as Unicode has it; the classes of the two pre-tokenizers below use it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token patterns that the vocabulary files name.
SPLIT_BYTES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
SPLIT_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary file: start symbols, merge ranks, bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        pairs = np.array([(ids[a], ids[b]) for a, b in model["merges"]], np.int64).reshape(-1, 2)
        self.made = np.array([ids[a + b] for a, b in model["merges"]], np.int64)
        self.ranks = {(int(a), int(b)): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self._table(np.array([a << 20 | b for a, b in self.ranks], np.int64), np.fromiter(self.ranks.values(), np.int64))
        number = {c: b for b, c in enumerate(letters)}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.end, self.names = end, ids
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in ids.items():
            self.bytes_of[i] = bytes(number[c] for c in word.removesuffix(end))
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.digits = [str(i) for i in range(size)]

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open-addressed table of pair -> rank, looked up for many pairs at once."""
        bits = max(4, int(len(keys)).bit_length() + 2)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        spot, left = self._spot(keys), np.arange(len(keys))
        while len(left):
            at = spot[left]
            free = self._keys[at] == -1
            chosen = left[free][np.unique(at[free], return_index=True)[1]]
            self._keys[spot[chosen]], self._values[spot[chosen]] = keys[chosen], values[chosen]
            left = left[self._keys[spot[left]] != keys[left]]
            spot[left] = (spot[left] + 1) & self._mask

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for a pair that does not merge."""
        keys = left << 20 | right
        spot = self._spot(keys)
        found = self._keys[spot]
        out = np.where(found == keys, self._values[spot], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            spot[open_] = (spot[open_] + 1) & self._mask
            found = self._keys[spot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._values[spot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    @cached_property
    def special_pattern(self):
        return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    def symbols(self, word: bytes) -> np.ndarray:
        out = self.first[np.frombuffer(word, np.uint8)]
        if len(out):
            out[-1] = self.last[word[-1]]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_long(voc: Vocabulary, word: bytes) -> list[int]:
    """One pre-token of any length, with one tree in a list: n log n steps."""
    ids = voc.symbols(word).tolist()
    n = len(ids)
    width = 1 << max(0, n - 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * width)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> int:
        if i < 0 or nxt[i] >= n:
            return none
        rank = voc.ranks.get((ids[i], ids[nxt[i]]), -1)
        return rank * width + i if rank >= 0 else none

    for i in range(n):
        tree[width + i] = leaf(i)
    for j in range(width - 1, 0, -1):
        tree[j] = min(tree[2 * j], tree[2 * j + 1])
    while n > 1 and tree[1] != none:
        i = tree[1] % width
        gone = nxt[i]
        ids[i], after = int(voc.made[tree[1] // width]), nxt[gone]
        nxt[i], ids[gone] = after, -1
        if after < n:
            prv[after] = i
        for at, value in ((gone, none), (i, leaf(i)), (prv[i], leaf(prv[i]))):
            if at >= 0:
                j = width + at
                tree[j] = value
                while j > 1:
                    j >>= 1
                    low = min(tree[2 * j], tree[2 * j + 1])
                    if tree[j] == low:
                        break
                    tree[j] = low
    return [x for x in ids if x >= 0]


def _encode_rows(voc: Vocabulary, words: list[bytes], width: int) -> list[bytes]:
    """Pre-tokens of 2 to ``width`` bytes, a row of the arrays each; width is a power of two."""
    m = len(words)
    sizes = np.fromiter(map(len, words), np.int64, m)
    padded = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
    spots = np.arange(width)
    inside = spots < sizes[:, None]
    ids = np.where(inside, voc.first[padded], -1)
    rows = np.arange(m)
    ids[rows, sizes - 1] = voc.last[padded[rows, sizes - 1]]
    levels = width.bit_length() - 1
    tree = np.full((m, 2 * width), NONE)
    pair = spots[:-1] + 1 < sizes[:, None]
    ranks = voc.rank(ids[:, :-1][pair], ids[:, 1:][pair])
    leaves = np.full((m, width), NONE)
    at = np.nonzero(pair)
    leaves[at] = np.where(ranks >= 0, ranks * width + at[1], NONE)
    tree[:, width:] = leaves
    for level in range(levels - 1, -1, -1):
        lo = 1 << level
        below = tree[:, 2 * lo:4 * lo]
        tree[:, lo:2 * lo] = np.minimum(below[:, ::2], below[:, 1::2])
    nxt = np.tile(spots + 1, (m, 1))
    prv = np.tile(spots - 1, (m, 1))
    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        root = tree[live, 1]
        i, made = root % width, voc.made[root // width]
        gone = nxt[live, i]
        after = nxt[live, gone]
        before = prv[live, i]
        ids[live, i], ids[live, gone], nxt[live, i] = made, -1, after
        n = sizes[live]
        more = after < n
        prv[live[more], after[more]] = i[more]
        # the three leaves: the symbol that went, the new one, the one before it
        tree[live, width + gone] = NONE
        value = np.full(len(live), NONE)
        r = voc.rank(made[more], ids[live[more], after[more]])
        value[more] = np.where(r >= 0, r * width + i[more], NONE)
        tree[live, width + i] = value
        has = before >= 0
        r = voc.rank(ids[live[has], before[has]], made[has])
        tree[live[has], width + before[has]] = np.where(r >= 0, r * width + before[has], NONE)
        row = np.concatenate([live, live, live[has]])
        node = np.concatenate([width + gone, width + i, width + before[has]])
        for _ in range(levels):
            node >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        live = live[tree[live, 1] != NONE]
    keep = ids >= 0
    flat, ends = ids[keep].astype("<u4").tobytes(), (4 * np.cumsum(keep.sum(1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode_many(voc: Vocabulary, words: list[bytes], at_once: int = 20_000) -> list[bytes]:
    """Ids of many distinct pre-tokens, each merged on its own, as little-endian 32-bit integers."""
    out = [b""] * len(words)
    single = [int(i).to_bytes(4, "little") for i in voc.last]
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        n = len(w)
        if n == 1:
            out[k] = single[w[0]]
        elif n > LONG:
            out[k] = np.array(encode_long(voc, w), "<u4").tobytes()
        elif n:
            by.setdefault(1 << (n - 1).bit_length(), []).append(k)
    for width, places in by.items():
        step = max(1, at_once * 8 // width)
        for s in range(0, len(places), step):
            part = places[s:s + step]
            for k, ids in zip(part, _encode_rows(voc, [words[k] for k in part], width), strict=True):
                out[k] = ids
    return out
