"""PartEnum signatures of sets of 63-bit hashes, for operator 11.

Sets of one size band share one division of the feature domain: ``places`` first-level parts by
hash range, each cut into ``SLICES`` slices.  Of every part all subsets of ``SLICES - 1`` slices
that hold a feature are signatures.  Two sets that differ in one feature of a part share one of
its signatures, unless one set has all its features of the part in a single slice, where no
difference at all is needed.  So a part without a common signature holds at least ``cost``
differences: min(2, number of slices with features), counted on either set.

Sets with a similarity of p percent differ in at most ``allowance`` features.  A set whose costs
sum up to more than its allowance shares a signature with every partner.  Sets that hashing
left with less (few, small ones) also emit each feature as a signature of its own, where the
costs always suffice; a pair with one other set is found by that one's account.
"""

from __future__ import annotations

import numpy as np

from watchframe.llm.words import mixed

#: Features of a first-level part in the largest sets of a band, and slices of a part.
FEATURES, SLICES = 7, 3


def band(n: np.ndarray) -> np.ndarray:
    """Band j holds the sizes from 2**j up to 2**(j + 1) - 1."""
    return (np.frexp(n.astype(float))[1] - 1).astype(np.int64)


def allowance(n: np.ndarray, most: np.ndarray, percent: int) -> np.ndarray:
    """How many features a set of n can differ in from one of at most ``most``, if they are similar."""
    return (100 - percent) * (n + most) // (100 + percent)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[ends] - total[starts]


def signatures(sets: list[np.ndarray], percent: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Owners (set, band, level, need) and signatures (token, owner, place, cost) of non-empty sorted sets.

    An owner is a set in the band it is compared in: its own, and the next where partners can be
    that large.  Level 1 are the features themselves.  ``need`` is what the costs of the places
    with a common signature come to at least, with any partner.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    own, top = band(n), 100 * n // percent
    up = np.flatnonzero(band(top) > own)
    who = np.concatenate([np.arange(len(sets)), up])
    bands = np.concatenate([own, own[up] + 1])
    size = n[who]
    most = np.minimum(top[who], 2 ** (bands + 1) - 1)
    allowed = allowance(size, most, percent)
    flat = np.concatenate([sets[i] for i in who.tolist()]) if len(who) else np.zeros(0, np.int64)
    flat = flat.view(np.uint64)
    first = np.concatenate([[0], np.cumsum(size)])
    places = -(-(2 ** (bands + 1)) // FEATURES)
    row = np.repeat(np.arange(len(who)), size)
    place = ((flat >> np.uint64(31)) * places[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    # sets are sorted and places are ranges of hashes, so a place is a run
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])])) if len(flat) else np.zeros(0, np.int64)
    end = np.concatenate([cut[1:], [len(flat)]]).astype(np.int64)[:len(cut)]
    owner, place = row[cut], place[cut]
    piece = ((flat & np.uint64(0x7FFFFFFF)) * np.uint64(SLICES) >> np.uint64(31)).astype(np.int8)
    marks = mixed(flat)
    sums = [_sums(np.where(piece == s, marks, np.uint64(0)), cut, end) for s in range(SLICES)]
    held = [_sums((piece == s).astype(np.int32), cut, end) > 0 for s in range(SLICES)]
    filled = sum(x.astype(np.int64) for x in held)
    cost = np.minimum(2, filled)
    costs = np.bincount(owner, cost, len(who)).astype(np.int64)
    whole = sum(sums)
    tag = mixed((bands[owner] << 40 | place).astype(np.uint64))
    tokens, owners, spots, weights = [], [], [], []
    for s in range(SLICES):
        # without slice s; where only one slice is filled, its content once
        some = (filled > 1) | ((filled == 1) & held[s])
        content = np.where(filled == 1, whole, whole - sums[s])
        tokens.append(mixed(content[some] + tag[some]))
        owners.append(owner[some])
        spots.append(place[some])
        weights.append(cost[some])
    short = np.flatnonzero(costs <= allowed)
    single = np.isin(row, short)
    number = np.full(len(who), -1, np.int64)
    number[short] = len(who) + np.arange(len(short))
    tokens.append(mixed(marks[single] + mixed((bands[row[single]] << 40 | 1 << 39).astype(np.uint64))))
    owners.append(number[row[single]])
    spots.append((np.arange(len(flat)) - first[row])[single])
    weights.append(np.ones(int(single.sum()), np.int64))
    level = np.concatenate([np.zeros(len(who), np.int64), np.ones(len(short), np.int64)])
    both = np.concatenate([np.arange(len(who)), short])
    need = np.where(level == 1, size[both], costs[both]) - allowed[both]
    return ({"set": who[both], "band": bands[both], "level": level, "need": need},
            {"token": np.concatenate(tokens), "owner": np.concatenate(owners), "place": np.concatenate(spots), "cost": np.concatenate(weights)})
