"""Suffix order, common prefixes and previous factors of a block of short texts, on numpy arrays.

A block is one array of numbers: the tokens of each text (1 or more) followed by a 0. Suffixes
end at the 0 of their own text.
"""

from __future__ import annotations

import numpy as np


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the keys and their order, equal keys by place."""
    n = len(keys)
    bits = max(1, (n - 1).bit_length())
    if int(keys.max(initial=0)) >> (63 - bits) == 0:  # key and place fit one number: sort them together
        packed = np.sort((keys << bits) | np.arange(n))
        order, ordered = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    ranks = np.empty(n, np.int64)
    ranks[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    return ranks, order


class Suffixes:
    """The suffixes of a block, ordered by their first ``depth`` tokens (rounded up), then by place."""

    def __init__(self, block: np.ndarray, depth: int, packed: int = 1):
        """``packed`` tokens form the first key; they must fit 63 bits together."""
        n = len(block)
        self.block = block
        ends = np.flatnonzero(block == 0)
        self.stop = ends[np.searchsorted(ends, np.arange(n))]
        width = int(block.max(initial=1)).bit_length()
        keys = np.zeros(n, np.int64)
        place = np.arange(n)
        for j in range(packed):
            keys = (keys << width) | block[np.minimum(place + j, self.stop)]
        ranks, self.order = dense(keys)
        self.levels = [(packed, ranks)]
        span = packed
        while span < depth:
            ranks, self.order = dense(ranks * (int(ranks.max(initial=0)) + 1) + ranks[np.minimum(place + span, self.stop)])
            span *= 2
            self.levels.append((span, ranks))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, exact up to the depth."""
        most = np.minimum(self.stop[a] - a, self.stop[b] - b)
        got = np.zeros(len(a), np.int64)
        for span, ranks in reversed(self.levels):
            same = ranks[np.minimum(a + got, self.stop[a])] == ranks[np.minimum(b + got, self.stop[b])]
            got += span * same
        for _ in range(self.levels[0][0] - 1):  # what is shorter than the first key, token by token
            same = self.block[np.minimum(a + got, self.stop[a])] == self.block[np.minimum(b + got, self.stop[b])]
            got += same & (got < most)
        return np.minimum(got, most)


def _nearest_smaller(values: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each place, the least of ``shared`` on the way back to the nearest smaller value (0: there is none).

    ``shared[r]`` belongs to the step from place r - 1 to r. Links are shortened for all places
    at once: a place whose link leads to a larger value takes over that one's link.
    """
    n = len(values)
    link = np.arange(-1, n - 1)
    least = shared.copy()
    open_ = np.flatnonzero((link >= 0) & (values[link] > values))
    while len(open_):
        via = link[open_]
        least_now = np.minimum(least[open_], least[via])
        link_now = link[via]
        least[open_], link[open_] = least_now, link_now
        open_ = open_[(link_now >= 0) & (values[link_now] > values[open_])]
    return np.where(link >= 0, least, 0)


def previous_factors(suffixes: Suffixes, places: np.ndarray, later: bool = False) -> np.ndarray:
    """Longest previous factor of each place: the longest match that starts at a smaller one of ``places``.

    In suffix order the match is with the previous or the next smaller place, and its length is
    the least common prefix on the way there. ``later`` looks at larger places instead.
    """
    chosen = np.zeros(len(suffixes.block), bool)
    chosen[places] = True
    ordered = suffixes.order[chosen[suffixes.order]]
    if not len(ordered):
        return np.zeros(0, np.int64)
    shared = np.concatenate(([0], suffixes.common(ordered[:-1], ordered[1:])))
    values = -ordered if later else ordered
    back = _nearest_smaller(values, shared)
    ahead = _nearest_smaller(values[::-1], np.concatenate(([0], shared[:0:-1])))[::-1]
    out = np.zeros(len(suffixes.block), np.int64)
    out[ordered] = np.maximum(back, ahead)
    return out[places]
