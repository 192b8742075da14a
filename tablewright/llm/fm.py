"""A compressed FM-index over a block of texts: wavelet matrix, ranks and backward search, on numpy arrays."""

from __future__ import annotations

import numpy as np

from tablewright.llm.suffix import Suffixes

U = np.uint64


class Wavelet:
    """Bits of the symbols by level, 64 to a word with a count per word; ranks for many places at once."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels = []
        held = symbols
        for level in reversed(range(self.depth)):
            bits = (held >> level & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bits
            words = np.packbits(padded, bitorder="little").view(U)
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, n - int(bits.sum())))
            held = np.concatenate((held[~bits], held[bits]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place, plus where its symbols begin in the last level."""
        at = place
        for level, (words, before, zeros) in enumerate(self.levels):
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((U(1) << (at & 63).astype(U)) - U(1)))
            bit = (symbol >> (self.depth - 1 - level)) & 1
            at = np.where(bit == 1, zeros + ones, at - ones)
        return at


class FmIndex:
    """Backward search over texts whose symbols are 1 or more; 0 ends each text."""

    def __init__(self, block: np.ndarray, depth: int):
        order = Suffixes(block, depth).order
        self.size = len(block)
        last = block[order - 1]  # the symbol before each suffix
        self.wavelet = Wavelet(last)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(block))))
        # the last level holds each symbol's places together; where they begin
        symbols = np.arange(len(self.first) - 1)
        self.begin = self.wavelet.rank(symbols, np.zeros(len(symbols), np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern, given those of the patterns."""
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        base = np.tile(self.first[symbol] - self.begin[symbol], 2)
        both = both + base
        return both[: len(symbol)], both[len(symbol) :]


#: tokens that are searched first where a match has ended, to leave a unique stretch in one step
PROBE = 3


def repeated_stretches(index: FmIndex, block: np.ndarray, start: np.ndarray, end: np.ndarray, least: int):
    """Streams the texts block[start:end] against the index from right to left, all at once.

    Backward search gives, for an end, the longest match that occurs twice or more. Matches of
    ``least`` tokens or more are reported as (text, from, to), each maximal to the left.
    """
    text = np.arange(len(start))
    start, end = start.astype(np.int64), end.astype(np.int64)
    active = end - start >= least
    text, start, stop = text[active], start[active], end[active]
    at = stop.copy()
    low, high = np.zeros(len(text), np.int64), np.full(len(text), index.size, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(text):
        new_low, new_high = index.extend(block[at - 1], low, high)
        fits = new_high - new_low >= 2
        at = np.where(fits, at - 1, at)
        low, high = np.where(fits, new_low, low), np.where(fits, new_high, high)
        through = fits & (at == start)
        failed = ~fits
        long = (through | failed) & (stop - at >= least)
        if long.any():
            found.append((text[long], at[long] - start[long], stop[long] - start[long]))
        done = through
        if failed.any():
            f = np.flatnonzero(failed)
            left = at[f] - 1  # the token that ended the match
            next_stop = np.where(long[f], left + least, stop[f] - 1)
            # a few tokens from there on: if they are unique, no window may hold them all
            reach = np.minimum(left + PROBE, stop[f])
            p_low, p_high = np.zeros(len(f), np.int64), np.full(len(f), index.size, np.int64)
            for back in range(1, PROBE + 1):
                more = np.flatnonzero((reach - back >= left) & (p_high - p_low >= 2))
                if not len(more):
                    break
                p_low[more], p_high[more] = index.extend(block[reach[more] - back], p_low[more], p_high[more])
            next_stop = np.where(p_high - p_low < 2, np.minimum(next_stop, reach - 1), next_stop)
            stop[f] = next_stop
            at[f] = next_stop
            low[f], high[f] = 0, index.size
            done = through.copy()
            done[f] = next_stop - start[f] < least
        if done.any():
            go = ~done
            text, start, stop, at, low, high = text[go], start[go], stop[go], at[go], low[go], high[go]
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
