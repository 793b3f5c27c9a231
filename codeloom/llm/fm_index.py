"""A compressed full-text index over word numbers: Burrows-Wheeler transform in a wavelet matrix.

Used inside tasks, on one shard's fragments. Bits are packed 64 to a word with a running count for each
word, so the index takes about 1.5 bits a symbol and level, and as much for the weights; the suffix order
is only held while the index is built. Everything works on arrays of many patterns.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)


class FMIndex:
    """Index of a sequence of symbols >= 0, exact for patterns of up to `depth` symbols.

    Suffixes are ordered by their first symbols only, as many as patterns can have: with ties in any
    order, the range of every pattern up to that length is the same as in the full order. `twice` marks
    the places whose strings count as two occurrences.
    """

    def __init__(self, text: np.ndarray, depth: int, twice: np.ndarray):
        n = len(text)
        rank = text.astype(np.int64)
        span = 1
        order = np.argsort(rank)
        while span < depth + 1:
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1
            key = rank * (int(after.max(initial=0)) + 1) + after
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
            span *= 2
            if n and new[-1] == n - 1:
                break
        self.n = n
        self.twice = Bits(twice[order])
        seq = text[order - 1].astype(np.int64)
        self.size = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        self.levels = []
        for shift in range(max(1, int(self.size - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> shift & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bit), n - int(bit.sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.base = self._map(np.arange(self.size), np.zeros(self.size, np.int64))

    def _map(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1 == 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The ranges of symbol + pattern from the ranges of the patterns."""
        begin = self.first[symbol] - self.base[symbol]
        ends = self._map(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return begin + ends[: len(low)], begin + ends[len(low) :]

    def often(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the strings of the ranges occur twice or more."""
        return high - low + self.twice.rank(high) - self.twice.rank(low) >= 2


def repeated_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, windows: np.ndarray, span: int):
    """(owner, first, last): runs of windows of `span` symbols that occur twice, by the number of their pattern.

    Pattern p is text[begin[p]:] with windows[p] windows. Matching statistics: b(e), the first place from which
    the pattern up to place e occurs twice, found by backward search from e, never falls as e grows. One search
    thus settles all windows between b(e) and e (they repeat) and all that end from e on and start before b(e)
    (they don't). The first search starts at a pattern's end; what it leaves is halved.
    """
    owner = np.arange(len(begin))
    low_end, high_end = np.full(len(begin), span), windows + span - 1  # unsettled ends of windows
    end = high_end.copy()
    matched, low, high = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), np.full(len(begin), index.n)
    found: list[tuple] = []
    while len(owner):
        room = matched < end - low_end + span  # beyond that nothing more is settled
        symbol = text[np.where(room, begin[owner] + end - matched - 1, 0)]
        new_low, new_high = index.step(symbol, low, high)
        good = room & index.often(new_low, new_high)
        low, high, matched = np.where(good, new_low, low), np.where(good, new_high, high), matched + good
        done = ~good
        if not done.any():
            continue
        own, lo, hi, e = owner[done], low_end[done], high_end[done], end[done]
        after = e - matched[done] + span  # the least end of a window that starts at b(e) or later
        hit = after <= e
        found.append((own[hit], np.maximum(lo, after)[hit] - span, e[hit] - span))
        own, lo, hi = np.concatenate([own, own]), np.concatenate([lo, np.maximum(e + 1, after)]), np.concatenate([np.minimum(e, after) - 1, hi])
        left = lo <= hi
        own, lo, hi = own[left], lo[left], hi[left]
        owner, low_end, high_end, end = (np.concatenate([x[good], y]) for x, y in ((owner, own), (low_end, lo), (high_end, hi), (end, (lo + hi) // 2)))
        matched, low, high = (np.concatenate([x[good], np.full(len(own), y)]) for x, y in ((matched, 0), (low, 0), (high, index.n)))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
