"""A wavelet matrix over an order of positions, and exact names of stretches of 2**k symbols.

Used inside tasks, on the texts of one run. All queries are on arrays of ranges.
"""

from __future__ import annotations

import numpy as np

from codeloom.llm.fm_index import Bits


class WaveletMatrix:
    """Ranges of a sequence of whole numbers below n: how many are below a bound, and the k-th least of them."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.width = max(1, int(self.n).bit_length())
        seq, self.levels = values.astype(np.int32), []
        for shift in range(self.width - 1, -1, -1):
            bit = (seq >> shift & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bit), self.n - int(bit.sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Values of [low, high) that are below the bound."""
        bound = np.minimum(bound, self.n)
        out = np.zeros(len(low), np.int64)
        for shift, bits, zeros in self.levels:
            a, b = bits.rank(low), bits.rank(high)
            one = (bound >> shift & 1) == 1
            out += np.where(one, (high - b) - (low - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return out

    def least(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value (from 0) of [low, high), which must hold more than k."""
        out = np.zeros(len(low), np.int64)
        for shift, bits, zeros in self.levels:
            a, b = bits.rank(low), bits.rank(high)
            few = (high - b) - (low - a)
            one = k >= few
            k, out = np.where(one, k - few, k), out | one.astype(np.int64) << shift
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return out


class Names:
    """Names of the stretches of 2**k symbols from each place, for k up to `most`: equal stretches, equal names.

    A name is the first place of its stretches in the suffix order, which is refined level by level, each time for
    those only that are still alike. Stretches over the end must be unique (let the last symbol be so). Levels at
    which all are unique are left out: nothing is alike there.
    """

    def __init__(self, text: np.ndarray, most: int):
        n = len(text)
        self.order = np.argsort(text, kind="stable")
        self.levels: list[np.ndarray] = []
        key, part, places = text[self.order].astype(np.int64), self.order, np.arange(n)
        name = np.zeros(n, np.int32)
        for k in range(most + 1):
            first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            name = name.copy()
            name[part] = np.maximum.accumulate(np.where(first, places, 0)) if len(key) else 0
            alike = ~(first & np.append(first[1:], True))
            if not alike.any():
                break
            self.levels.append(name)
            places = places[alike]
            part = self.order[places]
            after = part + (1 << k)
            key = name[part].astype(np.int64) * (n + 1) + np.where(after < n, name[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key)
            key, part = key[by], part[by]
            self.order[places] = part

    def sizes(self, k: int) -> np.ndarray:
        """How many stretches have the name."""
        return np.bincount(self.levels[k], minlength=len(self.order))

    def _alike(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        n, i, j = len(self.order), i.copy(), j.copy()
        begin, top = i.copy(), len(self.levels) - 1
        for k in range(top, -1, -1):
            name, step = self.levels[k], 1 << k
            on = np.arange(len(i))
            while len(on):
                a, b = (i[on], j[on]) if way > 0 else (i[on] - step, j[on] - step)
                good = (a >= 0) & (b >= 0) & (a < n) & (b < n)
                good &= name[np.clip(a, 0, n - 1)] == name[np.clip(b, 0, n - 1)]
                on = on[good]
                i[on] += way * step
                j[on] += way * step
                if k < top:  # what is left is shorter than the level above
                    break
        return np.abs(i - begin)

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on are those from j on, for i and j that differ."""
        return self._alike(i, j, 1)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i are those before j."""
        return self._alike(i, j, -1)
