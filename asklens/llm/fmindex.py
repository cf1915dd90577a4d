"""An FM-index over a sequence of small integers: backward search and locate, for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling; zeros differ, the earlier is smaller."""
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        steps = np.empty(n, np.int64)
        steps[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = steps
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class WaveletMatrix:
    """Rank of any symbol in any prefix, one bit plane for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``place``, elementwise."""
        low, high = np.zeros_like(place), place
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbol at ``place``."""
        symbol = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[place + 1] > ones[place]
            symbol = symbol * 2 + one
            place = np.where(one, zeros + ones[place], place - ones[place])
        return symbol


class FMIndex:
    """Index of ``text`` (integers from 0; 0 separates runs and is never searched).

    Every ``step``-th position and each first of a run keeps its suffix position, so locating a row
    walks back fewer than ``step`` places and never over a separator.
    """

    def __init__(self, text: np.ndarray, step: int = 16):
        text = np.concatenate([np.asarray(text, np.int64), [0]])
        order = suffix_order(text)
        before = text[order - 1]  # place 0 wraps round to the closing separator
        self.size = int(text.max()) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        self.tree = WaveletMatrix(before, max(1, int(self.size - 1).bit_length()))
        self.sampled = (order % step == 0) | (before == 0)
        self.place = np.concatenate([[0], np.cumsum(self.sampled)])
        self.kept = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the rows that begin with each pattern (rows of a 2-d array of symbols from 1)."""
        n, width = patterns.shape
        low, high = np.zeros(n, np.int64), np.full(n, self.starts[-1], np.int64)
        left = np.flatnonzero((patterns < self.size).all(axis=1))
        outside = np.setdiff1d(np.arange(n), left)
        high[outside] = 0
        for k in range(width - 1, -1, -1):
            symbol = patterns[left, k]
            low[left] = self.starts[symbol] + self.tree.rank(symbol, low[left])
            high[left] = self.starts[symbol] + self.tree.rank(symbol, high[left])
            left = left[low[left] < high[left]]
            if len(left) == 0:
                break
        found = low < high
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.flatnonzero(~self.sampled[rows])
        while len(left):
            symbol = self.tree.at(rows[left])
            rows[left] = self.starts[symbol] + self.tree.rank(symbol, rows[left])
            steps[left] += 1
            left = left[~self.sampled[rows[left]]]
        return self.kept[self.place[rows]] + steps
