"""An FM-index over runs of whole-number symbols, searched for many patterns at once.

The text is a sequence of symbols from 1 up; 0 ends each run. It is held as the
Burrows-Wheeler transform in a wavelet matrix, whose ranks answer both the backward search and
the steps back to the next sampled position of the suffix array.
"""

import numpy as np

from tallymark.llm.common import runs_of

SAMPLE_STEP = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Return the order of all suffixes, by prefix doubling.

    Every 0 sorts by its place, below all symbols, so no comparison passes the end of a run and
    the rounds grow with the logarithm of the longest run, also among thousands of equal runs.
    """
    size = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + np.int64(ends.sum()))
    step = 1
    while True:
        after = np.zeros(size, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        # What follows a run's end plays no part.
        key = rank * (max(int(rank.max()), int(after.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(size, dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all() or step >= size - 1:
            return order
        step *= 2


class BitVector:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Return how many ones lie before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Return the bit at each place."""
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """A sequence of symbols with their ranks, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels = []
        for shift in range(max(1, int(most).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1 == 1
            self.levels.append((shift, BitVector(bits), int(np.count_nonzero(~bits))))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        every = np.arange(most + 1)
        self.first = self._descend(every, np.zeros(most + 1, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Return how often each symbol occurs before each place."""
        return self._descend(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return the symbol at each place and its rank there."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for _, bits, zeros in self.levels:
            one = bits.get(at)
            ones = bits.ones(at)
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


class FMIndex:
    """The index of one shard's text, which must end with 0."""

    def __init__(self, symbols: np.ndarray, most: int, step: int = SAMPLE_STEP):
        symbols = symbols.astype(np.int64)
        order = suffix_array(symbols)
        self.size = len(symbols)
        before = symbols[order - 1]
        self.text = WaveletMatrix(before, most)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=most + 1))])
        # Besides every ``step``-th place, the first of each run: no walk leaves its run.
        sampled = (order % step == 0) | (before == 0)
        self.marks = BitVector(sampled)
        self.places = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return the rows [low, high) of each pattern, by backward search.

        ``patterns`` holds one pattern per row, its symbols at the left.
        """
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lengths > column) & (low < high))
            symbol = patterns[live, column].astype(np.int64)
            both = self.text.rank(
                np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]])
            )
            low[live] = self.less[symbol] + both[: len(live)]
            high[live] = self.less[symbol] + both[len(live) :]
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return for each occurrence the number of its pattern and its place in the text."""
        count = high - low
        pattern = np.repeat(np.arange(len(low)), count)
        row = np.repeat(low, count) + runs_of(count)
        steps = np.zeros(len(row), dtype=np.int64)
        walking = np.flatnonzero(~self.marks.get(row))
        while len(walking):
            symbol, rank = self.text.access(row[walking])
            row[walking] = self.less[symbol] + rank
            steps[walking] += 1
            walking = walking[~self.marks.get(row[walking])]
        return pattern, self.places[self.marks.ones(row)] + steps
