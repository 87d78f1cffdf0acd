"""An FM-index over integer sequences, for many patterns at once."""

import numpy as np

#: Every so many positions of the text, the suffix array keeps its value.
SAMPLE = 16


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes, by prefix doubling on those that are still tied.

    The last symbol of the text must occur nowhere else.
    """
    n = len(text)
    width = max(1, min(62 // bits, 6))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[:max(0, n - k)] |= text[k:]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    tied = np.arange(n)
    sorted_key, reach = key[order], width
    while True:
        opens = np.ones(len(tied), bool)
        opens[1:] = sorted_key[1:] != sorted_key[:-1]
        first = np.maximum.accumulate(np.where(opens, np.arange(len(tied)), 0))
        rank[order[tied]] = tied[first]
        single = opens.copy()
        single[:-1] &= opens[1:]
        tied = tied[~single]
        if not len(tied):
            return order
        rows = order[tied]
        pair = (rank[rows] << 32) | rank[rows + reach]
        by = np.argsort(pair, kind="stable")
        order[tied] = rows[by]
        sorted_key = pair[by]
        reach *= 2


class Bits:
    """A bit sequence with constant-time rank."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.words = np.zeros(len(flags) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word, low = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Wavelet levels of a sequence, most significant bit first, each level stably parted by its bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, self.bits = [], bits
        for k in reversed(range(bits)):
            flags = (values >> k) & 1 == 1
            zeros = int(len(values) - flags.sum())
            self.levels.append((k, Bits(flags), zeros))
            values = np.concatenate([values[~flags], values[flags]])

    def rank(self, symbol: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each of the positions."""
        ends = [np.zeros(len(symbol), np.int64), *positions]
        for k, flags, zeros in self.levels:
            one = (symbol >> k) & 1 == 1
            for j, at in enumerate(ends):
                ones = flags.rank(at)
                ends[j] = np.where(one, zeros + ones, at - ones)
        return [at - ends[0] for at in ends[1:]]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol, begin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k, flags, zeros in self.levels:
            one = flags.get(at)
            symbol |= one.astype(np.int64) << k
            a, b = flags.rank(at), flags.rank(begin)
            at, begin = np.where(one, zeros + a, at - a), np.where(one, zeros + b, begin - b)
        return symbol, at - begin


class FMIndex:
    """Index of a text whose last symbol occurs nowhere else."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        bits = max(1, int(text.max()).bit_length())
        order = suffix_array(text, bits)
        self.size = len(text)
        self.wavelet = Wavelet(text[order - 1], bits)
        self.before = np.zeros(int(text.max()) + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=len(self.before) - 1), out=self.before[1:])
        kept = order % sample == 0
        self.marks, self.kept = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each row of ``patterns``, by backward search; empty ranges if absent."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        alive = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, column]
            a, b = self.wavelet.rank(symbol, low[alive], high[alive])
            low[alive], high[alive] = self.before[symbol] + a, self.before[symbol] + b
            alive = alive[b > a]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: walk back until a sampled position."""
        found, walked = np.empty(len(rows), np.int64), 0
        rows, alive = rows.copy(), np.arange(len(rows))
        while len(alive):
            marked = self.marks.get(rows[alive])
            done = alive[marked]
            found[done] = self.kept[self.marks.rank(rows[done])] + walked
            alive = alive[~marked]
            symbol, rank = self.wavelet.symbol_and_rank(rows[alive])
            rows[alive] = self.before[symbol] + rank
            walked += 1
        return found
