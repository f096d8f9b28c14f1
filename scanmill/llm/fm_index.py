"""A compressed full-text index over sequences of symbols, searched backwards.

The Burrows-Wheeler transform of all sequences is kept in a wavelet matrix of packed bits
with counts per 64 bits.  Patterns are searched together, one symbol a step.
"""

from __future__ import annotations

import numpy as np

_WORD = 64


class _Bits:
    """A bit vector that counts ones before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // _WORD) * _WORD, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32)

    def ones(self, places: np.ndarray) -> np.ndarray:
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Counts of a symbol before a place, for many (symbol, place) at once."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.levels: list[tuple[int, _Bits, int]] = []
        for level in reversed(range(max(1, int(kinds - 1).bit_length()))):
            bits = (symbols >> level) & 1
            self.levels.append((level, _Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.base = self._descend(np.arange(kinds), np.zeros(kinds, np.int64))

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(places)
            places = np.where((symbols >> level) & 1, zeros + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self._descend(symbols, places) - self.base[symbols]


class FMIndex:
    """Index of sequences of symbols 1, 2, ...; `text` has a 0 after each sequence.

    Suffixes are sorted by their first `depth` symbols, so patterns of up to `depth`
    symbols can be searched.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        size, kinds = len(text), int(text.max(initial=0)) + 1
        rank, known = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while known < depth:
            after = np.zeros(size, np.int64)
            after[: size - known] = rank[known:]
            key = rank * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key)
            placed = key[order]
            rank = np.empty(size, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(placed[1:] != placed[:-1])]) + 1
            known *= 2
        self.places = order  # of the suffixes, in order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        self.tree = WaveletMatrix(text[order - 1], kinds)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matched, low, high) for each row of symbols.

        Symbols are matched from the last to the first as long as what is matched occurs
        at least twice; `matched` counts them, and [low, high) are the suffixes that begin
        with the whole pattern, if all of it is.
        """
        count, length = patterns.shape
        matched = np.zeros(count, np.int64)
        low, high = np.zeros(count, np.int64), np.zeros(count, np.int64)
        active = np.arange(count)
        sp, ep = self.first[patterns[:, -1]], self.first[patterns[:, -1] + 1]
        for step in range(length):
            if step:
                symbol = patterns[active, length - 1 - step]
                sp = self.first[symbol] + self.tree.rank(symbol, sp)
                ep = self.first[symbol] + self.tree.rank(symbol, ep)
            on = ep - sp >= 2
            active, sp, ep = active[on], sp[on], ep[on]
            matched[active] += 1
        low[active], high[active] = sp, ep
        return matched, low, high
