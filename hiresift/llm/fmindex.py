"""Compressed FM-index over a sequence of words, searched backward for many patterns at once.

The transform is kept as a wavelet matrix, one packed bit vector with block
counts for each bit of the alphabet. Suffixes are ordered by their first
``depth`` words, which is all that backward search of patterns up to that
length needs.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before every word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, "uint8")
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("uint64")
        counts = np.bitwise_count(self.words).astype("uint32")
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("uint32")

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = place >> 6
        low = (np.uint64(1) << (place & 63).astype("uint64")) - np.uint64(1)
        return self.before[block].astype("int64") + np.bitwise_count(self.words[block] & low)


class WaveletMatrix:
    """Ranks of any symbol of a sequence of integers from 0 to ``symbols`` - 1."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.shifts = list(range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1))
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        for shift in self.shifts:
            bits = (sequence >> shift) & 1
            self.levels.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        self.first = self._descend(np.arange(symbols), np.zeros(symbols, "int64"))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones = level.rank(place)
            place = np.where((symbol >> shift) & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._descend(symbol, place) - self.first[symbol]


def prefix_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes by their first ``depth`` and by their first ``depth`` - 1 words."""

    def ranked(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype("int64") + 1

    def later(rank: np.ndarray, by: int) -> np.ndarray:
        moved = np.zeros_like(rank)
        if by < len(rank):
            moved[: len(rank) - by] = rank[by:]
        return moved

    rank, known = text + 1, 1
    while known * 2 <= depth - 1:
        rank, known = ranked(rank, later(rank, known)), known * 2
    return tuple(ranked(rank, later(rank, d - known)) if d > known else rank for d in (depth, depth - 1))


class FmIndex:
    """Index of a text whose symbol 0 separates its pieces and ends it."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int):
        """``owner``: a number for each place of the text, of which searches tell the least."""
        self.depth = depth
        symbols = int(text.max(initial=0)) + 1
        full, shorter = prefix_ranks(text, depth)
        order = np.argsort(full, kind="stable")
        self.wavelet = WaveletMatrix(text[order - 1], symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        #: Of each row, the interval of rows that share its first depth - 1 words.
        edges = np.flatnonzero(np.diff(shorter[order], prepend=-1))
        group = np.cumsum(np.diff(shorter[order], prepend=-1) != 0) - 1
        self.wide_low = edges[group]
        self.wide_high = np.append(edges[1:], len(text))[group]
        edges = np.flatnonzero(np.diff(full[order], prepend=-1))
        #: The least owner over the rows that share a row's first depth words.
        self.least = np.repeat(np.minimum.reduceat(owner[order], edges), np.diff(np.append(edges, len(text))))

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        ranks = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.smaller[symbol]
        return base + ranks[: len(symbol)], base + ranks[len(symbol) :]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns of ``depth`` words without their last one."""
        return self.wide_low[low], self.wide_high[low]

    def least_owners(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each place of each streamed piece, the least owner of the ``depth`` words from there.

        A piece is read from its end to its begin: the current match is extended
        by the word in front and shortened at its far end when it is ``depth``
        words long. The biggest integer stands where no such match exists.
        """
        nothing = np.iinfo("int64").max
        out = np.full(len(text), nothing, "int64")
        order = np.argsort(begins - ends, kind="stable")  # the longest first, so that those in progress are a prefix
        begins, ends = begins[order], ends[order]
        low, high = np.zeros(len(order), "int64"), np.full(len(order), len(self.least), "int64")
        matched = np.zeros(len(order), "int64")
        for step in range(int((ends - begins).max(initial=0))):
            n = int(np.searchsorted(begins - ends, -step, side="left"))
            low, high, matched = low[:n], high[:n], matched[:n]
            full = matched == self.depth
            wide_low, wide_high = self.shorten(np.minimum(low, len(self.least) - 1))
            low, high = np.where(full, wide_low, low), np.where(full, wide_high, high)
            matched = matched - full
            place = ends[:n] - 1 - step
            symbol = text[place]
            new_low, new_high = self.extend(low, high, symbol)
            lost = new_low >= new_high
            if lost.any():  # no match holds the word in front and all of the current one: begin again there
                alone = self.smaller[symbol], self.smaller[symbol + 1]
                new_low, new_high = np.where(lost, alone[0], new_low), np.where(lost, alone[1], new_high)
                matched = np.where(lost, 0, matched)
            low, high, matched = new_low, new_high, matched + 1
            found = np.flatnonzero(matched == self.depth)
            out[place[found]] = self.least[low[found]]
        return out
