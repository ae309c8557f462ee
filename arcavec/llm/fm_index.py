"""An FM-index over a sequence of symbols: wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

from arcavec.llm.suffix import suffix_array


class BitRank:
    """Bits with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        self.words, self.before = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """The levels of a wavelet tree laid out as one row of bits each, zeros of a level before its ones."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            on = (seq >> b & 1).astype(bool)
            self.levels.append((BitRank(on), int(len(on) - on.sum())))
            seq = np.concatenate([seq[~on], seq[on]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        start = np.zeros(len(at), np.int64)
        for level, (ones, zeros) in enumerate(self.levels):
            on = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            before, first = ones.rank(at), ones.rank(start)
            at = np.where(on, zeros + before, at - before)
            start = np.where(on, zeros + first, start - first)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, its occurrences before it)."""
        symbol, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for ones, zeros in self.levels:
            on = ones.get(at)
            symbol = symbol * 2 + on
            before, first = ones.rank(at), ones.rank(start)
            at = np.where(on, zeros + before, at - before)
            start = np.where(on, zeros + first, start - first)
        return symbol, at - start


class FMIndex:
    """Finds patterns of symbols >= 1 in a sequence of symbols >= 1."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 16):
        seq = np.append(seq, 0).astype(np.int64)
        order, _ = suffix_array(seq)
        self.n, bwt = len(seq), seq[order - 1]
        self.tree = WaveletTree(bwt, max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols + 2))])
        marked = order % sample == 0
        self.marked, self.sampled = BitRank(marked), order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns at once: the suffix-array range (lo, hi) of each; rows of ``patterns`` are padded on the right."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((j < lengths) & (lo < hi))
            if not len(live):
                continue
            c = patterns[live, j]
            ranks = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.first[c] + ranks[: len(live)], self.first[c] + ranks[len(live) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by steps back to the nearest sampled one."""
        out, at, steps, live = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live):
            here = at[live]
            found = self.marked.get(here)
            done = live[found]
            out[done] = self.sampled[self.marked.rank(here[found])] + steps[done]
            live = live[~found]
            symbol, rank = self.tree.access(at[live])
            at[live] = self.first[symbol] + rank
            steps[live] += 1
        return out
