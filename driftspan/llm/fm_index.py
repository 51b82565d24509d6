"""A compressed FM-index in numpy: Burrows-Wheeler transform, wavelet matrix, backward search.

The index holds segments (lists of word numbers) in order of their owners. Its searches are
vectorised: many patterns take their next step together. Beside the transform it keeps, per
suffix, the rank of the segment's owner, with range minima over suffix intervals, so a search
can be held to occurrences in segments of smaller owners.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of symbols in order, by prefix doubling from packed triples; separators must be distinct symbols."""
    n = len(symbols)
    width = int(symbols.max()) + 2
    s = symbols.astype(np.int64) + 1
    ahead = lambda a, k: np.concatenate([a[k:], np.zeros(min(k, n), a.dtype)])
    if width < 1 << 21:
        key, k = (s * width + ahead(s, 1)) * width + ahead(s, 2), 3
    else:
        key, k = s * width + ahead(s, 1), 2
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        if rank[order[-1]] == n or k >= n:
            return order
        key = rank * (n + 1) + ahead(rank, k)
        k *= 2


class WaveletMatrix:
    """rank of a symbol in a prefix, from one bit vector a level: 64-bit words with counts before each."""

    def __init__(self, sequence: np.ndarray, bits: int):
        n = len(sequence)
        self.bits, self.words, self.before, self.zeros = bits, [], [], []
        current = sequence
        for level in range(bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)[:-1]]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefixes [0, at) end below their symbols' nodes; less the node's start, it is the rank."""
        at = at.astype(np.int64)
        for level in range(self.bits):
            word, low = at >> 6, (at & 63).astype(np.uint64)
            ones = self.before[level][word] + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << low) - np.uint64(1)))
            one = (symbol >> (self.bits - 1 - level)) & 1 > 0
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Segments of word numbers (from 1 on; 0 stands for every separator) with their owners, ascending."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray):
        n_segments = len(segments)
        lengths = np.array([len(s) for s in segments])
        total = int(lengths.sum()) + n_segments
        ends = np.cumsum(lengths + 1) - 1
        self.starts = np.concatenate([[0], ends[:-1] + 1])
        self.lengths = lengths
        text = np.zeros(total, np.int64)
        inside = np.ones(total, bool)
        inside[ends] = False
        text[inside] = np.concatenate(segments)
        self.text = text
        distinct = text + n_segments
        distinct[ends] = np.arange(n_segments)  # separators differ, so the order ends within segments
        order = suffix_array(distinct)
        transform = text[order - 1]
        self.bits = max(1, int(text.max()).bit_length())
        self.wavelet = WaveletMatrix(transform, self.bits)
        symbols = np.arange(int(text.max()) + 2)
        counts = np.bincount(text, minlength=len(symbols))
        node = self.wavelet.descend(symbols, np.zeros(len(symbols), np.int64))
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]]) - node
        self.size = total
        rank = np.unique(owners, return_inverse=True)[1].astype(np.int32)
        self.rank = rank
        owner = np.repeat(rank, lengths + 1)[order]
        self.minima = [owner]
        step = 1
        while 2 * step <= total:
            m = self.minima[-1]
            self.minima.append(np.minimum(m[:-step], m[step:]))
            step *= 2

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffix intervals of symbol + pattern."""
        both = self.wavelet.descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.first[symbol], 2)
        return both[: len(lo)], both[len(lo) :]

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner's rank in each interval; intervals must not be empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level):
            at = level == k
            m = self.minima[k]
            out[at] = np.minimum(m[lo[at]], m[hi[at] - (1 << k)])
        return out

    def earlier_windows(self, window: int) -> list[list[tuple[int, int]]]:
        """For each segment the intervals [from, to) of window starts whose window occurs in a segment of a smaller owner.

        From a segment's end, backward search finds the longest match that ends there; all its
        windows are reported and the search goes on where the next unknown window ends. If it
        failed at a word, ever longer patterns from that word on are tried: one that has no
        earlier occurrence lets the search go on before the pattern's end.
        """
        n = len(self.lengths)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        seg = np.flatnonzero((self.lengths >= window) & (self.rank > 0))
        end = self.lengths[seg] - 1  # the search's last word
        at = end.copy()  # the word to prepend
        lo, hi = np.zeros(len(seg), np.int64), np.full(len(seg), self.size, np.int64)
        probe = np.full(len(seg), -1)  # -1: a main search; else the size of the pattern tried from word `stop`
        stop = np.zeros(len(seg), np.int64)
        main_end = end.copy()
        while len(seg):
            symbol = self.text[self.starts[seg] + at]
            new_lo, new_hi = self.extend(symbol, lo, hi)
            ok = new_hi > new_lo
            if ok.any():
                ok[ok] = self.least_owner(new_lo[ok], new_hi[ok]) < self.rank[seg[ok]]
            lo, hi = new_lo, new_hi
            at = np.where(ok, at - 1, at)
            main = probe < 0
            arrived = ok & (at < np.where(main, 0, stop))
            over = arrived | ~ok
            idx = np.flatnonzero(over)
            if len(idx):
                is_main = main[idx]
                # a main search is over: the match is [at + 1, end]
                i = idx[is_main]
                left = at[i] + 1
                long = main_end[i] - left + 1 >= window
                for j in i[long].tolist():
                    found[seg[j]].append((int(at[j] + 1), int(main_end[j] - window + 2)))
                blocked = at[i] >= 0
                # after a long match the next unknown window ends just before the known ones; after a short
                # one no window that ends here can match, for each would hold the word that failed
                main_end[i] = np.where(long, left + window - 2, main_end[i] - 1)
                stop[i] = np.where(blocked, at[i], 0)
                probe[i] = np.where(blocked, np.where(stop[i] <= main_end[i], 1, -1), 0)
                # a probe is over: absent patterns move the end, present ones are made longer
                i = idx[~is_main]
                absent = ~ok[i]
                size = probe[i]
                main_end[i] = np.where(absent, np.minimum(main_end[i], stop[i] + size - 2), main_end[i])
                longer = ~absent & (stop[i] + 4 * size - 1 < main_end[i])
                probe[i] = np.where(longer, 4 * size, -1)
                # start the next search of each
                done = np.zeros(len(seg), bool)
                fresh = probe[idx]
                done[idx] = fresh == 0
                probing = fresh > 0
                begin = np.where(probing, np.minimum(stop[idx] + fresh - 1, main_end[idx]), main_end[idx])
                done[idx] |= (main_end[idx] < window - 1)
                at[idx] = np.maximum(begin, 0)
                lo[idx], hi[idx] = 0, self.size
                if done.any():
                    keep = ~done
                    seg, at, lo, hi, probe, stop, main_end = (a[keep] for a in (seg, at, lo, hi, probe, stop, main_end))
        return found
