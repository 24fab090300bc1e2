"""A run-length compressed FM-index over integer symbols, with matching statistics (numpy, used inside tasks).

The index is made once over a text and answers for any pattern.  Its Burrows-Wheeler transform is kept as runs: a
bit vector marks where runs start, a wavelet matrix holds one symbol for each run, and the runs' lengths are summed
by symbol.  Patterns are read from their ends, all in lockstep: a step of backward search adds a word to the left of
each match; where it fails, the match loses words on its right until it can go on, which the lengths of common
prefixes (kept as minima over ranges) allow.  What is left after each step is the longest match that starts there.
"""

from __future__ import annotations

import numpy as np

NO_DOC = np.iinfo(np.int64).max
#: Symbols that the suffixes are ordered by; matches are shorter.
DEPTH = 64


class Ranked:
    """A bit vector with rank: bits packed in 64-bit words and counts before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        i, j = at >> 6, (at & 63).astype(np.uint64)
        return self.before[i].astype(np.int64) + np.bitwise_count(self.words[i] & ((np.uint64(1) << j) - np.uint64(1)))


class Wavelet:
    """A wavelet matrix: rank of any symbol below 2**levels."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = []
        for level in range(max(1, sigma.bit_length()) - 1, -1, -1):
            one = ((symbols >> level) & 1).astype(bool)
            self.levels.append((level, Ranked(one.view(np.uint8)), int(len(one) - one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        self.origin = self._path(np.arange(sigma), np.zeros(sigma, np.int64))

    def _path(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((c >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._path(c, at) - self.origin[c]


class FMIndex:
    """An index over pieces of symbols 1..sigma-1; `docs` names the document of each piece.

    cap: matches are followed up to this length, and of every match as long the smallest document is known.
    """

    def __init__(self, pieces: list[np.ndarray], docs: np.ndarray, sigma: int, cap: int) -> None:
        if not 0 < cap < DEPTH:
            raise ValueError(f"cap must be from 1 to {DEPTH - 1}")
        length = np.array([len(p) for p in pieces], np.int64)
        text = np.zeros(int((length + 1).sum()), np.int64)
        own = np.ones(len(text), bool)
        own[np.cumsum(length + 1) - 1] = False
        text[own] = np.concatenate(pieces)
        self.n, self.cap, self.sigma = len(text), cap, sigma
        order, lcp = suffixes(text)
        # minima of common prefixes over 2**k neighbours; entry n ends the last range
        self.lcp = [np.append(lcp, np.uint8(0))]
        while 2 << len(self.lcp) <= self.n:
            last, half = self.lcp[-1], 1 << (len(self.lcp) - 1)
            self.lcp.append(np.minimum(last[:-half], last[half:]))
        column = text[order - 1]
        new = np.append(True, column[1:] != column[:-1])
        self.begins = np.flatnonzero(new)
        self.ends = np.append(self.begins[1:], self.n)
        self.heads = column[self.begins].astype(np.int32)
        self.marks = Ranked(np.append(new, False).view(np.uint8))
        self.runs = Wavelet(self.heads.astype(np.int64), sigma)
        by = np.argsort(self.heads, kind="stable")
        self.summed = np.append(0, np.cumsum((self.ends - self.begins)[by]))
        self.first_run = np.searchsorted(self.heads[by], np.arange(sigma))
        self.below = np.searchsorted(np.sort(text), np.arange(sigma))
        group = lcp < cap
        self.groups = Ranked(np.append(group, False).view(np.uint8))
        self.group_start = np.append(np.flatnonzero(group), self.n)
        self.smallest = np.minimum.reduceat(np.repeat(docs, length + 1)[order], self.group_start[:-1])

    def _rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often c stands among the first `at` places of the transform."""
        run = self.marks.ones(at)
        first = self.first_run[c]
        whole = self.summed[first + self.runs.rank(c, run)] - self.summed[first]
        last = np.maximum(run - 1, 0)
        return whole - np.where((run > 0) & (self.heads[last] == c), self.ends[last] - at, 0)

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search."""
        both = self._rank(np.concatenate([c, c]), np.concatenate([low, high]))
        return self.below[c] + both[: len(c)], self.below[c] + both[len(c) :]

    def widen(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of all suffixes that share `depth` symbols with those of the given ranges."""
        low, high = low.copy(), high.copy()
        for k in range(len(self.lcp) - 1, -1, -1):
            table, size = self.lcp[k], 1 << k
            at = low - size + 1
            go = (at >= 0) & (table[np.maximum(at, 0)] >= depth)
            low[go] -= size
            go = (high + size <= self.n) & (table[np.minimum(high, len(table) - 1)] >= depth)
            high[go] += size
        return low, high

    def match(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the patterns words[start:start+length] (0: a word the index has not), the length
        of the longest match that starts there, `cap` at most, and for matches of `cap` the smallest document."""
        found = np.zeros(len(words), np.uint8)
        doc = np.full(len(words), NO_DOC, np.int64)
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        depth = np.zeros(len(start), np.int64)
        by = np.argsort(-length, kind="stable")
        live = len(by)
        for t in range(int(length.max(initial=0))):
            while length[by[live - 1]] <= t:
                live -= 1
            lane = by[:live]
            at = start[lane] + length[lane] - 1 - t
            c, l, h, d = words[at], low[lane], high[lane], depth[lane]
            new_l, new_h = self.extend(c, l, h)
            d = d + 1
            bad = np.flatnonzero((new_l >= new_h) | (c == 0))
            if len(bad):
                new_l[bad], new_h[bad], d[bad] = self._shrunk(c[bad], l[bad], h[bad], d[bad] - 1)
            full = np.flatnonzero(d >= self.cap)
            if len(full):
                group = self.groups.ones(new_l[full] + 1) - 1
                new_l[full], new_h[full], d[full] = self.group_start[group], self.group_start[group + 1], self.cap
                doc[at[full]] = self.smallest[group]
            found[at] = d
            low[lane], high[lane], depth[lane] = new_l, new_h, d
        return found, doc

    def _shrunk(self, c: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest part of each match that c can go before: ranges and lengths, c included."""
        best_l, best_h = np.zeros(len(c), np.int64), np.full(len(c), self.n, np.int64)
        best = np.zeros(len(c), np.int64)
        # a word the index has can stand alone: a length of `least` always works, one of `most` never does
        l, h = self.extend(c, np.zeros(len(c), np.int64), np.full(len(c), self.n, np.int64))
        live = np.flatnonzero((c > 0) & (l < h))
        best_l[live], best_h[live], best[live] = l[live], h[live], 1
        c, low, high, least, most = c[live], low[live], high[live], np.zeros(len(live), np.int64), depth[live].copy()
        todo = np.flatnonzero(most - least > 1)
        while len(todo):
            middle = (least[todo] + most[todo]) // 2
            l, h = self.extend(c[todo], *self.widen(low[todo], high[todo], middle))
            good = l < h
            some = todo[good]
            least[some], most[todo[~good]] = middle[good], middle[~good]
            best_l[live[some]], best_h[live[some]], best[live[some]] = l[good], h[good], middle[good] + 1
            todo = todo[most[todo] - least[todo] > 1]
        return best_l, best_h, best


def suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order by their first DEPTH symbols, and how many symbols each shares with the one before."""
    n = len(text)
    ranks, step = [np.unique(text, return_inverse=True)[1].astype(np.int64)], 1
    while step < DEPTH:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - step, 0)] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 2) + ahead, return_inverse=True)[1])
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(n, np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        rank = np.append(ranks[k], [-1])
        i, j = np.minimum(order[1:] + shared[1:], n), np.minimum(order[:-1] + shared[1:], n)
        shared[1:][(rank[i] == rank[j]) & (i < n) & (j < n)] += 1 << k
    return order, shared.astype(np.uint8)
