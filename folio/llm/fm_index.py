"""An FM-index over integer sequences: wavelet-matrix ranks, vectorised backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Rank of a symbol in a prefix, for many symbols and prefixes at once, a level for each bit."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.bits = max(1, int(symbols - 1).bit_length())
        self.n, self.ones, self.zeros, self.data = len(seq), [], [], []
        cur = seq
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(cur) - self.ones[-1][-1]))
            self.data.append(bit.astype(bool))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(end), end
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            a, z = self.ones[level][lo], self.ones[level][hi]
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + z, hi - z)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in range(self.bits):
            one = self.data[level][at]
            a = self.ones[level][at]
            out = 2 * out + one
            at = np.where(one, self.zeros[level] + a, at - a)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; seq must tell all suffixes apart (its separators differ from one another)."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n and rank[order[-1]] < n - 1:
        nxt = np.zeros(n, np.int64)
        if step < n:
            nxt[:-step] = rank[step:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        step *= 2
    return order


class FMIndex:
    """Runs of symbols >= 1, each run closed by a separator 0. Positions count symbols and separators from the first run on."""

    def __init__(self, seq: np.ndarray, symbols: int, every: int = 8) -> None:
        n = len(seq)
        sep = seq == 0
        k = int(sep.sum())
        wide = seq.astype(np.int64) + k
        wide[sep] = np.arange(k)
        sa = suffix_array(wide)
        self.n, self.every = n, every
        bwt = seq[sa - 1] if n else seq
        self.wavelet = Wavelet(bwt.astype(np.int64), symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))]).astype(np.int64)
        start = np.maximum.accumulate(np.where(np.concatenate([[True], sep[:-1]]), np.arange(n), 0)) if n else sa
        self.sampled = ((sa - start[sa]) % every == 0) if n else sep  # each run's first symbol too, so a walk never meets a separator
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: rows of equal length -> the half-open range of suffixes that begin with each."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for i in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, i]
            a, b = self.first[c] + self.wavelet.rank(c, lo[live]), self.first[c] + self.wavelet.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Suffix-array rows -> positions, by stepping back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            there = self.sampled[r]
            hit = live[there]
            out[hit] = self.samples[self.sample_rank[rows[hit]]] + steps[hit]
            live, r = live[~there], r[~there]
            c = self.wavelet.access(r)
            rows[live] = self.first[c] + self.wavelet.rank(c, r)
            steps[live] += 1
        return out
