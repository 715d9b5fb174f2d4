"""A full-text index in minute space over the word codes of a shard of documents."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Order of the suffixes of codes. Zeros separate documents; each counts as smaller than all later zeros' successors and unlike any other, so no comparison goes beyond a document.

    Three codes are packed into a first key; after that only suffixes that still tie are sorted, by twice the length each time.
    """
    n = len(codes)
    top = int(codes.max(initial=0))
    zeros = codes == 0
    first = codes.astype(np.int64) + int(zeros.sum())
    first[zeros] = np.arange(int(zeros.sum()))  # unlike any other
    bits = max(1, int(first.max(initial=0)).bit_length())
    width = max(1, min(3, 62 // bits))
    key = np.zeros(n, dtype=np.int64)
    for j in range(width):
        key <<= bits
        key[: n - j] |= first[j:]
    del first, top
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    tied = ~(new & np.r_[new[1:], True]) if n else np.zeros(0, bool)
    active = np.flatnonzero(tied)
    step = width
    while len(active):
        at = order[active]
        ahead = at + step
        key = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        key = key[by]
        order[active] = at = at[by]
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        active = active[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks and single symbols of a sequence of codes, a bit at a time from the highest."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(1, int(codes.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        x = codes.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            bit = (x >> level) & 1
            ones = np.zeros(len(x) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(x) - int(ones[-1]))
            bit = bit.astype(bool)
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        start, end = np.zeros_like(at), at
        for i, ones in enumerate(self.ones):
            bit = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            before, until = ones[start], ones[end]
            start = np.where(bit, self.zeros[i] + before, start - before)
            end = np.where(bit, self.zeros[i] + until, end - until)
        return end - start

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and how often each occurs before its place."""
        symbol, start, end = np.zeros_like(at), np.zeros_like(at), at
        for i, ones in enumerate(self.ones):
            bit = ones[end + 1] - ones[end]
            symbol = symbol * 2 + bit
            before, until = ones[start], ones[end]
            start = np.where(bit == 1, self.zeros[i] + before, start - before)
            end = np.where(bit == 1, self.zeros[i] + until, end - until)
        return symbol, end - start


class FMIndex:
    """Of documents' codes (from 1), each document ended by a 0. Sampled suffix positions: every `sample`-th, and each document's first, where walks end at the latest."""

    def __init__(self, codes: np.ndarray, sample: int = 16):
        self.n = len(codes)
        order = suffix_array(codes)
        bwt = codes[order - 1]  # before the first stands the last, a zero
        self.first = np.r_[0, np.cumsum(np.bincount(codes, minlength=int(codes.max(initial=0)) + 1))].astype(np.int64)
        self.matrix = WaveletMatrix(bwt)
        kept = (order % sample == 0) | (bwt == 0)
        self.kept_before = np.r_[0, np.cumsum(kept)].astype(np.int32)
        self.positions = order[kept].astype(np.int32)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the range of rows of each pattern, codes read from the right end; zeros at the left pad shorter patterns."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((high > low) & (patterns[:, column] > 0))
            if not len(live):
                continue
            symbol = patterns[live, column]
            low[live] = self.first[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.matrix.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk to the left until a sampled one."""
        out, steps = np.zeros(len(rows), dtype=np.int64), 0
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            hit = self.kept_before[at + 1] > self.kept_before[at]
            out[todo[hit]] = self.positions[self.kept_before[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(at):
                symbol, before = self.matrix.step(at)
                at = self.first[symbol] + before
            steps += 1
        return out
