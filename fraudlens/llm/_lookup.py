"""A map from 64-bit codes to row numbers that is probed a block at a time."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Open-addressing map from a code to a row number, probed a block at a time."""

    def __init__(self, codes: np.ndarray):
        bits = max(10, int(np.ceil(np.log2(max(len(codes), 1) * 3))))
        self.shift = np.uint64(64 - bits)
        self.size = 1 << bits
        self.key = np.full(self.size, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.row = np.full(self.size, -1, dtype=np.int32)
        left, rows = codes, np.arange(len(codes), dtype=np.int32)
        slot = self._slot(codes)
        while len(left):
            free = self.row[slot] < 0
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.key[slot[put]], self.row[slot[put]] = left[put], rows[put]
            left, rows, slot = left[~put], rows[~put], (slot[~put] + 1) % self.size

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slot(codes)
        row = self.row[slot]
        open_ = np.flatnonzero((row >= 0) & (self.key[slot] != codes))
        while len(open_):
            s = slot[open_] = (slot[open_] + 1) % self.size
            row[open_] = self.row[s]
            open_ = open_[(self.row[s] >= 0) & (self.key[s] != codes[open_])]
        return row
