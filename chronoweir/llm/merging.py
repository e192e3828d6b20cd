"""Pair merges of many short words at once.

Each word is a row of part boundaries with, beside it, the rank of each part's merge with its right neighbour. A round scans every row for its least rank (leftmost of equals), deletes that boundary and refreshes the ranks at both sides; rows without a merge left are done. The rows are NumPy matrices, so a round costs a few array operations for all words together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: No merge. Ranks are below it.
NONE = np.int32(2**31 - 1)
#: Widths of the matrices; longer words aren't merged here.
WIDTHS = (4, 8, 12, 16, 24, 48, 96)
#: Cells of a matrix at most, which bounds the memory.
CELLS = 1 << 20


class Pairs:
    """Pairs of symbols to the rank of their merge and the symbol that it makes."""

    def __init__(self, left, right, rank, made):
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.bits = max(12, int(len(keys) * 4).bit_length())
        self.shift, self.mult = np.uint64(64 - self.bits), np.uint64(0x9E3779B97F4A7C15)
        self.keys, self.rank, self.made = keys[order], np.asarray(rank, np.int32)[order], np.asarray(made, np.int32)[order]
        # open addressing: slots hold places in keys
        self.slot = np.full(1 << self.bits, -1, np.int32)
        at, todo = self._hash(self.keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.slot[at] < 0]
            self.slot[at[self.slot[at] < 0]] = free
            rest = self.slot[at] != todo
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys):
        return ((keys.astype(np.uint64) * self.mult) >> self.shift).astype(np.int64)

    def find(self, left, right):
        """Ranks and made symbols; negative symbols have no merges."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        shape, keys = keys.shape, keys.ravel()
        rank, made = np.full(len(keys), NONE, np.int32), np.zeros(len(keys), np.int32)
        todo = np.nonzero(keys >= 0)[0] if len(keys) else np.empty(0, np.int64)
        at = self._hash(keys[todo])
        for _ in range(self.probes):
            place = self.slot[at]
            some = place >= 0
            todo, at, place = todo[some], at[some], place[some]
            if not len(todo):
                break
            hit = self.keys[place] == keys[todo]
            rank[todo[hit]], made[todo[hit]] = self.rank[place[hit]], self.made[place[hit]]
            todo, at = todo[~hit], (at[~hit] + 1) & ((1 << self.bits) - 1)
        return rank.reshape(shape), made.reshape(shape)


def merge(symbols: np.ndarray, lengths: np.ndarray, pairs: Pairs, done: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Merges words given as one array of symbols and their lengths (1 to 96). done gets, group by group, the numbers of words, their symbols as one array, and how many each has."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    low = 0
    for width in WIDTHS:
        chosen = np.nonzero((lengths > low) & (lengths <= width))[0]
        low = width
        for k in range(0, len(chosen), CELLS // width):
            part = chosen[k : k + CELLS // width]
            done(part, *_merged(symbols, starts[part], lengths[part], width, pairs))


def _merged(symbols, starts, lengths, width, pairs):
    n = len(starts)
    column = np.arange(width)
    alive = column < lengths[:, None]
    ids = np.full((n, width + 1), -1, np.int32)  # the last column stands for what is outside the word
    ids[:, :width][alive] = symbols[(starts[:, None] + column)[alive]]
    rank = np.full((n, width + 1), NONE, np.int32)
    made = np.zeros((n, width + 1), np.int32)
    if width > 1:
        both = alive[:, 1:]
        r, m = pairs.find(ids[:, : width - 1][both], ids[:, 1:width][both])
        rank[:, : width - 1][both], made[:, : width - 1][both] = r, m
    after = np.minimum(np.arange(1, width + 2), width)[None, :].repeat(n, 0).astype(np.int16)
    after[np.arange(n), lengths - 1] = width
    before = np.where(column > 0, column - 1, width)[None, :].repeat(n, 0).astype(np.int16)
    before = np.concatenate([before, np.full((n, 1), width, np.int16)], 1)
    rows = np.arange(n)
    while len(rows):
        i = rank[rows].argmin(1)
        some = rank[rows, i] != NONE
        rows, i = rows[some], i[some]
        if not len(rows):
            break
        j = after[rows, i].astype(np.int64)
        k = after[rows, j].astype(np.int64)
        ids[rows, i] = made[rows, i]
        alive[rows, j] = False
        rank[rows, j] = NONE
        after[rows, i] = k
        before[rows, k] = i
        p = before[rows, i].astype(np.int64)
        here = ids[rows, i]
        right, left = ids[rows, k], ids[rows, p]
        r, m = pairs.find(np.concatenate([here, left]), np.concatenate([right, here]))
        # outside a word the symbol is -1: no merge with it
        r[: len(rows)][right < 0] = NONE
        r[len(rows) :][left < 0] = NONE
        rank[rows, i], made[rows, i] = r[: len(rows)], m[: len(rows)]
        rank[rows, p], made[rows, p] = r[len(rows) :], m[len(rows) :]
        rank[:, width] = NONE
    return ids[:, :width][alive], alive.sum(1)
