"""Run-length grammar of a sequence by recompression, and longest common extensions read from it.

Block compression gives every maximal block of one symbol a symbol of its own; pair compression splits the
symbols into left and right ones by a hash and gives every left-right pair a symbol. The two alternate until
nothing is left to pair. Both cuts depend on neighbouring symbols alone, so equal stretches are cut alike except
near their ends, and an extension is found by climbing the levels while symbols agree and descending again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from stridemill.llm.words import mixed

MAX_IDLE = 8


@dataclass(frozen=True)
class Level:
    """One string of the grammar: its symbols, the parent of each in the next string, the first child of each parent."""

    symbols: np.ndarray
    parent: np.ndarray
    child: np.ndarray
    blocks: bool

    def first(self, at: np.ndarray) -> np.ndarray:
        return self.child[self.parent[at]] == at

    def left(self, at: np.ndarray) -> np.ndarray:
        """Symbols from here to the end of the parent."""
        return self.child[self.parent[at] + 1] - at


def _level(symbols: np.ndarray, first: np.ndarray, blocks: bool) -> Level:
    child = np.append(np.flatnonzero(first), len(symbols)).astype(np.int32)
    return Level(symbols, np.cumsum(first, dtype=np.int32) - np.int32(1), child, blocks)


def _renamed(symbols: np.ndarray, level: Level, second: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """Symbols of the next string: parents with a second key are named by (first child, key), the others keep theirs."""
    out = symbols[level.child[:-1]].copy()
    joined = np.flatnonzero(second >= 0)
    if len(joined):
        keys = out[joined].astype(np.int64) << 32 | second[joined]
        names, which = np.unique(keys, return_inverse=True)
        out[joined] = fresh + which
        fresh += len(names)
    return out, fresh


class Grammar:
    """Levels of one sequence of non-negative integers; ``barrier`` never joins a pair and parts separate sequences."""

    def __init__(self, symbols: np.ndarray, barrier: int):
        symbols = symbols.astype(np.int32)
        fresh = int(symbols.max(initial=barrier)) + 1
        self.levels: list[Level] = []
        idle, salt = 0, 0
        while len(symbols) > 1 and idle < MAX_IDLE:
            size = len(symbols)
            change = np.ones(size, bool)
            change[1:] = symbols[1:] != symbols[:-1]
            if not change.all():
                level = _level(symbols, change, True)
                count = np.diff(level.child).astype(np.int64)
                self.levels.append(level)
                symbols, fresh = _renamed(symbols, level, np.where(count > 1, count, -1), fresh)
            salt += 1
            side = (mixed(symbols.astype(np.uint64) * np.uint64(2 * salt + 1) + np.uint64(salt)) & np.uint64(1)).astype(bool)
            free = symbols != barrier
            right, left = side & free, ~side & free
            one, two = left[:-1] & right[1:], right[:-1] & left[1:]
            pair = one if one.sum() >= two.sum() else two
            if pair.any():
                first = np.ones(len(symbols), bool)
                first[1:] = ~pair
                level = _level(symbols, first, False)
                double = np.diff(level.child) == 2
                second = np.where(double, symbols[np.minimum(level.child[:-1] + 1, len(symbols) - 1)].astype(np.int64), -1)
                self.levels.append(level)
                symbols, fresh = _renamed(symbols, level, second, fresh)
            idle = 0 if len(symbols) < size else idle + 1
        self.top = symbols

    def mirrored(self) -> Grammar:
        """The same parse read from the right; position ``k`` of a string of ``n`` becomes ``n - 1 - k``."""
        out = object.__new__(Grammar)
        out.levels = []
        for lv in self.levels:
            parents = len(lv.child) - 1
            child = (len(lv.symbols) - lv.child[::-1]).astype(np.int32)
            out.levels.append(Level(lv.symbols[::-1], (parents - 1 - lv.parent[::-1]).astype(np.int32), child, lv.blocks))
        out.top = self.top[::-1]
        return out

    def extensions(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the sequences from ``i`` and from ``j``, for every pair.

        ``i`` and ``j`` differ and both sequences meet different symbols before the end (a barrier sees to that).
        """
        u, v = i.astype(np.int64), j.astype(np.int64)
        halt = np.full(len(u), len(self.levels), np.int32)
        live = np.arange(len(u))
        for depth, lv in enumerate(self.levels):
            if not len(live):
                break
            a, b = u[live], v[live]
            level_up = lv.first(a) & lv.first(b)
            todo = np.flatnonzero(~level_up)
            x, y = a[todo], b[todo]
            same = lv.symbols[x] == lv.symbols[y]
            todo, x, y = todo[same], x[same], y[same]
            if lv.blocks:
                p, q = lv.left(x), lv.left(y)
                step = np.minimum(p, q)
                x, y, agree = x + step, y + step, p == q
            else:
                x, y = x + 1, y + 1
                agree = lv.symbols[x] == lv.symbols[y]
                more = agree & ~lv.first(x)
                x, y = x + more, y + more
            a[todo], b[todo] = x, y
            level_up[todo] = agree
            halt[live[~level_up]] = depth
            u[live], v[live] = np.where(level_up, lv.parent[np.minimum(a, len(lv.parent) - 1)], a), np.where(level_up, lv.parent[np.minimum(b, len(lv.parent) - 1)], b)
            live = live[level_up]
        while len(live):
            live = live[self.top[u[live]] == self.top[v[live]]]
            u[live] += 1
            v[live] += 1
        for depth in range(len(self.levels) - 1, -1, -1):
            down = np.flatnonzero(halt > depth)
            if not len(down):
                continue
            lv = self.levels[depth]
            a, b = lv.child[u[down]].astype(np.int64), lv.child[v[down]].astype(np.int64)
            same = lv.symbols[a] == lv.symbols[b]
            step = np.minimum(lv.left(a), lv.left(b)) if lv.blocks else 1
            u[down], v[down] = a + same * step, b + same * step
        return u - i
