"""Words, lines and rolling hashes of a slice of texts as NumPy arrays.

Words are runs of bytes other than ASCII white space. All texts of a slice lie in one byte
buffer, a line feed after each; prefix sums of a polynomial hash give the hash of any word,
line or word window without a loop.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_BYTES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``size``; one pair of arrays is kept per base."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(1 << 18, size), b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = both[0], both[1]
    return _POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hash of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        powers, self.inverse = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Slice:
    buffer: np.ndarray
    lead: np.ndarray      # a code point starts here
    text_start: np.ndarray
    text_end: np.ndarray
    start: np.ndarray     # words
    end: np.ndarray
    first: np.ndarray     # first word of a text
    last: np.ndarray      # word after its last
    owner: np.ndarray     # text of a word
    bytes_hash: Rolling
    hashes: np.ndarray    # of words

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of ``n`` words that lie in one text."""
        at = np.flatnonzero(np.arange(len(self.start)) + n <= self.last[self.owner])
        return at, self.word_hash.ranges(at, at + n)

    @property
    def word_hash(self) -> Rolling:
        if not hasattr(self, "_word_hash"):
            self._word_hash = Rolling(self.hashes, _WORD_BASE)
        return self._word_hash


def tabulate(texts: list[str]) -> Slice:
    return tabulate_bytes([t.encode("utf-8", "replace") for t in texts])


def tabulate_bytes(raw: list[bytes]) -> Slice:
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    text_end = np.cumsum(sizes + 1) - 1
    text_start = text_end - sizes
    space = SPACE[buffer]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    first, last = np.searchsorted(start, text_start), np.searchsorted(start, text_end)
    rolling = Rolling(_BYTES[buffer])
    return Slice(
        buffer, (buffer & 0xC0) != 0x80, text_start, text_end, start, end, first, last,
        np.repeat(np.arange(len(raw)), last - first), rolling, rolling.ranges(start, end),
    )


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of those are not the first of their kind."""
    every, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) < 2:
        return every, later
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return every, later
    member = np.zeros(len(keys), bool)
    member[1:] |= same
    member[:-1] |= same
    every[order[member]] = True
    runs = np.flatnonzero(np.concatenate(([True], ~same)))
    later[:] = every
    later[np.minimum.reduceat(order, runs)] = False
    return every, later


def totals(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the ranges ``lo:hi``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[hi] - sums[lo]


def covered(size: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Positions inside any window of ``n`` that begins at ``starts``."""
    if not len(starts):
        return np.zeros(size, bool)
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + n, -1)
    return np.cumsum(depth[:-1]) > 0
