"""Words, lines and rolling n-gram hashes of many texts at once, in numpy.

A word is a run of bytes other than space, tab, LF, VT, FF and CR.  Hashes are
polynomials over 64-bit integers, so that the hash of any span is a difference
of two prefix sums times a power.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse modulo 2**64."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASE[kind]
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[kind] = have = (made[0], made[1])
        if size > 1 << 22:  # one giant text: don't hold its powers for good
            del _POWERS[kind]
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    power, inverse = _powers(kind, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


@dataclass
class Spans:
    """Texts joined by one line feed.  ``begin`` and ``stop`` are each text's bytes; ``start``, ``end`` and ``doc`` each word's."""

    buffer: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_words: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], lower: bool = False) -> Spans:
        joined = b"\n".join(texts)
        buffer = np.frombuffer(joined.lower() if lower else joined, np.uint8)  # bytes.lower() changes A-Z only
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        stop = np.cumsum(sizes + 1) - 1
        begin = stop - sizes
        edge = np.zeros(len(buffer) + 2, np.int8)
        edge[1:-1] = ~_SPACE[buffer]
        edge = np.diff(edge)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.searchsorted(start, begin)
        n_words = np.diff(np.append(first, len(start)))
        return cls(buffer, begin, stop, start, end, np.repeat(np.arange(len(texts)), n_words), n_words)

    def word_hashes(self) -> np.ndarray:
        return _rolling(_BYTE[self.buffer], self.start, self.end, "byte")

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of ``n`` words within a text."""
        at = np.arange(max(0, len(hashes) - n + 1))
        at = at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at
        return at, _rolling(hashes, at, at + n, "word")

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all lines, in order; a text without a line feed is one line."""
        end = np.append(np.flatnonzero(self.buffer == 10), len(self.buffer))
        start = np.append(0, end[:-1] + 1)
        return start, end, np.searchsorted(self.stop, end)

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _rolling(_BYTE[self.buffer], start, end, "byte")

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each text."""
        sums = np.append(0, np.cumsum(flags, dtype=np.int64))
        return sums[self.stop] - sums[self.begin]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the keys that occur twice or more, and of those that occurred before.

    Keys alone in their slot of a counting table are single; only the others
    are sorted.
    """
    every, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) < 2:
        return every, later
    bits = max(8, int(4 * len(keys)).bit_length())
    slot = (keys >> U(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    if len(at):
        _, first, back, n = np.unique(keys[at], return_index=True, return_inverse=True, return_counts=True)
        every[at] = n[back] > 1
        later[at] = True
        later[at[first]] = False
    return every, later
