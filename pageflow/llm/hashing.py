"""Hashes of a text's words, all at once."""

from __future__ import annotations

import numpy as np

#: A 64-bit code for each byte and the base of the polynomial, from one seed.
_CODES = np.random.default_rng(20_250_101).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class WordHasher:
    """64-bit hashes of the words of a text, lower-cased A-Z, parted by blank, \\t, \\n, \\v, \\f and \\r.

    A word's hash is the polynomial of its bytes' codes: the difference of two running sums over the text, brought
    to the word's start. The powers are kept for the longest text so far.
    """

    def __init__(self):
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _prepare(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                x = np.full(n, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums over the bytes of a text, for ``spans``."""
        n = len(data)
        self._prepare(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CODES[data] * self.powers[:n], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of bytes."""
        h = (sums[ends] - sums[starts]) * self.inverses[starts] if len(starts) else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8) if text else np.zeros(0, np.uint8)
        starts, ends = word_spans(data)
        return self.spans(self.sums(data), starts, ends)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words among a text's bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_BLANK[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def sorted_distinct(a: np.ndarray) -> np.ndarray:
    """As ``numpy.unique``, by sorting."""
    a = np.sort(a)
    if len(a) < 2:
        return a
    new = np.ones(len(a), dtype=bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]
