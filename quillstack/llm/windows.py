"""Hashes of all windows of a text, and the choice of a few of them that depends on content alone."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        base = _BASES[kind]
        one, two = np.empty(size, np.uint64), np.empty(size, np.uint64)
        one[0] = two[0] = 1
        one[1:], two[1:] = base, pow(base, -1, 1 << 64)
        _POWERS[kind] = np.multiply.accumulate(one), np.multiply.accumulate(two)
    return _POWERS[kind]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Hashed:
    """Prefix sums over code points, from which the hash of any window comes in a few operations."""

    def __init__(self, codes: np.ndarray, kind: int = 0) -> None:
        self.kind = kind
        power, _ = _powers(kind, len(codes) + 1)
        letters = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        letters ^= letters >> np.uint64(31)
        letters *= power[: len(codes)]
        self.sums = np.empty(len(codes) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(letters, out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        """The hash of the window of ``width`` that starts at each position."""
        n = max(0, len(self.sums) - width)
        return mixed((self.sums[width:] - self.sums[:n]) * _powers(self.kind, n)[1][:n])

    def at(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each stretch [first, end)."""
        inverse = _powers(self.kind, len(self.sums))[1]
        return mixed((self.sums[end] - self.sums[first]) * inverse[first] + (end - first).astype(np.uint64))


def slid(x: np.ndarray, width: int, op: Callable) -> np.ndarray:
    """``op`` (minimum or maximum) over each ``width`` neighbours, by doubling."""
    k = 1
    size = len(x) - width + 1
    if size <= 0:
        return x[:0]
    while 2 * k <= width:
        x = op(x[:-k], x[k:])
        k *= 2
    return op(x[:size], x[width - k : width - k + size])


def chosen(hashes: np.ndarray, ends: np.ndarray, width: int, span: int) -> np.ndarray:
    """Positions whose window has the least hash among all windows of some stretch of ``span`` characters.

    ``ends`` has for each position the end of its segment; only stretches within a segment count.
    Any two equal stretches choose windows at equal places, so whatever two segments share over
    ``span`` characters has a window that both of them choose.
    """
    order = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    t = span - width + 1
    least = slid(order, t, np.minimum)
    start = np.arange(len(least))
    least = np.where(start + span <= ends[: len(least)], least, np.uint32(0))
    pad = np.zeros(t - 1, np.uint32)
    most = slid(np.concatenate([pad, least, pad]), t, np.maximum)
    return np.flatnonzero(most[: len(order)] == order)
