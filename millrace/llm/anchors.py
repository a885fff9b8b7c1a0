"""Windows of a corpus cut into segments by content, so that equal windows meet without a row for each window.

A window of WIDTH units (words or bytes) has an anchor: the run of GRAM units in it with the smallest hash, the first of
several. Neighbouring windows with one anchor form a segment. Equal windows have equal anchors, so a window can only repeat
in a segment with the same anchor hash; and of equal segments all windows repeat. Only segments that share an anchor with
different segments need a closer look.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import complete, mix, windows

#: Low bits of an ordered value that hold the place; the rest are the hash's high bits.
_PLACE = np.uint64((1 << 28) - 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64 and of its inverse, n of each."""
    known = _POWERS.get(which)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[which] = known = (both[0], both[1])
    return known[0][:n], known[1][:n]


class Sums:
    """Hashes of any runs of a sequence of 64-bit values, from sums over its prefixes."""

    def __init__(self, values: np.ndarray, which: int):
        self.up, self.down = powers(len(values) + 1, which)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size :]) if width > size else out


@dataclass
class Segments:
    """first: first window of each segment (place of its first unit); count: windows; anchor, content: 64-bit hashes; row: the row it lies in."""

    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    row: np.ndarray


def segments(values: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> Segments:
    """Segments of the rows with the given n+1 bounds in values."""
    none = np.zeros(0, dtype=np.int64)
    if len(values) < width:
        return Segments(none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    grams = windows(values, gram, seed=1) if gram <= 16 else None
    if grams is None:
        s = Sums(values, 0)
        at = np.arange(len(values) - gram + 1)
        grams = s(at, at + gram)
    order = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_minimum(order, width - gram + 1) & _PLACE).astype(np.int64)
    valid = complete(bounds, len(values), width)
    begin = valid.copy()
    begin[1:] &= ~(valid[:-1] & (place[1:] == place[:-1]))
    first = np.flatnonzero(begin)
    stop = valid.copy()
    stop[:-1] &= ~(valid[1:] & (place[1:] == place[:-1]))
    last = np.flatnonzero(stop)
    end = last + width
    content = Sums(values, 0)(first, end)
    # the anchor's place in the segment belongs to its content
    content = mix(content + (place[first] - first).astype(np.uint64))
    return Segments(first, last - first + 1, grams[place[first]], content, np.searchsorted(bounds, first, side="right") - 1)
