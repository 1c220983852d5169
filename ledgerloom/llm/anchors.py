"""Anchors of fixed-length windows: where equal windows of different documents are sure to meet.

A window's anchor is its gram of least hash, the leftmost of equals, so equal windows have equal
anchors at equal offsets. Neighbouring windows mostly share their anchor; the windows of one anchor
are a block, and every window lies in one block only.
"""

from __future__ import annotations

import numpy as np

_PLACE_BITS = 24
_PIECE = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` (a power of two) values."""
    h, width, factor = x.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    while width < size:
        h = h[:-width] * factor + h[width:]
        factor = factor * factor * np.uint64(0xD1342543DE82EF95) | np.uint64(1)
        width *= 2
    return mix(h)


def blocks(x: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of every block of windows of ``span`` values."""
    n = len(x) - span + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    with np.errstate(over="ignore"):
        h = gram_hashes(x, gram)
    reach = span - gram + 1
    at = []
    for lo in range(0, n, _PIECE):
        part = h[lo : min(lo + _PIECE, n) + reach - 1]
        key = ((part >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS)) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        count = len(part) - reach + 1
        key = np.minimum(key[:count], key[reach - width : reach - width + count])
        at.append((key & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + lo)
    place = np.concatenate(at)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[first]], first, np.diff(np.concatenate([first, [n]]))
