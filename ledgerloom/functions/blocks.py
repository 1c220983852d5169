"""The matching-blocks ratio of pairs of texts, for a batch of pairs at a time.

The longest block that two texts share is taken, the first in the one and then in the other of equals, and the same is
done to what lies before it and behind it; the ratio is twice the signs in blocks over all signs. In a second text of 200
signs or more, signs that make up over a hundredth of it begin no block, but blocks grow over them. All blocks of a level,
of all pairs, are looked for in one sweep over the places of the first texts.
"""

from __future__ import annotations

import numpy as np

#: From which length on a second text has popular signs, and their least share, one in so many.
LONG, SHARE = 200, 100
#: Places of second texts that are swept at once.
ROOM = 1_000_000


def _padded(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, pad: int) -> np.ndarray:
    """The stretches lo to hi of ``flat`` as rows of one width."""
    at = lo[:, None] + np.arange(int((hi - lo).max()))
    return np.where(at < hi[:, None], flat[np.minimum(at, max(len(flat) - 1, 0))], pad)


def _longest(a: np.ndarray, b: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of padded texts the length of the longest common block of seed signs, and where it begins in either."""
    n, width = b.shape
    run = np.zeros((n, width + 1), np.int64)
    size, end_a, end_b = (np.zeros(n, np.int64) for _ in range(3))
    for i in range(a.shape[1]):
        run[:, 1:] = np.where((a[:, i, None] == b) & seeds, run[:, :-1] + 1, 0)
        top = run.argmax(axis=1)
        length = run[np.arange(n), top]
        better = length > size
        size[better], end_a[better], end_b[better] = length[better], i + 1, top[better]
    return size, end_a - size, end_b - size


def _popular(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Flags of the signs that are popular in their own text."""
    out = np.zeros(len(flat), bool)
    for k in np.flatnonzero(np.diff(at) >= LONG):
        text = flat[at[k] : at[k + 1]]
        _, kind, count = np.unique(text, return_inverse=True, return_counts=True)
        out[at[k] : at[k + 1]] = (count > len(text) // SHARE + 1)[kind]
    return out


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.cumsum([0, *map(len, texts)])


def matched(first: list[str], second: list[str]) -> np.ndarray:
    """For each pair the number of signs in common blocks."""
    (a, a_at), (b, b_at) = _flat(first), _flat(second)
    seeds, total = ~_popular(b, b_at), np.zeros(len(first), np.int64)
    todo = np.stack([np.arange(len(first)), a_at[:-1], a_at[1:], b_at[:-1], b_at[1:]], axis=1)
    while len(todo := todo[(todo[:, 1] < todo[:, 2]) & (todo[:, 3] < todo[:, 4])]):
        todo = todo[np.argsort(todo[:, 4] - todo[:, 3], kind="stable")]
        found, lo = [], 0
        while lo < len(todo):
            widths = todo[lo:, 4] - todo[lo:, 3]
            n = max(1, int(np.searchsorted(widths * np.arange(1, len(widths) + 1), ROOM, side="right")))
            part = todo[lo : lo + n]
            lo += n
            _, alo, ahi, blo, bhi = part.T
            keep = _padded(seeds.astype(np.int64), blo, bhi, 0) == 1
            size, i, j = _longest(_padded(a, alo, ahi, -1), _padded(b, blo, bhi, -2), keep)
            i, j = alo + i, blo + j
            # A block without a seed begins where the search did, and grows over popular signs like any other.
            while (grow := (i > alo) & (j > blo) & (a[np.maximum(i - 1, 0)] == b[np.maximum(j - 1, 0)])).any():
                i, j, size = i - grow, j - grow, size + grow
            while (grow := (i + size < ahi) & (j + size < bhi) & (a[np.minimum(i + size, len(a) - 1)] == b[np.minimum(j + size, len(b) - 1)])).any():
                size = size + grow
            found.append(np.stack([part[:, 0], alo, ahi, blo, bhi, i, j, size], axis=1)[size > 0])
        pair, alo, ahi, blo, bhi, i, j, size = np.concatenate(found).T
        np.add.at(total, pair, size)
        todo = np.concatenate([np.stack([pair, alo, i, blo, j], axis=1), np.stack([pair, i + size, ahi, j + size, bhi], axis=1)])
    return total


def ratios(first: list[str | None], second: list[str | None]) -> np.ndarray:
    """The ratio of each pair to four decimals; 0 where one is missing or empty."""
    full = [i for i, (x, y) in enumerate(zip(first, second, strict=True)) if x and y]
    out = np.zeros(len(first))
    if full:
        x, y = [first[i] for i in full], [second[i] for i in full]
        both = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
        out[full] = [round(r, 4) for r in (2.0 * matched(x, y) / both).tolist()]
    return out
