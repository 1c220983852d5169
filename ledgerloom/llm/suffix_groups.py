"""Suffix sorting in linear time by Lyndon groups.

Suffixes are grouped by first symbol. From the largest group down, each suffix of a group points to the
nearest suffix before it that lies in a smaller group; the suffixes so pointed at are the ones that the
group's word extends, and they move to a new group just above their own, the more often pointed at, the
higher. At the end a group holds the suffixes with one Lyndon prefix. The suffixes are then emitted in
ascending order: each emitted suffix gives the next places in their groups to those before it that end
in it, along the pointers.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

#: A pointer that isn't known yet.
_OPEN = -2


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``seq`` in ascending order. The last symbol is the only least one."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    arranged = seq[order]
    first = np.flatnonzero(np.concatenate([[True], arranged[1:] != arranged[:-1]]))
    start_of = np.repeat(first, np.diff(np.concatenate([first, [n]])))
    sa, at = order.tolist(), np.empty(n, np.int64)
    at[order] = np.arange(n)
    at = at.tolist()  # place of a suffix in sa
    group_np = np.empty(n, np.int64)
    group_np[order] = start_of
    group = group_np.tolist()  # first place of a suffix's group
    size = np.zeros(n, np.int64)
    size[first] = np.diff(np.concatenate([first, [n]]))
    size = size.tolist()
    before = [_OPEN] * n

    end, waiting = n, []
    while end > 0:
        low = group[sa[end - 1]]
        if end - low == 1:
            s = sa[low]
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[s] = p
            pointed = {1: [p]} if p >= 0 else {}
        else:
            times: dict[int, int] = {}
            for s in sa[low:end]:
                while before[s] == _OPEN:
                    at_s, p = s, s - 1
                    while p >= 0 and group[p] >= low:
                        if before[p] == _OPEN:  # of this group too: its pointer comes first, and ends the walk
                            waiting.append(at_s)
                            at_s, p = p, p - 1
                        else:
                            p = before[p]
                    before[at_s] = p
                    if p >= 0:
                        times[p] = times.get(p, 0) + 1
                    while waiting:
                        at_s = waiting.pop()
                        before[at_s] = p
                        if p >= 0:
                            times[p] = times.get(p, 0) + 1
            pointed = defaultdict(list)
            for p, k in times.items():
                pointed[k].append(p)
        for k in sorted(pointed, reverse=True):
            moved: dict[int, int] = {}  # how many of a group go
            for p in pointed[k]:
                g = group[p]
                m = moved.get(g, 0) + 1
                moved[g] = m
                to = g + size[g] - m
                here = at[p]
                if here != to:
                    other = sa[to]
                    sa[to], sa[here] = p, other
                    at[p], at[other] = to, here
            for p in pointed[k]:
                g = group[p]
                m = moved[g]
                if m != size[g]:
                    group[p] = g + size[g] - m
            for g, m in moved.items():
                if m != size[g]:
                    size[g + size[g] - m] = m
                    size[g] -= m
        end = low

    free, done, out = group, [False] * n, [0] * n
    room = list(range(n))  # next free place of the group that begins here
    out[0] = n - 1
    done[n - 1] = True
    room[0] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = free[s]
            out[room[g]] = s
            room[g] += 1
            done[s] = True
            s = before[s]
    return np.array(out, np.int64)
