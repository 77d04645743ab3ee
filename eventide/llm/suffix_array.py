"""Suffix sorting by grouping, in time linear in the text.

Suffixes are first grouped by symbol, by counting. Groups are taken in descending
order; each member points to the nearest earlier suffix of a smaller group, and
the suffixes pointed at are split off their groups by how many members point at
them, so that in the end a group holds the suffixes with one and the same longest
Lyndon prefix. A second pass in ascending order writes every group in its right
order, following the same pointers, without naming and sorting again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _by_symbol(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """All suffixes grouped by ascending symbol in sa[1:], where each suffix's group begins, and the sizes of the groups by their beginnings."""
    n = len(text)
    symbols = np.asarray(text, np.int64)
    symbols = symbols - symbols.min()
    if int(symbols.max()) > 4 * n:  # ranks instead of a table larger than the text
        symbols = np.unique(symbols, return_inverse=True)[1]
    count = np.bincount(symbols)
    starts = np.cumsum(count) - count + 1
    group = [*starts[symbols].tolist(), 0]
    free, sa = starts.tolist(), [n] + [0] * n
    for i, c in enumerate(symbols.tolist()):
        sa[free[c]] = i
        free[c] += 1
    size = np.zeros(n + 1, np.int64)
    size[starts[count > 0]] = count[count > 0]
    size[0] = 1
    return sa, group, size.tolist()


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of a sequence of integers in lexicographic order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return []
    # The empty suffix stands at the front, below all others.
    sa, group, size = _by_symbol(text)
    at = [0] * (n + 1)  # where a suffix stands in sa
    for place, i in enumerate(sa):
        at[i] = place
    previous = [-2] * (n + 1)  # -1: none; -2: not known yet

    end = n
    while end > 0:
        first = group[sa[end]]
        members = sa[first : end + 1]
        # The nearest earlier suffix of a smaller group. Those of larger groups have pointers already;
        # a chain through members of this group is followed once and then known for all of it.
        points: dict[int, int] = {}
        for i in members:
            chain = []
            while i >= 0 and group[i] >= first and previous[i] == -2:
                chain.append(i)
                i -= 1
                while i >= 0 and group[i] > first:
                    i = previous[i]
            if i >= 0 and group[i] >= first:
                i = previous[i]
            for j in chain:
                previous[j] = i
            if i >= 0 and chain:
                points[i] = points.get(i, 0) + len(chain)
        if points:
            by_count: list[list[int]] = [[] for _ in range(max(points.values()) + 1)]
            for p, c in points.items():
                by_count[c].append(p)
            for targets in reversed(by_count):
                moved: dict[int, int] = {}
                for p in targets:  # to the back of its group
                    g = group[p]
                    k = moved.get(g, 0)
                    to = g + size[g] - 1 - k
                    q, here = sa[to], at[p]
                    sa[here], sa[to] = q, p
                    at[q], at[p] = here, to
                    moved[g] = k + 1
                for g, k in moved.items():
                    if k == size[g]:
                        continue
                    new = g + size[g] - k
                    size[g] -= k
                    size[new] = k
                    for place in range(new, new + k):
                        group[sa[place]] = new
        end = first - 1

    head = list(range(n + 1))  # next free place of the group that begins here
    done = [False] * (n + 1)
    out = [0] * (n + 1)
    out[0] = n
    for place in range(n + 1):
        j = out[place] - 1
        while j >= 0 and not done[j]:
            done[j] = True
            g = group[j]
            out[head[g]] = j
            head[g] += 1
            j = previous[j]
    return out[1:]


def common_prefixes(text: Sequence[int], sa: Sequence[int]) -> list[int]:
    """For each place in the suffix array, how many symbols its suffix shares with the one before; 0 at the first."""
    n = len(text)
    rank, out = [0] * n, [0] * n
    for place, i in enumerate(sa):
        rank[i] = place
    h = 0
    for i in range(n):
        if rank[i] == 0:
            h = 0
            continue
        j = sa[rank[i] - 1]
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        out[rank[i]] = h
        h = max(h - 1, 0)
    return out
