"""Suffix arrays by linear grouping.

First every suffix is put in the group of its longest Lyndon prefix: groups are visited from the greatest down,
and each suffix of the visited group points to the nearest suffix before it in a smaller group; what is pointed to
moves to a new group right above its old one, apart by the number of suffixes that point to it. Then each group's
order follows from one pass over the array as it fills: the suffix before one that is placed, and all that its
pointers lead to, take the next free place of their groups. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int] | np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of non-negative integers, least first; a prefix is less than what it begins."""
    values = np.asarray(symbols, np.int64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    by_symbol = np.argsort(values, kind="stable")
    sorted_values = values[by_symbol]
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    sizes = np.diff(np.concatenate([first, [n]]))
    #: order: suffixes by group; place: where each is there; group: the first place of each suffix's group; size: by first place.
    order = by_symbol.tolist()
    place_ = np.empty(n, np.int64)
    place_[by_symbol] = np.arange(n)
    group_ = np.empty(n, np.int64)
    group_[by_symbol] = np.repeat(first, sizes)
    place, group = place_.tolist(), [*group_.tolist(), -1]  # the last, at -1, ends every search
    size_ = np.zeros(n, np.int64)
    size_[first] = sizes
    size, before = size_.tolist(), [-1] * n
    stop = n
    while stop > 0:
        start = group[order[stop - 1]]
        if stop - start == 1:
            i = order[start]
            j = i - 1
            while group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = group[j]
                if (many := size[g]) > 1:  # alone above its group
                    size[g] = many - 1
                    end = g + many - 1
                    at, other = place[j], order[end]
                    order[at], order[end], place[other], place[j] = other, j, at, end
                    group[j], size[end] = end, 1
        else:
            pointed: dict[int, int] = {}
            for i in sorted(order[start:stop]):
                j = i - 1
                while group[j] >= start:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: dict[int, list[int]] = {}
            for j, count in pointed.items():
                by_count.setdefault(count, []).append(j)
            for count in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                members = by_count[count]
                olds = [group[j] for j in members]
                for j, g in zip(members, olds, strict=True):
                    taken = moved.get(g, 0)
                    end = g + size[g] - 1 - taken
                    at, other = place[j], order[end]
                    order[at], order[end], place[other], place[j] = other, j, at, end
                    moved[g] = taken + 1
                for g, taken in moved.items():
                    size[g] -= taken
                    new = g + size[g]
                    if taken and size[g] == 0:
                        size[g] = taken  # all of the group moved: it stays as it is
                    else:
                        size[new] = taken
                for j, g in zip(members, olds, strict=True):
                    new = g + size[g]
                    if place[j] >= new:
                        group[j] = new
        stop = start
    free = list(range(n))  # the next free place of each group, by its first place
    placed = [False] * n
    out = [0] * n

    def place_chain(j: int) -> None:
        while j >= 0 and not placed[j]:
            placed[j] = True
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = before[j]

    place_chain(n - 1)
    for k in range(n):
        place_chain(out[k] - 1)
    return np.array(out, np.int64)
