"""Suffix sorting by Lyndon-prefix groups (after Baier's linear construction).

First, suffixes are put into groups of equal Lyndon prefix, groups in order.  They
begin grouped by first symbol, and groups are processed in descending order: every
suffix of the group points to the nearest suffix before it in a lower group (its
previous smaller one); suffixes pointed at have the group's prefix appended to their
own, as often as they are pointed at, and so rise within their group to new groups.

Then, without renaming or recursion, suffixes are emitted in order: once a suffix is
emitted, those whose Lyndon prefix ends where it begins - found along the pointers -
are next in their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """Start of each suffix's group, and its pointer.  ``text`` ends with its only
    least symbol."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, start, end = [0] * n, [0] * n, {}
    first = 0
    for k, i in enumerate(order):
        if text[i] != text[order[first]]:
            end[first] = k
            first = k
        place[i], start[i] = k, first
    if n:
        end[first] = n
    pointer = [-1] * n
    done = n
    while done > 0:
        group = start[order[done - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[group:done]):
            p = i - 1
            while p >= 0 and start[p] >= group:
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_rise: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            by_rise.setdefault((start[p], times), []).append(p)
        for key in sorted(by_rise, reverse=True):
            old, risen = key[0], by_rise[key]
            stop = end[old]
            fresh = stop - len(risen)
            for k, p in enumerate(risen, fresh):  # to the end of its group
                other, at = order[k], place[p]
                order[at], order[k] = other, p
                place[other], place[p] = at, k
                # what stood there may rise later in this loop; its place is kept
            for p in risen:
                start[p] = fresh
            end[fresh] = stop
            if fresh > old:
                end[old] = fresh
        done = group
    return start, pointer


def suffix_array(text: Sequence[int]) -> list[int]:
    """The order of all suffixes of ``text``, whose last symbol is its only least one."""
    n = len(text)
    start, pointer = lyndon_groups(text)
    free = {g: g for g in set(start)}
    out, known = [-1] * n, [False] * n
    if n:
        out[0], known[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not known[j]:
            g = start[j]
            out[free[g]] = j
            free[g] += 1
            known[j] = True
            j = pointer[j]
    return out
