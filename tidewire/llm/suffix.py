"""Linear suffix sorting by grouping."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of ``text``, whose symbols are integers.

    First all suffixes fall into groups of equal Lyndon prefixes. Groups are taken in
    descending order; every member points to the nearest suffix before it that lies in a
    smaller group, and those pointed to move to new groups just above their old ones, the
    more pointers the higher, since their prefix grows by that many copies of the group's.
    When all groups are final, one pass over the array as it fills emits each group's
    order: the suffixes whose next smaller suffix has just been placed follow the pointers
    back to the front of what is free of their groups. Nothing is renamed or sorted again.
    """
    n = len(text)
    symbols = sorted(set(text))
    rank = {c: g for g, c in enumerate(symbols)}
    group = [rank[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    done = [False] * len(symbols)
    smaller = [-1] * n
    order = []
    g = len(symbols) - 1
    while g >= 0:
        done[g] = True
        order.append(g)
        own = members[g]
        if len(own) > 1:
            own = sorted(i for i in own if group[i] == g)
        pointed: dict[int, int] = {}
        for i in own:
            if group[i] != g:
                continue
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moved.setdefault((group[j], times), []).append(j)
        # Most pointers first: each new group goes right above the old one, below those before.
        for old, times in sorted(moved, key=lambda x: -x[1]) if len(moved) > 1 else moved:
            new, up = len(members), above[old]
            members.append(moved[old, times])
            done.append(False)
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            for j in members[new]:
                group[j] = new
        g = below[g]
    sizes = [0] * len(members)
    for x in group:
        sizes[x] += 1
    front, total = [0] * len(members), 0
    for x in reversed(order):
        front[x] = total
        total += sizes[x]
    out, placed = [-1] * n, [False] * n
    j = n - 1  # the end of the text comes before every suffix
    k = 0
    while True:
        while j >= 0 and not placed[j]:
            placed[j] = True
            x = group[j]
            out[front[x]] = j
            front[x] += 1
            j = smaller[j]
        if k == n:
            return out
        j = out[k] - 1
        k += 1
