"""Suffix arrays by linear grouping (Lyndon-prefix groups, no renaming and no recursion).

Phase 1 refines groups of suffixes until all suffixes of a group share their longest Lyndon prefix. Groups are taken in
descending order; for each suffix of a group its previous-smaller pointer is the last earlier position in a lower group.
Positions so pointed at have the group's word appended to their prefix, so they leave their group upwards, the more often
pointed at the further. Phase 2 goes through the order from the least suffix on; each suffix found emits, along
previous-smaller pointers, the positions whose Lyndon prefix ends where it starts into the next free place of their group.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Positions of text in ascending order of their suffixes; a suffix that ends is lower than any that goes on."""
    n = len(text) + 1
    symbols = [0, *(c + 1 for c in text)]
    by: dict[int, list[int]] = {0: [n - 1]}
    for i in range(n - 1):
        by.setdefault(symbols[i + 1], []).append(i)
    group = [0] * n  # of each position: the first rank of its group
    size = [0] * (n + 1)  # by first rank
    start_of_end = [0] * (n + 1)  # group's first rank by the rank after its last
    members: dict[int, list[int]] = {}
    at = 0
    for c in sorted(by):
        own = by[c]
        for i in own:
            group[i] = at
        members[at], size[at] = own, len(own)
        start_of_end[at + len(own)] = at
        at += len(own)
    prev, skip = [-1] * n, [-1] * n
    end = n
    while end > 1:
        start = start_of_end[end]
        own = members.pop(start)
        if end - start == 1:
            for s in own:
                if group[s] == start:
                    break
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = skip[p]
            prev[s] = skip[s] = p
            if p >= 0:
                g = group[p]
                k = size[g]
                if k > 1:
                    size[g] = k - 1
                    new = g + k - 1
                    size[new], members[new], group[p] = 1, [p], new
                    start_of_end[g + k], start_of_end[new] = new, g
        else:
            hits: dict[int, int] = {}
            for s in own:
                if group[s] == start:
                    p = s - 1
                    while p >= 0 and group[p] >= start:
                        p = skip[p]
                    prev[s] = skip[s] = p
                    if p >= 0:
                        hits[p] = hits.get(p, 0) + 1
            counts: dict[int, dict[int, list[int]]] = {}
            for p, c in hits.items():
                counts.setdefault(c, {}).setdefault(group[p], []).append(p)
            for c in sorted(counts, reverse=True):
                for g, moved in counts[c].items():
                    k = len(moved)
                    left = size[g] - k
                    new = g + left
                    start_of_end[new + k] = new
                    moved.sort()
                    if left:
                        size[g], start_of_end[new] = left, g
                        for p in moved:
                            group[p] = new
                    members[new], size[new] = moved, k
        end = start
    order = [-1] * n
    order[0] = n - 1
    free = list(range(n))  # by first rank of a group: its next free rank
    placed = [False] * n
    placed[n - 1] = True
    for rank in range(n):
        s = order[rank] - 1
        while s >= 0 and not placed[s]:
            placed[s] = True
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            s = prev[s]
    return order[1:]
