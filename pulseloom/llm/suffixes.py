"""Suffix sorting by linear grouping construction.

Phase 1 groups suffixes by their Lyndon prefix. Groups are taken in descending order. For each suffix
of the group, its previous-smaller pointer leads to the nearest suffix before it that lies in a
lower group; suffixes pointed at grow their Lyndon prefix by the group's, so they are split off to just
above the rest of their own group, the more often pointed at the higher.

Phase 2 emits the order. Suffix s, once placed, places those whose Lyndon prefix ends at s: s - 1,
then along its previous-smaller pointers, each at the next free place of its group. Nothing is
renamed or sorted recursively.
"""

from __future__ import annotations


def suffix_order(s: bytes | list[int]) -> list[int]:
    """Start positions of all suffixes of ``s`` in ascending order (a prefix comes before what it starts)."""
    n = len(s)
    if not n:
        return []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        if c in first:
            first[c].append(i)
        else:
            first[c] = [i]
    order: list[int] = []  # suffixes, group by group
    low: list[int] = []  # by group: first place
    high: list[int] = []  # by group: last place
    group = [0] * n
    for g, c in enumerate(sorted(first)):
        low.append(len(order))
        order += first[c]
        high.append(len(order) - 1)
        for i in first[c]:
            group[i] = g
    place = [0] * n
    for k, i in enumerate(order):
        place[i] = k
    prev = [-2] * n  # -2: not known yet; -1: none
    top = n - 1
    while top >= 0:
        g = group[order[top]]
        start = low[g]
        if start == top:  # most groups are single suffixes in the end
            i = order[top]
            p = i - 1
            while p >= 0 and place[p] > top:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                h = group[p]
                last = high[h]
                if low[h] != last:
                    q, k = order[last], place[p]
                    order[k], order[last] = q, p
                    place[q], place[p] = k, last
                    high[h] = last - 1
                    group[p] = len(low)
                    low.append(last)
                    high.append(last)
            top -= 1
            continue
        pointed: dict[int, int] = {}
        for k in range(start, top + 1):
            i = order[k]
            # A member's pointer is that of the member before it where no lower suffix lies between.
            chain = []
            while True:
                if (p := prev[i]) != -2:
                    break
                p = i - 1
                while p >= 0 and place[p] > top:
                    p = prev[p]
                chain.append(i)
                if p < 0 or place[p] < start:
                    break
                i = p
            for i in chain:
                prev[i] = p
        for k in range(start, top + 1):
            p = prev[order[k]]
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            if len(pointed) == 1 or max(pointed.values()) == 1:
                levels = [list(pointed)]
            else:
                by: dict[int, list[int]] = {}
                for p, c in pointed.items():
                    by.setdefault(c, []).append(p)
                levels = [by[c] for c in sorted(by, reverse=True)]
            for level in levels:
                ends: dict[int, int] = {}
                for p in level:
                    h = group[p]
                    last = high[h]
                    if h not in ends:
                        ends[h] = last
                    q, k = order[last], place[p]
                    order[k], order[last] = q, p
                    place[q], place[p] = k, last
                    high[h] = last - 1
                for h, end in ends.items():
                    if high[h] < low[h]:
                        high[h] = end  # all of what was left moved: the group stays as it is
                    else:
                        new, begin = len(low), high[h] + 1
                        low.append(begin)
                        high.append(end)
                        for k in range(begin, end + 1):
                            group[order[k]] = new
        top = start - 1
    out = [-1] * n
    free = low
    placed = [False] * n
    p = n - 1
    while p >= 0 and not placed[p]:
        placed[p] = True
        g = group[p]
        out[free[g]] = p
        free[g] += 1
        p = prev[p]
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not placed[p]:
            placed[p] = True
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = prev[p]
    return out
