"""Suffix sorting by groups of equal Lyndon prefixes, in linear time and without recursive renaming.

Suffixes begin in groups by their first symbol, in order. Groups are taken in descending order. For each
suffix of the group taken, its previous-smaller pointer is the last position before it whose suffix is in a
lower group. The suffixes pointed to have the group's common prefix following their own, as often as they
are pointed to; they leave their group for a new one right above it, the most often pointed to being the
highest. When all groups are done, suffixes share a group if and only if their longest Lyndon prefixes
are equal. Then one pass in ascending order emits each group: the suffix before each one emitted, and
those on its chain of previous-smaller pointers, take the next free places of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


class _Group:
    __slots__ = ("above", "below", "done", "free", "members")

    def __init__(self) -> None:
        self.above: _Group | None = None  # the next higher group
        self.below: _Group | None = None  # the next lower one
        self.done = False
        self.free = 0  # the next place to fill
        self.members: list[int] = []


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of the suffixes of ``text`` in ascending order (a proper prefix comes first)."""
    n = len(text)
    if not n:
        return []
    by: dict[int, _Group] = {}
    at: list[_Group] = []
    for i, c in enumerate(text):
        if (g := by.get(c)) is None:
            g = by[c] = _Group()
        g.members.append(i)
        at.append(g)
    group = None
    for c in sorted(by):
        by[c].below = group
        if group is not None:
            group.above = by[c]
        group = by[c]
    before = [-1] * n
    order: list[_Group] = []
    while group is not None:
        mine = [i for i in group.members if at[i] is group]
        if len(mine) < len(group.members):
            group.members = mine
        group.done = True  # positions of this group are no longer lower
        order.append(group)
        times: dict[int, int] = {}
        mine.sort()
        for s in mine:
            p = s - 1
            while p >= 0 and at[p].done:
                p = before[p]
            before[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            classes: dict[int, list[int]] = {}
            for p, k in times.items():
                classes.setdefault(k, []).append(p)
            for k in sorted(classes, reverse=True):
                new: dict[_Group, _Group] = {}
                for p in classes[k]:
                    u = at[p]
                    if (v := new.get(u)) is None:
                        v = new[u] = _Group()
                        v.below, v.above, u.above.below, u.above = u, u.above, v, v
                    v.members.append(p)
                    at[p] = v
        group = group.below
    start = 0
    for g in reversed(order):
        g.free = start
        start += len(g.members)
    out = [-1] * n
    placed = bytearray(n)

    def emit(s: int) -> None:
        while s >= 0 and not placed[s]:
            g = at[s]
            out[g.free] = s
            g.free += 1
            placed[s] = 1
            s = before[s]

    emit(n - 1)
    for i in range(n):
        emit(out[i] - 1)
    return out
