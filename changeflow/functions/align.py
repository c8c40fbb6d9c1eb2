"""Alignment of two sequences of lines, and the hunks of a unified diff.

Equal heads and tails are cut off. What is left is anchored on lines that occur once on each
side; where there is none, the k-th occurrence of a line on one side is paired with the k-th
on the other. The longest increasing run of anchors stays, and the gaps between anchors are
treated alike. A level takes n log n steps and memory in proportion to the lines, whatever
their number or likeness.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs whose first parts increase; second parts already do."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tails, i)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(i)
            ends.append(k)
        else:
            tails[at], ends[at] = i, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _anchors(old: Sequence, new: Sequence, a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    places, counts = defaultdict(list), defaultdict(int)
    for i in range(a, b):
        places[old[i]].append(i)
    for j in range(c, d):
        counts[new[j]] += 1
    once = [(places[new[j]][0], j) for j in range(c, d) if counts[new[j]] == 1 and len(places.get(new[j], ())) == 1]
    if not once:
        nth: dict = defaultdict(int)
        for j in range(c, d):
            found = places.get(new[j])
            if found and nth[new[j]] < len(found):
                once.append((found[nth[new[j]]], j))
                nth[new[j]] += 1
    return _increasing(once)


def matches(old: Sequence, new: Sequence) -> list[tuple[int, int]]:
    """Pairs of positions of equal elements, increasing on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        i, j = a, c
        anchors = _anchors(old, new, a, b, c, d)
        for p, q in anchors:
            out.append((p, q))
            todo.append((i, p, j, q))
            i, j = p + 1, q + 1
        if anchors:
            todo.append((i, b, j, d))
    out.sort()
    return out


def changes(old: Sequence, new: Sequence) -> list[tuple[int, int, int, int]]:
    """(a, b, c, d): old[a:b] is replaced by new[c:d]."""
    out, i, j = [], 0, 0
    for p, q in [*matches(old, new), (len(old), len(new))]:
        if p > i or q > j:
            out.append((i, p, j, q))
        i, j = p + 1, q + 1
    return out


def hunks(old: Sequence, new: Sequence, context: int) -> Iterator[tuple[int, int, list[tuple[str, int]]]]:
    """(first old line, first new line, lines) per hunk; a line is an operator and its place on its side."""
    group: list[tuple[int, int, int, int]] = []
    for change in [*changes(old, new), None]:
        if group and (change is None or change[0] - group[-1][1] > 2 * context):
            first, last = group[0], group[-1]
            lead = min(context, first[0])
            lines = [(" ", i) for i in range(first[0] - lead, first[0])]
            at = first[0]
            for a, b, c, d in group:
                lines += [(" ", i) for i in range(at, a)]
                lines += [("-", i) for i in range(a, b)]
                lines += [("+", j) for j in range(c, d)]
                at = b
            lines += [(" ", i) for i in range(at, min(len(old), last[1] + context))]
            yield first[0] - lead, first[2] - lead, lines
            group = []
        if change is not None:
            group.append(change)
