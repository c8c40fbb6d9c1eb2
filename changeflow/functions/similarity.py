"""How alike two sequences are: the longest common run, then the same to its left and right.

The share of elements in such runs is the similarity. Runs are found with a suffix automaton,
in steps proportional to the lengths of the two parts. Whether a pair can reach a given
similarity at all is told first by two upper bounds: the elements both sides have in common
in any order, and their longest common subsequence, found 64 columns at a time by integer
arithmetic (the runs are in order on both sides, so they form a common subsequence).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def common_elements(old: Sequence, new: Sequence) -> int:
    """Elements that the sides share, in whatever order."""
    return (Counter(old) & Counter(new)).total()


def common_subsequence(old: Sequence, new: Sequence) -> int:
    """Length of the longest common subsequence, one bit a column of `old`."""
    columns: dict = {}
    for i, x in enumerate(old):
        columns[x] = columns.get(x, 0) | 1 << i
    full = (1 << len(old)) - 1
    free = full
    for x in new:
        here = free & columns.get(x, 0)
        free = (free + here | free - here) & full
    return len(old) - free.bit_count()


class _Runs:
    """The runs of a sequence as an automaton: a state per set of end places, with the first of them."""

    def __init__(self, elements: Sequence) -> None:
        self.moves: list[dict] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]
        last = 0
        for at, x in enumerate(elements):
            state = self._add(self.length[last] + 1, at, {})
            p = last
            while p >= 0 and x not in self.moves[p]:
                self.moves[p][x] = state
                p = self.link[p]
            if p < 0:
                self.link[state] = 0
            else:
                q = self.moves[p][x]
                if self.length[q] == self.length[p] + 1:
                    self.link[state] = q
                else:
                    twin = self._add(self.length[p] + 1, self.first_end[q], dict(self.moves[q]))
                    self.link[twin] = self.link[q]
                    self.link[q] = self.link[state] = twin
                    while p >= 0 and self.moves[p].get(x) == q:
                        self.moves[p][x] = twin
                        p = self.link[p]
            last = state

    def _add(self, length: int, end: int, moves: dict) -> int:
        self.moves.append(moves)
        self.link.append(-1)
        self.length.append(length)
        self.first_end.append(end)
        return len(self.moves) - 1

    def longest(self, elements: Sequence) -> tuple[int, int, int]:
        """(place in `elements`, place here, length) of the longest common run; the first of equals on either side."""
        state = size = 0
        best = (0, 0, 0)
        for at, x in enumerate(elements):
            while state and x not in self.moves[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.moves[state]:
                state, size = self.moves[state][x], size + 1
                if size > best[2]:
                    # The state's first end is that of its longest run, and of every run in it.
                    best = (at - size + 1, self.first_end[state] - size + 1, size)
        return best


def matching_runs(old: Sequence, new: Sequence) -> list[tuple[int, int, int]]:
    """(place in old, place in new, length) of the runs, in order."""
    out, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        i, j, size = _Runs(new[c:d]).longest(old[a:b])
        if size:
            out.append((a + i, c + j, size))
            todo += [(a, a + i, c, c + j), (a + i + size, b, c + j + size, d)]
    out.sort()
    return out


def similarity(old: Sequence, new: Sequence, least: float = 0.0) -> float | None:
    """Twice the elements in matching runs over all elements; none where it is below `least`."""
    total = len(old) + len(new)
    if not total:
        return 1.0
    for bound in (lambda: min(len(old), len(new)), lambda: common_elements(old, new), lambda: common_subsequence(old, new)):
        if 2.0 * bound() / total < least:
            return None
    found = 2.0 * sum(size for _, _, size in matching_runs(old, new)) / total
    return found if found >= least else None
