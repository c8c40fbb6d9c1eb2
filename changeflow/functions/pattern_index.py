"""Many patterns against many lines: each pattern is filed under a piece of text it cannot match without.

A pattern's required literals are the plain characters that stand outside groups, classes and
optional parts. Of their three-letter pieces the one that fewest patterns share is its key. A
line is looked up by its own pieces, so it meets the patterns whose key it holds, and those
few that have no literal of three letters. What a line does not meet cannot match it; the
result is that of trying every pattern in order. Patterns are compiled once per worker.
"""

from __future__ import annotations

import re
from collections import Counter

SIZE = 3
#: Letters outside ASCII that match an ASCII letter when case is ignored.
_FOLD = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
_COUNT = re.compile(r"\{(\d*)(,?)(\d*)\}")
_CONTROL = {"n": "\n", "r": "\r", "t": "\t", "v": "\v", "f": "\f", "a": "\a"}
_HEX = {"x": 2, "u": 4, "U": 8}


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD).lower()


def _past_class(pattern: str, at: int) -> int:
    at += 2 if pattern[at + 1 : at + 2] == "^" else 1
    at += 1 if pattern[at : at + 1] == "]" else 0
    while at < len(pattern) and pattern[at] != "]":
        at += 2 if pattern[at] == "\\" else 1
    return at + 1


def _past_group(pattern: str, at: int) -> int:
    depth = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
        elif c == "[":
            at = _past_class(pattern, at)
        else:
            depth += (c == "(") - (c == ")")
            at += 1
            if not depth:
                break
    return at


def required_literals(pattern: str) -> list[str]:
    """Runs of ASCII characters, in lower case, that every match holds; none for a choice between patterns."""
    runs, run, at = [], "", 0

    def end() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    while at < len(pattern):
        c, literal = pattern[at], None
        if c == "|":
            return []
        if c == "(":
            end()
            at = _past_group(pattern, at)
        elif c == "[":
            end()
            at = _past_class(pattern, at)
        elif c == "\\":
            escaped = pattern[at + 1 : at + 2]
            at += 2
            if escaped in _CONTROL:
                literal = _CONTROL[escaped]
            elif escaped in _HEX:
                at += _HEX[escaped]
            elif escaped == "N":
                at = pattern.find("}", at) + 1 or len(pattern)
            elif escaped.isdigit():
                while at < len(pattern) and pattern[at].isdigit():
                    at += 1
            elif not escaped.isalpha():
                literal = escaped
        else:
            at += 1
            literal = None if c in ".^$" else c
        often = _COUNT.match(pattern, at)
        often = often if often and often[0] not in ("{}", "{,}") else None
        mark = pattern[at : at + 1]
        if literal is None or not literal.isascii():
            end()
        elif mark and mark in "?*" or often and int(often[1] or 0) == 0:
            end()
        else:
            run += literal.lower()
            if mark == "+" or often:
                end()
        if mark and mark in "?*+" or often:  # the mark, and one that makes it lazy or possessive
            at = often.end() if often else at + 1
            at += 1 if pattern[at : at + 1] and pattern[at] in "?+" else 0
    end()
    return runs


class Patterns:
    """Compiled patterns with their literals, kept across lists; a broken one is None."""

    def __init__(self, most: int = 20_000) -> None:
        self.known: dict[str, tuple[re.Pattern, list[str]] | None] = {}
        self.most = most

    def get(self, pattern: str) -> tuple[re.Pattern, list[str]] | None:
        if pattern not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            try:
                compiled = re.compile(pattern, re.IGNORECASE)
            except re.error:
                self.known[pattern] = None
            else:
                self.known[pattern] = compiled, [] if compiled.flags & re.VERBOSE else required_literals(pattern)
        return self.known[pattern]


class Index:
    """Patterns in the order they are applied; those from `learned_from` on report what they hit."""

    def __init__(self, patterns: list[str], learned_from: int, compiled: Patterns) -> None:
        self.entries = []
        for place, pattern in enumerate(patterns):
            found = compiled.get(pattern)
            if found is not None:
                self.entries.append((found[0], pattern, place >= learned_from, found[1]))
        pieces = [{run[i : i + SIZE] for run in e[3] for i in range(len(run) - SIZE + 1)} for e in self.entries]
        shared = Counter(piece for some in pieces for piece in some)
        self.filed: dict[str, list[int]] = {}
        self.short: list[tuple[str, int]] = []
        for number, (entry, some) in enumerate(zip(self.entries, pieces, strict=True)):
            if some:
                self.filed.setdefault(min(some, key=lambda x: (shared[x], x)), []).append(number)
            else:
                self.short.append((max(entry[3], key=len, default=""), number))

    def met(self, line: str, after: int = -1) -> list[int]:
        """Numbers of the patterns that can match the line, past a number, in order."""
        text = folded(line)
        found = [n for key in {text[i : i + SIZE] for i in range(len(text) - SIZE + 1)} & self.filed.keys() for n in self.filed[key]]
        found += [n for literal, n in self.short if literal in text]
        return sorted(n for n in found if n > after)

    def strip(self, line: str) -> tuple[str, list[str]]:
        """The line without what the patterns match, one after the other, and the learned ones that changed it."""
        hits: list[str] = []
        todo = self.met(line)
        while todo:
            for number in todo:
                regex, pattern, learned, _ = self.entries[number]
                left = regex.sub("", line)
                if left != line:
                    # What is left may hold pieces that were not there before.
                    line, todo = left, self.met(left, number)
                    if learned:
                        hits.append(pattern)
                    break
            else:
                break
        return line, hits
