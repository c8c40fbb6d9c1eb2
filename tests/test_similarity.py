"""Matching runs and their bounds against the plain definitions."""

import random
import time
from difflib import SequenceMatcher

import pytest

from changeflow.functions import similarity as s
from changeflow.operators.learning import propose_pattern


def texts(seed, n):
    rng = random.Random(seed)
    words = ["price", "of", "the", "item", "12", "345", "now", "é", "日本", "  ", "\t", "-", "aa", "aaa", "ab", "ba"]
    for _ in range(n):
        old = [rng.choice(words) for _ in range(rng.randint(0, 14))]
        new = [w if rng.random() < 0.7 else rng.choice(words) for w in old][: rng.randint(0, 20)]
        yield " ".join(old), " ".join(new)


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_the_definition(seed):
    for old, new in texts(seed, 400):
        for a, b in ((old, new), (old.split(" "), new.split(" "))):
            plain = SequenceMatcher(None, a, b, autojunk=False)
            assert s.similarity(a, b) == pytest.approx(plain.ratio(), abs=1e-12)
            covered = {(i + x, j + x) for i, j, n in s.matching_runs(a, b) for x in range(n)}
            assert covered == {(i + x, j + x) for i, j, n in plain.get_matching_blocks() for x in range(n)}


def test_bounds_hold_and_are_exact_lengths():
    for old, new in texts(9, 300):
        table = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
        for i, x in enumerate(old):
            for j, y in enumerate(new):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        longest = s.common_subsequence(old, new)
        assert longest == table[-1][-1]
        assert sum(n for _, _, n in s.matching_runs(old, new)) <= longest <= s.common_elements(old, new) <= min(len(old), len(new))


def test_below_the_least_is_none():
    for old, new in texts(4, 300):
        exact = s.similarity(old, new)
        assert s.similarity(old, new, 0.58) == (exact if exact >= 0.58 else None)
    assert s.similarity("", "") == 1.0 and s.similarity("", "a", 0.1) is None


def test_long_lines_take_steps_in_proportion():
    rng = random.Random(1)
    line = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    other = "".join(rng.choice("ijklmnop ") for _ in range(100_000))
    started = time.perf_counter()
    changed = line[:50_000] + "X" * 10 + line[50_000:]
    assert s.similarity(line, changed, 0.58) == pytest.approx(2 * 100_000 / 200_010)
    assert s.similarity(line, other, 0.58) is None
    assert propose_pattern(line, changed) is not None
    assert time.perf_counter() - started < 30
