"""The pattern index against trying every pattern in turn."""

import random
import re

import pytest

from changeflow.functions.pattern_index import Index, Patterns, folded, required_literals
from changeflow.operators import noise

PIECES = ["abc", "Build", "visits", "id", "x", r"\d+", r"\s+", ".+?", "^", "$", "[a-f]+", "[^]x]", "(?:foo|bar)", "(ba(z)q)?", "k+", "s?", "ing{2}", "ed{0,1}", r"\.", r"\-", r"\b", "ü", r"\t", r"\x41", "[(]", r"(?=z)", "i*?", "o{2,}", "{a}", r"B"]
WORDS = ["abc", "Build", "BUILD", "visits", "viſits", "id", "x", "12", " ", "foo", "bar", "bazq", "k", "K", "s", "inging", "ed", ".", "-", "ü", "Ü", "\t", "A", "(", "z", "i", "İ", "oo", "{a}", "B", "3.4", "tail"]


def one_by_one(patterns, learned_from, line):
    hits = []
    for place, pattern in enumerate(patterns):
        try:
            left = re.sub(pattern, "", line, flags=re.IGNORECASE)
        except re.error:
            continue
        if left != line and place >= learned_from:
            hits.append(pattern)
        line = left
    return line, hits


@pytest.mark.parametrize("seed", range(4))
def test_equals_trying_every_pattern(seed):
    rng, compiled = random.Random(seed), Patterns()
    for _ in range(150):
        patterns = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.2:
            patterns += ["[broken", "abc|visits", "(?x) a b c", "(?i:build) x", ""]
        learned_from = rng.randint(0, len(patterns))
        index = Index(patterns, learned_from, compiled)
        for _ in range(15):
            line = "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))
            assert index.strip(line) == one_by_one(patterns, learned_from, line)


@pytest.mark.parametrize(
    "pattern, runs",
    [
        (r"^Build\s+.+?$", ["build"]), (r"visits: \d+", ["visits: "]), ("abc?d", ["ab", "d"]), ("abc*", ["ab"]), ("abc+d", ["abc", "d"]), ("a|b", []), ("x(a|b)yz", ["x", "yz"]),
        ("ab{0,2}c", ["a", "c"]), ("ab{2}c", ["ab", "c"]), (r"a\.b\-c", ["a.b-c"]), ("größe", ["gr", "e"]), (r"a\x41b", ["a", "b"]), ("[abc]def", ["def"]), (r"ab\1c", ["ab", "c"]), ("a{x}", ["a{x}"]), ("ab+?c", ["ab", "c"]),
    ],
)
def test_required_literals(pattern, runs):
    assert required_literals(pattern) == runs


def test_letters_that_fold_to_ascii():
    assert folded("viſit Key İstanbul ı") == "visit key istanbul i"
    assert Index(["key"], 0, Patterns()).strip("a KEY b") == ("a  b", ["key"])


def test_a_thousand_patterns_cost_like_ten():
    """A line is tried against the few patterns that can match it, however many there are."""
    words = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=7)) for i in range(1000)]
    lines = [f"{words[i % 1000]} counter {i} and more text of a page" for i in range(400)]
    tried = {}
    for n in (10, 1000):
        index = Index([rf"^{w}\s+counter\s+.+?$" for w in words[:n]], 0, Patterns())
        tried[n] = max(len(index.met(line)) for line in lines)
        assert [index.strip(x)[0] for x in lines[:n]] == [""] * min(n, 400)
    assert tried[1000] <= tried[10] + 3


SCHEMA = "diff_id int, monitor_id string, seq int, hunk_no int, before_start int, after_start int, op string, text string"


def test_diffs_with_and_without_patterns(spark):
    """Patterns hold for their own diff only; neighbours in a task are left alone, and no header row comes out."""
    rows = [(d, f"m{d % 7}", s, 0, 0, 0, "+-"[s % 2] if s % 5 else " ", f"item {d} visits: {s} of word{s % 3}") for d in range(120) for s in range(11)]
    lines = spark.createDataFrame(rows, SCHEMA)
    monitors = spark.createDataFrame([(f"m{i}", [r"VISITS: \d+", "[broken"] if i in (1, 4) else []) for i in range(7)], "monitor_id string, noise_patterns array<string>")
    learned = spark.createDataFrame([(d, ["of word2", r"^item\s+\d+\s+.+?$"]) for d in range(0, 120, 3)], "diff_id int, learned_patterns array<string>")
    heads = lines.select("diff_id", "monitor_id").distinct()
    got = noise.strip_noise(noise.attach_patterns(lines, monitors, learned, heads)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.op == " ":
            assert r.residual is None and not r.hit_patterns
            continue
        own = [r"VISITS: \d+"] if int(r.monitor_id[1:]) in (1, 4) else []
        mine = ["of word2", r"^item\s+\d+\s+.+?$"] if r.diff_id % 3 == 0 else []
        left, hits = one_by_one([*own, *mine], len(own), r.text)
        assert (r.residual, r.hit_patterns) == (left.strip(), hits)


def test_lines_with_patterns_are_shuffled_once(spark):
    lines = spark.createDataFrame([(1, "m", 0, 0, 0, 0, "+", "a line of text")], SCHEMA)
    learned = spark.createDataFrame([(1, ["a line"])], "diff_id int, learned_patterns array<string>")
    diffs = noise.filter_diffs(noise.attach_patterns(lines, None, learned), carry=("monitor_id",))
    (row,) = diffs.collect()
    assert (row.original_lines, row.noise_lines_removed, row.monitor_id) == (1, 0, "m")
    plan = diffs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # One exchange of lines below Python; the ones above it move a row per hunk and a row per diff.
    above, below = plan.split("ArrowEvalPython")
    assert below.count("REPARTITION_BY_COL") == 1 and above.count("partial_") > 0 and above.count("Exchange hashpartitioning(diff_id") == 2
