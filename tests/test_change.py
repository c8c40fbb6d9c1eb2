import difflib
import random
import re

import pytest

from changeflow.functions import align
from changeflow.operators import change, ingest
from changeflow.plans.queries import version_pairs


def unified(before: str, after: str, n: int = 3) -> str:
    """What the standard library gives when both texts end in a line end."""
    ends = lambda t: [s if s.splitlines()[0] != s else s + "\n" for s in t.splitlines(keepends=True)]
    return "".join(difflib.unified_diff(ends(before), ends(after), "previous", "current", n=n))


def random_pairs():
    rng = random.Random(3)
    words = [f"line {i}" for i in range(30)] + ["", "-- dashes", "++ pluses", "@@ marks", "naïve ü"]
    pairs = []
    for size in [0, 1, 2, 5, 20, 60, 260]:
        for _ in range(8):
            before = [rng.choice(words) for _ in range(size)]
            after = [w if rng.random() < 0.8 else rng.choice(words) for w in before if rng.random() < 0.9]
            pairs.append(("\n".join(before), "\n".join(after)))
    pairs += [("", "new\ntext"), ("old\ntext", ""), ("Price: $99", "Price: $129"), ("Line 1", "Line 1\nLine 2")]
    return [p for p in pairs if unified(*p)]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, i % 3, i, b, a) for i, (b, a) in enumerate(random_pairs())]
    return spark.createDataFrame(rows, "diff_id int, monitor_id int, created_at int, text_before string, text_after string").cache()


def apply_unified(before: list[str], text: str) -> list[str]:
    """The later lines, from the earlier ones and a unified diff; checks every range and context line."""
    out, at = [], 0
    for line in text.split("\n")[2:-1]:
        if head := re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            start, size = int(head[1]), int(head[2] or 1)
            begin = start - 1 if size else start
            out += before[at:begin]
            at = begin
            assert len(out) == (int(head[3]) - 1 if int(head[4] or 1) else int(head[3]))
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert before[at] == line[1:]
            out += [line[1:]] if line[0] == " " else []
            at += 1
    return out + before[at:]


def test_rendered_diff_rebuilds_the_later_text(pairs):
    lines = change.diff_snapshots(pairs).cache()
    got = {r.diff_id: r.unified_diff for r in change.render_unified(lines).collect()}
    stats = {r.diff_id: r for r in change.diff_stats(lines).collect()}
    fewest = most = 0
    for r in pairs.collect():
        s, text = stats[r.diff_id], got[r.diff_id]
        before, after = r.text_before.splitlines(), r.text_after.splitlines()
        assert apply_unified(before, text) == after
        assert s.diff_size_bytes == len(text.encode()) and s.changed_hunks == text.count("\n@@ -")
        body = [line[0] for line in text.split("\n")[2:-1] if not line.startswith("@@ -")]
        assert (s.lines_added, s.lines_removed) == (body.count("+"), body.count("-"))
        most += s.lines_added + s.lines_removed
        fewest += sum(d[0] in "+-" for d in difflib.unified_diff(before, after, lineterm="", n=0)) - 2
    assert most <= 1.2 * fewest


@pytest.mark.parametrize("repeats", [33, 34, 400])
def test_one_changed_line_among_repeating_ones(repeats):
    before = ["a", "b", "c", "d", "e", "f"] * repeats
    after = list(before)
    after[100] = "new"
    rows = list(change.line_diff("\n".join(before), "\n".join(after)))
    assert [r[4] for r in rows if r[3] != " "] == [before[100], "new"]


def test_gaps_hold_nothing_equal():
    rng = random.Random(5)
    for _ in range(300):
        old = [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]
        new = [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]
        found = align.matches(old, new)
        assert all(old[i] == new[j] for i, j in found) and found == sorted(set(found))
        assert all(p[1] < q[1] for p, q in zip(found, found[1:]))
        assert not any(set(old[a:b]) & set(new[c:d]) for a, b, c, d in align.changes(old, new))


def test_long_unlike_pages():
    rng = random.Random(6)
    old, new = ([str(rng.randrange(60)) for _ in range(40_000)] for _ in range(2))
    assert len(align.matches(old, new)) > 1000


def test_changed_last_line_stays_two_lines():
    assert [(r[3], r[4]) for r in change.line_diff("Price: $99", "Price: $129")] == [("-", "Price: $99"), ("+", "Price: $129")]
    assert [(r[3], r[4]) for r in change.line_diff("A", "A\nB")] == [(" ", "A"), ("+", "B")]


def test_identical_pair(spark, pairs):
    lines = change.diff_snapshots(pairs)
    both = pairs.select("diff_id").union(spark.createDataFrame([(999,)], "diff_id int"))
    marked = {r.diff_id: r.is_identical for r in change.mark_identical(both, change.diff_stats(lines)).collect()}
    assert marked.pop(999) and not any(marked.values())


def test_pairs_and_status(spark, at):
    rows = [("s1", "m", "h1", at(0)), ("s2", "m", "h1", at(1)), ("s3", "m", "h2", at(30)), ("s4", "m", "h3", at(99)), ("t1", "n", "h1", at(0))]
    snaps = spark.createDataFrame(rows, "snapshot_id string, monitor_id string, text_hash string, created_at timestamp")
    pairs = change.pair_snapshots(snaps)
    assert {r.snapshot_id: r.before_id for r in pairs.collect()} == {"s1": None, "s2": "s1", "s3": "s2", "s4": "s3", "t1": None}
    diffs = spark.createDataFrame([("s3", True), ("s4", False)], "snapshot_after_id string, is_empty_after_filter boolean")
    done = spark.createDataFrame([("s4",)], "diff_id string")
    status = {r.snapshot_id: r.status for r in change.snapshot_status(pairs, diffs, done).collect()}
    assert status == {"s1": "baseline", "s2": "no_change", "s3": "no_change", "s4": "classified", "t1": "baseline"}


def test_applying_a_diff_gives_the_later_text(spark):
    from tests.conftest import SF

    pairs = version_pairs(spark, SF)
    rows = change.diff_snapshots(pairs, context=10**6).collect()
    texts = {r.diff_id: r.text_after for r in pairs.collect()}
    built: dict = {}
    for r in sorted(rows, key=lambda r: (r.diff_id, r.seq)):
        if r.op != "-":
            built.setdefault(r.diff_id, []).append(r.text)
    assert {k: "\n".join(v) for k, v in built.items()} == texts


def test_hash_filter_comes_before_the_texts(spark, at):
    rows = [("a", "m", "same", at(0)), ("b", "m", "same", at(1)), ("c", "m", "other", at(2))]
    snaps = ingest.fingerprint_text(spark.createDataFrame(rows, "snapshot_id string, monitor_id string, extracted_text string, created_at timestamp"))
    assert [r.diff_id for r in change.changed_pairs(snaps).collect()] == ["c"]
