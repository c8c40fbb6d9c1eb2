import random
import re

import pytest
from pyspark.sql import functions as F

from changeflow.operators import learning

LINES = "diff_id int, seq int, hunk_no int, op string, text string"


def queue_pairs(rows):
    """Oldest unmatched removed line first; cleared by context and at hunk borders; blank lines skipped."""
    pairs, queue, hunk = [], [], None
    for seq, (h, op, text) in enumerate(rows):
        if h != hunk or op == " ":
            queue, hunk = [], h
        if op == " ":
            continue
        content = " ".join(text.split())
        if content and op == "-":
            queue.append(content)
        elif content and queue:
            pairs.append((seq, queue.pop(0), content))
    return pairs


def test_replacement_pairs_equal_a_queue_in_any_order(spark):
    rng = random.Random(11)
    diffs = {0: [(0, "-", "Last updated: March 12"), (0, "+", "Last  updated: March 13"), (0, " ", "Pricing page")]}
    for d in range(1, 60):
        diffs[d] = [(i // 9, rng.choice("-+- + "), rng.choice(["a", "b  c", " ", "", "d\te"])) for i in range(rng.randrange(1, 40))]
    rows = [(d, i, h, op, text) for d, lines in diffs.items() for i, (h, op, text) in enumerate(lines)]
    got = learning.replacement_pairs(spark.createDataFrame(rows, LINES).repartition(5)).collect()
    want = {(d, *p) for d, lines in diffs.items() for p in queue_pairs(lines)}
    assert {(r.diff_id, r.seq, r.before, r.after) for r in got} == want and len(got) == len(want)
    assert (0, 1, "Last updated: March 12", "Last updated: March 13") in want


def test_propose_pattern():
    pattern, template, similarity = learning.propose_pattern("Last updated: March 12", "Last updated: March 13")
    assert pattern == r"^Last\s+updated:\s+March\s+.+?$" and template == "Last updated: March {var}" and similarity > 0.9
    for line in ("Last updated: March 25", "Last   updated:   March 31"):
        assert re.match(pattern, line)
    assert learning.propose_pattern("abc", "xyz") is None
    assert learning.propose_pattern("v 1", "v 2") is None  # too little literal text
    pattern, template, _ = learning.propose_pattern("10 people (a+b) read this today", "99 people (a+b) read this tonight")
    assert template == "{var} people (a+b) read this {var}"
    assert re.match(pattern, "7 people (a+b) read this now")


def test_every_pattern_matches_both_of_its_lines(spark):
    from changeflow.operators import change
    from changeflow.plans.queries import version_pairs
    from tests.conftest import SF

    pairs = learning.replacement_pairs(change.diff_snapshots(version_pairs(spark, SF)))
    found = learning.candidate_patterns(pairs).collect()
    assert len(found) > 1000
    for r in found:
        assert re.match(r.pattern, r.before) and re.match(r.pattern, r.after)


@pytest.mark.parametrize(
    "before, after, competitor, reason",
    [
        ("Enterprise plan: $99 per month", "Enterprise plan: $129 per month", "Acme Corp", "price_or_percentage_signal"),
        ("up 12.5 % today", "up", None, "price_or_percentage_signal"),
        ("in EUR", "", None, "price_or_percentage_signal"),
        ("Seats in the free tier 5", "Seats", None, "digit_adjacent_business_term"),
        ("We launched it", "We did", None, "change_action_word"),
        ("Acme notes updated", "Acme notes revised", "Acme Corp", "protected_token:acme"),
        ("our pricing and plans", "our trial", None, "protected_token:plans"),
        ("Last updated: March 12", "Last updated: March 13", "Acme", None),
    ],
)
def test_safeguards(spark, before, after, competitor, reason):
    got = spark.range(1).select(learning.safeguard_reason(F.lit(before), F.lit(after), F.lit(competitor).cast("string")).alias("r"))
    assert got.first().r == reason


OBS = "monitor_id string, diff_id int, pattern string, similarity double, blocked_reason string, observed_at timestamp"


def states(spark, rows, all_diffs=None):
    obs = spark.createDataFrame(rows, OBS)
    diffs = obs.select("monitor_id", "diff_id", F.col("observed_at").alias("created_at")) if all_diffs is None else all_diffs
    return {r.diff_id: r for r in learning.pattern_state(obs, diffs).collect()}


def test_promotion_decay_and_renewal(spark, at):
    day = 24
    rows = [("m", i, "p", 0.9, None, at(day * i)) for i in (1, 2, 3, 4)] + [("m", 5, "p", 0.9, None, at(day * 60))]
    got = states(spark, rows)
    assert [got[i].support_count for i in range(1, 6)] == [1, 2, 3, 4, 5]
    assert [got[i].is_active for i in range(1, 6)] == [False, False, True, True, True]
    # Active again after it had decayed for more than 48.76 days: promoted a second time.
    assert [got[i].promoted for i in range(1, 6)] == [False, False, True, False, True]
    assert got[4].promoted_at == at(day * 3) and got[5].promoted_at == at(day * 60)
    assert got[3].confidence == round(0.45 + 0.35 * 0.9 + 0.2, 4)


def test_confidence_threshold_and_lookback(spark, at):
    rows = [("m", i, "p", 0.60, None, at(i)) for i in range(3)]
    others = [("m", 100 + i, at(i + 0.5)) for i in range(6)] + [("m", 500, at(-24 * 100))]
    diffs = spark.createDataFrame([("m", i, at(i)) for i in range(3)] + others, "monitor_id string, diff_id int, created_at timestamp")
    got = states(spark, rows, diffs)
    assert got[2].recent_diffs == 5  # three of its own and two of the others so far; the old one is out of sight
    assert got[2].confidence == round(0.45 * 3 / 5 + 0.35 * 0.6 + 0.2, 4) and not got[2].is_active


def test_review_is_sticky_and_reason_is_latest(spark, at):
    reasons = [None, "a", None, "b", None]
    got = states(spark, [("m", i, "p", 1.0, r, at(i)) for i, r in enumerate(reasons)])
    assert [got[i].review_required for i in range(5)] == [False, True, True, True, True]
    assert [got[i].latest_blocked_reason for i in range(5)] == [None, "a", "a", "b", "b"]
    assert not any(r.is_active for r in got.values())


def test_a_diff_counts_once(spark, at):
    got = states(spark, [("m", 1, "p", 1.0, None, at(0)), ("m", 1, "p", 0.6, None, at(1)), ("m", 2, "p", 1.0, None, at(2))])
    assert got[2].support_count == 2 and got[2].avg_similarity == 1.0


def test_summary(spark, at):
    used = spark.createDataFrame(
        [("m", "p", 0.9, True, False, 25, 7), ("m", "q", 0.6, False, True, 5, 0)],
        "monitor_id string, pattern string, confidence double, is_active boolean, review_required boolean, total_lines_filtered long, lines_filtered_7d long",
    )
    monitors = spark.createDataFrame([("m",), ("none",)], "monitor_id string")
    got = {r.monitor_id: tuple(r)[1:] for r in learning.summarize_patterns(used, monitors).collect()}
    assert got == {"m": (2, 1, 1, 30, 7, 0.75), "none": (0, 0, 0, 0, 0, 0.0)}


def test_usage(spark, at):
    diffs = spark.createDataFrame([("m", 1, at(0), {"p": 7, "q": 0}), ("m", 2, at(24 * 9), {"p": 8})], "monitor_id string, diff_id int, created_at timestamp, learned_hits map<string,int>")
    events = learning.record_usage(diffs)
    assert events.count() == 2
    week = learning.recent_filter_sum(events, F.lit(at(24 * 10))).first()
    assert week.lines_filtered_7d == 8
    totals = learning.usage_totals(events).first()
    assert (totals.total_lines_filtered, totals.last_matched_at) == (15, at(24 * 9))
    assert learning.tracked_events(events, 1).first().diff_id == 2


def test_gate(spark, at):
    snaps = spark.createDataFrame([(i, "m", at(i)) for i in range(12)], "snapshot_id int, monitor_id string, created_at timestamp")
    diffs = spark.createDataFrame([(8, "m", 3), (9, "m", 3), (10, "m", 3), (11, "m", 0)], "diff_id int, monitor_id string, changed_lines int")
    pairs = spark.createDataFrame([(8, 1), (9, 1)], "diff_id int, pairs int")
    got = {r.diff_id: r.skip_reason for r in learning.learning_gate(diffs, snaps, pairs).collect()}
    assert got == {8: "insufficient_snapshot_history", 9: None, 10: "no_replacement_pairs", 11: "empty_diff"}


@pytest.mark.parametrize("length", [199, 200, 281, 400])
def test_long_lines_are_learned_from_alike(spark, length):
    words = ("visits today: 1234 people read this page " * 20)[: length - 6]
    pairs = spark.createDataFrame([(1, 0, words + " 11111", words + " 22222")], "diff_id int, seq int, before string, after string")
    found = learning.candidate_patterns(pairs).collect()
    assert len(found) == 1 and found[0].similarity > 0.9
    assert learning.candidate_patterns(pairs, max_chars=150).count() == 0


def test_weekly_sum_takes_every_event(spark, at):
    events = spark.createDataFrame([("m", "p", i, at(i * 0.1), 2) for i in range(300)], "monitor_id string, pattern string, diff_id int, at timestamp, count int")
    latest = spark.createDataFrame([("m", "p")], "monitor_id string, pattern string")
    row = learning.with_usage(latest, events, F.lit(at(31))).first()
    assert (row.lines_filtered_7d, row.total_lines_filtered) == (600, 600)
