import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from changeflow.operators import suppress

DAY = suppress.WINDOW


def replay(rows):
    """rows: (t, rank, text, flips) in order; every created alert is kept for good and looked up by age."""
    made, out = [], []
    for t, rank, text, flips in rows:
        recent = [m for m in made if m[0] >= t - DAY]
        if any(m[2] == text for m in recent):
            out.append(suppress.SAME)
        elif recent and rank <= max(m[1] for m in recent):
            out.append(suppress.BELOW)
        elif flips:
            out.append(suppress.FLIPS)
        else:
            out.append(suppress.CREATED)
            made.append((t, rank, text))
    return out


@pytest.mark.parametrize("n, minutes", [(40, 600), (63, 30), (500, 60), (5000, 3), (3000, 700)])
def test_runs_equal_a_plain_replay(n, minutes):
    rng = random.Random(n)
    t, rows = 0, []
    for _ in range(n):
        t += rng.choice([0, 1, rng.randrange(1, minutes * 2), DAY // 60_000_000 if rng.random() < 0.02 else 1]) * 60_000_000
        rows.append((t, rng.choice([2, 2, 2, 3, 3, 4]), rng.choice("abcdef"), rng.random() < 0.1))
    cols = [list(c) for c in zip(*rows)]
    for step in (n, 7, 64, 65, 200):  # any cut into batches gives the same
        got, alive = [], []
        for lo in range(0, n, step):
            outcome, _ = suppress.suppress_run(*[c[lo : lo + step] for c in cols], alive)
            got += outcome
            assert len(alive) <= 5
        assert got == replay(rows)


CAND = "diff_id int, monitor_id string, severity string, summary string, created_at timestamp"


def test_normalize(spark):
    texts = ["Pricing changed from $10 to $15", "Pricing changed from $12.50 to  $18", "On 2024-03-01 up 12.5%  ", "ÉTÉ 3"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(suppress.normalize_summary(F.col("s")).alias("n"))
    assert [r.n for r in df.collect()] == ["pricing changed from $ to $", "pricing changed from $ to $", "on -- up", "été"]


def test_severity_pairs_and_bounds(spark, at):
    rows = [
        (1, "a", "medium", "one", at(0)), (2, "a", "medium", "two", at(1)), (3, "a", "critical", "three", at(2)), (4, "a", "high", "four", at(26)),
        (5, "a", "medium", "five", at(27)), (6, "b", "critical", "x 1", at(0)), (7, "b", "critical", "x 2", at(24)), (8, "b", "critical", "x 3", at(24.001)),
        (9, "c", "low", "never mind", at(0)), (10, "c", "medium", "first", at(1)),
    ]
    snaps = spark.createDataFrame([("a", 1, "h", at(0))], "monitor_id string, snapshot_id int, text_hash string, created_at timestamp")
    out = suppress.suppress_alerts(spark.createDataFrame(rows, CAND), snaps)
    got = {r.diff_id: r.outcome for r in out.collect()}
    assert got == {
        1: "created", 2: "severity", 3: "created", 4: "severity", 5: "created", 6: "created", 7: "same_summary", 8: "created", 9: "created", 10: "created",
    }
    assert {r.diff_id: r.reason for r in out.collect()}[4] == "Severity high does not exceed recent max (critical)"
    report = {(r.kind, r.label): r.n for r in suppress.suppression_report(out).collect()}
    assert report[("suppressed", "severity")] == 2 and report[("created", "critical")] == 3


@pytest.mark.parametrize("hashes, flag", [("ABABAB", True), ("AB", False), ("ABCD", False), ("AAAA", False), ("ABAB", False), ("ABABA", True), ("XXABABAB", True), ("ABABABBB", False)])
def test_oscillation(spark, at, hashes, flag):
    rows = [("m", i, h, at(30 * i)) for i, h in enumerate(hashes)]
    snaps = spark.createDataFrame(rows, "monitor_id string, snapshot_id int, text_hash string, created_at timestamp")
    last = suppress.oscillation_flags(snaps).orderBy(F.desc("created_at")).first()
    assert last.oscillates == flag
    asked = spark.createDataFrame([(1, "m", "medium", "s", at(30 * len(hashes))), (2, "other", "medium", "s", at(0))], CAND)
    got = {r.diff_id: r.outcome for r in suppress.suppress_alerts(asked, snaps).collect()}
    assert got == {1: "oscillation" if flag else "created", 2: "created"}


def test_one_monitor_with_most_rows_and_any_partitioning(spark):
    rng = random.Random(5)
    start, rows = datetime(2024, 1, 1), []
    for i in range(4000):
        monitor = "hot" if i % 3 else f"m{rng.randrange(50)}"
        rows.append((i, monitor, rng.choice(["medium", "high", "critical"]), rng.choice("abcd"), start + timedelta(minutes=rng.randrange(60 * 24 * 40))))
    snaps = spark.createDataFrame([("hot", 1, "h", start)], "monitor_id string, snapshot_id int, text_hash string, created_at timestamp")
    want = {}
    ranks = {"medium": 2, "high": 3, "critical": 4}
    for monitor in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == monitor), key=lambda r: (r[4], r[0]))
        outcome = replay([(int((r[4] - start).total_seconds()) * 1_000_000, ranks[r[2]], r[3], False) for r in mine])
        want.update({r[0]: suppress.OUTCOMES[o] for r, o in zip(mine, outcome)})
    for partitions in (1, 13):
        shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), CAND).repartition(partitions)
        got = {r.diff_id: r.outcome for r in suppress.suppress_alerts(shuffled, snaps, partitions=partitions).collect()}
        assert got == want


@pytest.mark.parametrize("unit", ["hour", "minute"])
def test_finer_slices_give_the_same(spark, unit):
    from changeflow.functions.scans import SLICE_CONF

    start = datetime(2024, 1, 1)
    rows = [("m", i, "ab"[i % 3 == 0], start + timedelta(minutes=7 * i)) for i in range(400)]
    snaps = spark.createDataFrame(rows, "monitor_id string, snapshot_id int, text_hash string, created_at timestamp")
    want = {r.snapshot_id: r.flips for r in suppress.oscillation_flags(snaps).collect()}
    spark.conf.set(SLICE_CONF, unit)
    try:
        got = {r.snapshot_id: r.flips for r in suppress.oscillation_flags(snaps).collect()}
    finally:
        spark.conf.unset(SLICE_CONF)
    assert got == want


def test_rules_against_a_given_history(spark, at):
    history = spark.createDataFrame(
        [(1, "m", "high", "Price 10", at(0)), (2, "m", "low", "Other", at(20))],
        "alert_id int, monitor_id string, severity string, summary string, created_at timestamp",
    )
    asked = spark.createDataFrame(
        [(10, "m", "high", "price 99", at(24)), (11, "m", "medium", "price 99", at(24.01)), (12, "m", "low", "x", at(44)), (13, "n", "low", "price 1", at(1))], CAND
    )
    same = {r.diff_id: r.same_summary for r in suppress.same_summary_rule(asked, history).collect()}
    assert same == {10: True, 11: False, 12: False, 13: False}
    below = {r.diff_id: (r.recent_max, r.not_above) for r in suppress.severity_rule(asked, history).collect()}
    assert below == {10: ("high", True), 11: ("low", False), 12: ("low", True), 13: (None, False)}


def hot_monitor(n, quiet=None, seed=7):
    """One monitor, never silent for long, out of order in the table; and what the serial replay decides."""
    rng = random.Random(seed)
    start, t, rows = datetime(2024, 1, 1), 0, []
    for i in range(n):
        t += quiet if quiet and i % 300 == 299 else rng.randrange(1, 40)
        rows.append((i, "hot", rng.choice(["medium", "medium", "high", "critical"]), rng.choice("abcdefgh"), start + timedelta(minutes=t)))
    ranks = {"medium": 2, "high": 3, "critical": 4}
    outcome = replay([(int((r[4] - start).total_seconds()) * 1_000_000, ranks[r[2]], r[3], False) for r in rows])
    return rng.sample(rows, n), {r[0]: suppress.OUTCOMES[o] for r, o in zip(rows, outcome)}


@pytest.mark.parametrize("slice_rows, quiet, most", [(300, None, 8), (100, 3 * 24 * 60, 5), (100_000, None, 1)])
def test_a_monitor_that_is_never_silent_is_spread_over_slices(spark, slice_rows, quiet, most):
    rows, want = hot_monitor(2400, quiet)
    snaps = spark.createDataFrame([("hot", 1, "h", datetime(2024, 1, 1))], "monitor_id string, snapshot_id int, text_hash string, created_at timestamp")
    decided, replayed = suppress.decide_alerts(spark.createDataFrame(rows, CAND), snaps, slice_rows=slice_rows)
    assert {r.diff_id: r.outcome for r in decided.collect()} == want
    assert 1 <= replayed.rounds <= most
    assert replayed.states.count() == 1


def test_a_replay_goes_on_from_its_states(spark):
    rows, want = hot_monitor(1500)
    rows.sort(key=lambda r: r[4])
    rows += [(9000 + i, "other", "high", "x", rows[0][4] + timedelta(hours=i)) for i in range(3)]
    snaps = spark.createDataFrame([("hot", 1, "h", datetime(2024, 1, 1))], "monitor_id string, snapshot_id int, text_hash string, created_at timestamp")
    first, second = rows[:700] + rows[1500:], rows[700:1500]
    for slice_rows in (100, 100_000):
        one, before = suppress.decide_alerts(spark.createDataFrame(first, CAND), snaps, slice_rows=slice_rows)
        two, after = suppress.decide_alerts(spark.createDataFrame(second, CAND), snaps, slice_rows=slice_rows, start=before.states)
        got = {r.diff_id: r.outcome for r in [*one.collect(), *two.collect()]}
        assert {i: o for i, o in got.items() if i < 9000} == want
        assert {r.monitor_id for r in after.states.collect()} == {"hot", "other"}
