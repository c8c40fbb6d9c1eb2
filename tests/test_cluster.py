import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from changeflow.operators import cluster

ALERTS = "alert_id int, user_id string, competitor_name string, severity string, summary string, categories array<string>, created_at timestamp"


@pytest.mark.parametrize("hours, score", [(0, 1), (4, 0.5), (8, 0.25), (12, 0.125), (24, 1 / 64)])
def test_half_life(spark, at, hours, score):
    for a, b in ((0, hours), (hours, 0)):
        got = spark.range(1).select(cluster.temporal_similarity(F.lit(at(a)), F.lit(at(b))).alias("s")).first().s
        assert math.isclose(got, score, rel_tol=1e-12)


def test_keywords_and_jaccard(spark):
    words = lambda t: spark.range(1).select(cluster.extract_keywords(F.lit(t)).alias("w")).first().w
    assert words("The new Pricing page was CHANGED: pricing up, café API-v2 go") == ["api", "caf", "pricing"]
    j = lambda a, b: spark.range(1).select(cluster.jaccard(F.split(F.lit(a), " "), F.split(F.lit(b), " ")).alias("s")).first().s
    assert j("a b", "b c") == 1 / 3 and j("a", "a") == 1.0 and j("a", "b") == 0.0
    none = spark.range(1).select(cluster.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("s")).first().s
    assert none == 0.0


def brute(rows):
    """Every alert against every cluster of its key, in time order."""
    made, out = [], {}
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        key = (r[1], (r[2] or "").strip())
        if not key[1]:
            out[r[0]] = None
            continue
        words = {w for w in "".join(c if c.isascii() and c.isalpha() else " " for c in r[4].lower()).split() if len(w) > 2}
        cats, best, top = set(r[5]), None, 0.0
        for c in made:
            if c["key"] != key or c["at"] < r[6] - timedelta(hours=48):
                continue
            over = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
            hours = (r[6] - c["at"]).total_seconds() / 3600
            score = 0.4 * 2 ** (-hours / 4) + 0.3 * over(cats, c["cats"]) + 0.3 * over(words, c["words"])
            if score > top:
                best, top = c, score
        if best and top >= 0.45:
            best["cats"] |= cats
            best["words"] |= words
            best["at"] = r[6]
            out[r[0]] = best["id"]
        else:
            made.append({"id": r[0], "key": key, "at": r[6], "cats": cats, "words": words})
            out[r[0]] = r[0]
    return out


def test_assignment_equals_brute_force_for_a_hot_key(spark):
    rng = random.Random(9)
    start, rows = datetime(2024, 1, 1), []
    vocabulary = ["pricing", "launch", "dashboard", "hiring", "partner", "billing"]
    for i in range(1500):
        user, name = ("u", "Acme") if i % 2 else (f"u{rng.randrange(5)}", rng.choice(["Beacon", " Acme ", "", None]))
        summary = " ".join(rng.sample(vocabulary, rng.randrange(1, 4)))
        cats = rng.sample(["a", "b", "c", "d"], rng.randrange(0, 3))
        rows.append((i, user, name, rng.choice(["medium", "high"]), summary, cats, start + timedelta(minutes=rng.randrange(60 * 24 * 60))))
    want = brute(rows)
    for partitions in (1, 9):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), ALERTS).repartition(partitions)
        got = cluster.assign_clusters(df, partitions)
        assert {r.alert_id: r.cluster_id for r in got.collect()} == want
        assert got.filter("merge_score IS NOT NULL AND merge_score < 0.45").count() == 0
    rolled = cluster.cluster_rollup(got)
    assert rolled.agg(F.sum("alert_count")).first()[0] == sum(v is not None for v in want.values())


def test_window_bound_and_merge(spark, at):
    same = ("medium", "Pricing launch", ["pricing_change"])
    rows = [(1, "u", "Acme", *same, at(0)), (2, "u", "Acme", *same, at(48)), (3, "u", "Acme", *same, at(96.001)), (4, "v", "Acme", *same, at(48)), (5, "u", " ", *same, at(0))]
    got = {r.alert_id: r.cluster_id for r in cluster.assign_clusters(spark.createDataFrame(rows, ALERTS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: None}


def test_rollup_and_title(spark, at):
    rows = [
        (1, "u", "Acme", "medium", "Pricing moved", ["pricing_change", "other"], at(0), 1), (2, "u", "Acme", "critical", "Hiring spree", ["hiring_signal"], at(1), 1),
        (3, "u", "Acme", "low", "one two  three four five six seven", [], at(2), 3),
    ]
    got = {r.cluster_id: r for r in cluster.cluster_rollup(spark.createDataFrame(rows, ALERTS + ", cluster_id int")).collect()}
    assert (got[1].title, got[1].severity, got[1].alert_count) == ("Acme — Pricing Change", "critical", 2)
    assert got[1].categories == ["hiring_signal", "other", "pricing_change"] and got[1].keywords == ["hiring", "moved", "pricing", "spree"]
    assert (got[1].created_at, got[1].updated_at) == (at(0), at(1))
    assert got[3].title == "Acme — one two three four five six" and got[3].categories == []


def test_score_given_clusters(spark, at):
    alerts = spark.createDataFrame([(1, "u", "Acme", "medium", "pricing", ["a"], at(4)), (2, "u", "Acme", "medium", "pricing", ["a"], at(60))], ALERTS)
    schema = "cluster_id int, user_id string, competitor_name string, categories array<string>, keywords array<string>, is_resolved boolean, created_at timestamp, updated_at timestamp"
    clusters = spark.createDataFrame(
        [
            (10, "u", "Acme", ["a"], ["pricing"], False, at(0), at(0)), (11, "u", "Acme", ["a"], ["pricing"], False, at(-9), at(0)),
            (12, "u", "Acme", ["a"], ["pricing"], True, at(-99), at(4)), (13, "u", "Other", ["a"], ["pricing"], False, at(-99), at(4)),
            (14, "u", "Acme", [], [], False, at(-99), at(12)),
        ], schema,
    )
    got = {r.alert_id: (r.cluster_id, round(r.score, 6), r.merges) for r in cluster.score_open_clusters(alerts, clusters).collect()}
    assert got[1] == (11, 0.8, True)  # a tie: the older one
    assert got[2] == (14, round(0.4 * 2**-12, 6), False)


def test_a_key_that_is_never_silent_is_spread_over_slices(spark):
    """Slices replayed side by side until they agree give the serial replay, and it can be gone on with."""
    rng = random.Random(11)
    start, t, rows = datetime(2024, 1, 1), 0, []
    words = ["pricing", "launch", "hiring", "partner", "outage", "design", "mobile", "cloud"]
    for i in range(900):
        t += rng.randrange(1, 300)
        rows.append((2**60 + i, "u", "acme", "high", " ".join(rng.sample(words, 3)), rng.sample(["p", "q", "r"], rng.randrange(0, 3)), start + timedelta(minutes=t)))
    schema = ALERTS.replace("alert_id int", "alert_id bigint")
    serial = {r.alert_id: (r.cluster_id, r.merge_score) for r in cluster.assign_clusters(spark.createDataFrame(rows, schema), slice_rows=10_000).collect()}
    assert len({c for c, _ in serial.values()}) > 10
    mixed = spark.createDataFrame(rng.sample(rows, len(rows)), schema)
    for slice_rows in (60, 300):
        placed, replayed = cluster.place_alerts(mixed, slice_rows=slice_rows)
        assert {r.alert_id: (r.cluster_id, r.merge_score) for r in placed.collect()} == serial
        assert 1 < replayed.rounds <= 900 // slice_rows + 1
    one, before = cluster.place_alerts(spark.createDataFrame(rows[:400], schema))
    two, _ = cluster.place_alerts(spark.createDataFrame(rows[400:], schema), start=before.states)
    assert {r.alert_id: (r.cluster_id, r.merge_score) for r in [*one.collect(), *two.collect()]} == serial
