"""Runs that go on from what earlier ones stored give what one run over everything gives."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from changeflow.functions import scans
from changeflow.operators import change, learning
from changeflow.plans import monitoring
from changeflow.plans.storage import CarryStore
from changeflow.sources import adapters as a
from tests.conftest import SF


def same(left, right):
    left = left.select(*right.columns)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def cut(df, column, *times):
    """The rows between one time and the next."""
    bounds = [None, *times, None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = df
        if lo:
            part = part.filter(F.col(column) >= F.lit(lo).cast(df.schema[column].dataType))
        if hi:
            part = part.filter(F.col(column) < F.lit(hi).cast(df.schema[column].dataType))
        yield part


def tracks():
    return {
        "n": scans.count(), "s": scans.total(F.col("v")), "hi": scans.highest(F.col("v")), "lo": scans.lowest(F.col("v")),
        "seen": scans.latest(F.when(F.col("v") % 3 == 0, F.col("v"))), "one": scans.before(F.col("v")), "five": scans.before(F.col("v"), 5),
    }


def test_every_track_goes_on_from_its_carry(spark):
    rng, start = random.Random(1), datetime(2024, 1, 1)
    rows = [(rng.choice("aab") if i < 300 else rng.choice("abcd"), i, rng.randrange(100), start + timedelta(minutes=37 * i)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, id int, v int, ts timestamp")
    how = (["k"], ["ts", "id"], [scans.by_day("ts")])
    whole = scans.scan(df, *how, **tracks())
    parts, carry = [], None
    for lo, hi in ((0, 111), (111, 112), (112, 600)):
        part = df.filter(f"id >= {lo} AND id < {hi}")
        parts.append(scans.scan(part, *how, carry, **tracks()))
        after = scans.carry_of(part, *how, carry, **tracks())
        carry = spark.createDataFrame(after.collect(), after.schema)
    same(parts[0].union(parts[1]).union(parts[2]), whole)


def test_pairs_go_on(spark):
    snaps = a.snapshots(spark, SF)
    got, carry = None, None
    for part in cut(snaps, "created_at", "2024-01-07 05:00:00", "2024-01-07 06:00:00", "2024-01-20 00:00:00"):
        pairs = change.pair_snapshots(part, carry=carry)
        got = pairs if got is None else got.unionByName(pairs)
        carry = change.pair_carry(part, carry)
    same(got, change.pair_snapshots(snaps))


def test_recent_counts_go_on(spark):
    diffs = a.observations(spark, SF).select("monitor_id", "diff_id", F.col("observed_at").alias("created_at"))
    got, tail = None, None
    for part in cut(diffs, "created_at", "2024-02-10 00:00:00", "2024-05-01 00:00:00"):
        counts = learning.recent_diff_count(part, tail=tail)
        got = counts if got is None else got.unionByName(counts)
        tail = learning.recent_tail(part, tail)
        assert tail.groupBy("monitor_id").agg((F.max("created_at") - F.min("created_at")).alias("d")).filter("d > INTERVAL 60 DAYS").count() == 0
    same(got, learning.recent_diff_count(diffs))


def test_learning_goes_on(spark, tmp_path):
    obs = a.observations(spark, SF)
    store = str(tmp_path / "store")
    for i, part in enumerate(cut(obs, "observed_at", "2024-03-01 00:00:00", "2024-08-01 00:00:00")):
        monitoring.learn_next(store, f"run {i}", part)
    with pytest.raises(ValueError):
        monitoring.learn_next(store, "run 1", obs)
    whole = learning.pattern_state(obs, obs.select("monitor_id", "diff_id", F.col("observed_at").alias("created_at")))
    rounded = lambda df: df.withColumn("avg_similarity", F.round("avg_similarity", 9))
    columns = [c for c in whole.columns if c != "similarity"]
    same(rounded(monitoring.learned_states(spark, store)).select(*columns), rounded(whole).select(*columns))


def test_a_run_that_fails_leaves_the_store_as_it_was(spark, tmp_path):
    obs = a.observations(spark, SF)
    path = str(tmp_path / "store")
    early, late = cut(obs, "observed_at", "2024-06-01 00:00:00")
    monitoring.learn_next(path, "one", early)
    before = {n: t.count() for n, t in CarryStore(spark, path).tables().items()}
    broken = late.withColumn("similarity", F.when(F.col("diff_id") % 7 == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("similarity")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        monitoring.learn_next(path, "two", broken)
    store = CarryStore(spark, path)
    assert store.known == {"one"} and {n: t.count() for n, t in store.tables().items()} == before
    monitoring.learn_next(path, "two", late)
    assert monitoring.learned_states(spark, path).count() == obs.count()


def make_model():
    def model(batch: pd.DataFrame) -> pd.DataFrame:
        levels = ["critical", "high", "medium", "low"]
        size = batch["prompt"].str.len()
        body = [f'{{"significance_level":"{levels[n % 4]}","summary":"{"abc"[n % 3]} changed pricing","categories":["pricing_change"]}}' for n in size]
        return pd.DataFrame({"diff_id": batch["diff_id"], "body": body, "is_structured": True, "prompt_tokens": 10, "completion_tokens": 5, "error": None})

    return model


def pages(days=15, monitors=4):
    """Daily snapshots: a counter that is learned as noise, prices and lines that come and go, hours without change."""
    rng, start, rows = random.Random(3), datetime(2024, 1, 1), []
    for m in range(monitors):
        extra = ""
        for day in range(days):
            step = max(0, day - 8)  # nothing changes until there is enough history to learn from
            if step and rng.random() < 0.4:
                extra = f"\nOffer number {rng.randrange(1000)} now for ${rng.randrange(90, 130)}"
            text = f"Welcome to page {m}\nPro costs ${90 + step // (3 + m)} per month\nLast visited by reader number r{step}x\nFooter{extra}"
            for part in range(1 + m % 2):
                rows.append((f"m{m}-{day:02d}-{part}", f"m{m}", text if part == 0 else text + "\nmore", start + timedelta(days=day, hours=m + 7 * part)))
    return rows


MONITORS = [(f"m{i}", f"u{i % 2}", "Acme" if i % 2 else "Globex", "pricing", f"https://x{i}.example", [r"Offer\s+number \d+"] if i == 3 else []) for i in range(4)]
MONITOR_SCHEMA = "monitor_id string, user_id string, competitor_name string, page_type string, url string, noise_patterns array<string>"
SNAPSHOTS = "snapshot_id string, monitor_id string, extracted_text string, created_at timestamp"


def compare_tables(spark, whole, parts, replaced):
    for name, want in whole.items():
        got = None
        for part in parts:
            got = part[name] if got is None else got.unionByName(part[name])
        if name in replaced:
            continue
        columns = [c for c, kind in want.dtypes if not kind.startswith("map")]
        rounded = [F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in want.dtypes if c in columns]
        same(got.select(*rounded), want.select(*rounded))


def check_against_one_run(spark, store, parts, snapshots, monitors):
    whole = monitoring.watch(snapshots, monitors, make_model())
    assert whole["patterns"].filter("is_active").count() > 0 and whole["filter_events"].count() > 0
    assert whole["decisions"].filter("outcome <> 'created'").count() > 0 and whole["clusters"].filter("alert_count > 2").count() > 0
    compare_tables(spark, whole, parts, {"patterns", "clusters"})
    states = monitoring.learned_states(spark, store).drop("similarity")
    rounded = lambda df: df.withColumn("avg_similarity", F.round("avg_similarity", 9))
    same(rounded(states), rounded(whole["patterns"].drop("similarity")))
    latest = {}
    for part in parts:
        for row in part["clusters"].collect():
            latest[row.cluster_id] = row
    assert sorted(latest.values(), key=lambda r: r.cluster_id) == sorted(whole["clusters"].collect(), key=lambda r: r.cluster_id)


def test_the_chain_goes_on(spark, tmp_path):
    """A cut within a day. The second run reads its own batch and the store: the first batch is gone by then."""
    rows, monitors = pages(), spark.createDataFrame(MONITORS, MONITOR_SCHEMA)
    middle = datetime(2024, 1, 13, 2, 30)
    for name, part in (("early", [r for r in rows if r[3] < middle]), ("late", [r for r in rows if r[3] >= middle])):
        spark.createDataFrame(part, SNAPSHOTS).write.parquet(str(tmp_path / name))
    store = str(tmp_path / "store")
    parts = [monitoring.watch_next(store, "one", spark.read.parquet(str(tmp_path / "early")), monitors, make_model())]
    (tmp_path / "early").rename(tmp_path / "gone")
    parts.append(monitoring.watch_next(store, "two", spark.read.parquet(str(tmp_path / "late")), monitors, make_model()))
    assert CarryStore(spark, store).tables()["texts"].count() == len(MONITORS)
    check_against_one_run(spark, store, parts, spark.createDataFrame(rows, SNAPSHOTS), monitors)
