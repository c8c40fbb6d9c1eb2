import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from changeflow.functions import scans


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows belong to one key; some instants repeat, some values are null."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        ts = start + timedelta(minutes=rng.randrange(60 * 24 * 20))
        data.append((key, i, ts, rng.randrange(100) if rng.random() < 0.8 else None))
    return spark.createDataFrame(data, "k string, id bigint, ts timestamp, v int").cache()


ORDER = ["ts", "id"]


def same(left, right):
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, left.collect())) == sorted(map(key, right.collect()))


@pytest.mark.parametrize("partitions", [1, 17])
def test_tracks_equal_plain_windows(rows, partitions):
    got = scans.scan(
        rows.repartition(partitions), ["k"], ORDER, [scans.by_day("ts")],
        n=scans.count(), filled=scans.count(F.col("v")), total=scans.total(F.col("v")), top=scans.highest(F.col("v")),
        low=scans.lowest(F.col("v")), last=scans.latest(F.col("v")), prev=scans.before(F.col("id")),
        prev5=scans.before(F.col("id"), 5), after=scans.following(F.col("id")),
    )
    w = Window.partitionBy("k").orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*", F.count(F.lit(1)).over(upto).alias("n"), F.count("v").over(upto).alias("filled"),
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"), F.max("v").over(upto).alias("top"), F.min("v").over(upto).alias("low"),
        F.last("v", ignorenulls=True).over(upto).alias("last"), F.collect_list("id").over(w.rowsBetween(-1, -1)).alias("prev"),
        F.collect_list("id").over(w.rowsBetween(-5, -1)).alias("prev5"), F.lead("id").over(w).alias("after"),
    )
    same(got, want)


def test_global_rank(rows):
    got = scans.scan(rows, [], ORDER, [scans.by_hour("ts")], n=scans.count()).select("id", "n")
    want = rows.select("id", F.row_number().over(Window.orderBy(*ORDER)).alias("n"))
    same(got, want)


def test_count_back_is_inclusive(rows):
    span = 3 * 86_400_000_000
    got = scans.count_back(rows, ["k"], "ts", "id", span, scans.by_day, "n").select("id", "n")
    mine = {(r.k, r.id): r.ts for r in rows.collect()}
    want = {
        i: sum(1 for (k2, j), u in mine.items() if k2 == k and t - timedelta(days=3) <= u and (u, j) <= (t, i))
        for (k, i), t in mine.items()
    }
    assert {r.id: r.n for r in got.collect()} == want


def test_newest(rows):
    got = scans.newest(rows, ["k"], ORDER, [scans.by_day("ts")], 3).select("k", "id", "recency")
    w = Window.partitionBy("k").orderBy(F.desc("ts"), F.desc("id"))
    want = rows.withColumn("recency", F.row_number().over(w)).filter("recency <= 3").select("k", "id", "recency")
    same(got, want)


def test_one_exchange_feeds_both_readers(rows, spark):
    table = spark.range(2000).selectExpr("id % 7 AS k", "id", "timestamp_seconds(id * 1000) AS ts")
    df = scans.scan(table, ["k"], ORDER, [scans.by_day("ts")], n=scans.count()).select("id", "n")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Range (") == 1
