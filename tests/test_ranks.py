"""Places over range partitions against a sort."""

import pytest
from pyspark.sql import functions as F

from changeflow.functions import ranks
from changeflow.operators import ingest, reports


@pytest.mark.parametrize("partitions", [1, 7, 40])
@pytest.mark.parametrize("order", [["k", "id"], ["k desc", "id"], ["id desc"]])
def test_places(spark, partitions, order):
    df = spark.range(1500).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 1 ELSE pmod(hash(id), 50) END AS k")
    got = {r.id: r.place for r in ranks.ranked(df, order, partitions=partitions).collect()}
    want = {r.id: i + 1 for i, r in enumerate(df.orderBy(*ranks.sort_columns(order)).collect())}
    assert got == want
    assert ranks.ranked(df.limit(0), order).count() == 0


def test_page_ten_thousand(spark):
    df = spark.range(30_000).selectExpr("id", "pmod(hash(id), 97) AS k")
    want = [r.id for r in df.orderBy(F.desc("k"), "id").collect()]
    page = reports.paginate(df, ["k desc", "id"], page=10_000, per_page=3)
    assert [r.id for r in page.collect()] == want[29_997:30_000]
    assert [r.id for r in reports.paginate(df, ["k desc", "id"], page=2, per_page=3).collect()] == want[3:6]
    assert reports.paginate(df, ["k desc", "id"], page=10_001, per_page=3).count() == 0


def test_all_due_in_one_hour(spark, at):
    """No task sorts or counts all rows: the only single partition is over one count per partition."""
    df = spark.range(5000).select(F.col("id").alias("monitor_id"), F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("deleted_at"), F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 3000)").alias("next_check_at"))
    due = ingest.due_monitors(df, F.expr("TIMESTAMP '2024-01-02 00:00:00'"))
    rows = due.orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 5001))
    assert [(r.next_check_at, r.monitor_id) for r in rows] == sorted((r.next_check_at, r.monitor_id) for r in rows)
    due.collect()
    plan = due._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    alone = plan[plan.index("SinglePartition") :]
    assert "HashAggregate" in alone and "Window" not in alone
