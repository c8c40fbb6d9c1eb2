import pytest
from pyspark.sql import functions as F

from changeflow.operators import reports


@pytest.mark.parametrize("page, per_page, limit, want", [(1, 20, None, (0, 20)), (3, 10, None, (20, 10)), (0, 500, None, (0, 500)), (2, 20, 5, (5, 5)), (1, 0, None, (0, 1))])
def test_page_bounds(page, per_page, limit, want):
    assert reports.page_bounds(page, per_page, limit) == want


@pytest.mark.parametrize("total, pages", [(0, 0), (1, 1), (20, 1), (21, 2), (40, 2)])
def test_page_count(total, pages):
    assert reports.page_count(total) == pages


def test_paging_and_totals(spark):
    df = spark.range(45).selectExpr("id", "id % 7 AS k", "'u' AS user_id")
    got = [r.id for r in reports.paginate(df, ["k desc", "id"], 2, 10).collect()]
    want = [r.id for r in df.orderBy(F.desc("k"), "id").collect()][10:20]
    assert got == want
    assert reports.page_totals(df, ["user_id"]).first()[1:] == (45, 3)
    assert reports.paginate(df, ["id"], 9, 10).count() == 0


def test_lists(spark, at):
    rows = [(1, "u", "high", "m", False, at(0)), (2, "u", "low", "m", True, at(1)), (3, "v", "high", "n", False, at(2))]
    alerts = spark.createDataFrame(rows, "alert_id int, user_id string, severity string, monitor_id string, is_acknowledged boolean, created_at timestamp")
    ids = lambda **kw: {r.alert_id for r in reports.list_alerts(alerts, **kw).collect()}
    assert ids(user_id="u") == {1, 2} and ids(severity="high") == {1, 3} and ids(is_acknowledged=False, user_id="u") == {1}
    assert ids(since=at(1)) == {2, 3} and ids(until=at(1)) == {1, 2} and ids(monitor_id="n") == {3}
    monitors = spark.createDataFrame(
        [("a", "u", "50% off", "https://e.com/x_y", True, None), ("b", "u", "500 off", "https://E.com/xzy", True, None), ("c", "u", "gone", "", True, at(0))],
        "monitor_id string, user_id string, name string, url string, is_active boolean, deleted_at timestamp",
    )
    found = lambda s: {r.monitor_id for r in reports.list_monitors(monitors, search=s).collect()}
    assert found("50%") == {"a"} and found("X_Y") == {"a"} and found("e.COM") == {"a", "b"} and found("gone") == set()
    rows = spark.createDataFrame([(1, "a"), (2, "c"), (3, "zzz")], "diff_id int, monitor_id string")
    assert [r.diff_id for r in reports.owned(rows, monitors, "u").collect()] == [1]
    assert reports.owned_lookup(rows, monitors, "diff_id", 2, "u").count() == 0
    assert reports.owned_lookup(rows, monitors, "diff_id", 1, "u").count() == 1
    assert reports.owned_lookup(rows, monitors, "diff_id", 1, "someone").count() == 0


def test_text_columns_are_never_read(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    spark.range(3).selectExpr("id AS snapshot_id", "id AS monitor_id", "'<html>' AS raw_html", "'text' AS extracted_text").write.parquet(path)
    plan = reports.list_snapshots(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "raw_html" not in plan and "extracted_text" not in plan


def test_histogram(spark):
    log = spark.createDataFrame([("GET", v) for v in (0.005, 0.01, 0.3, 4.0, 99.0)], "method string, seconds double")
    got = {r.le: r.n for r in reports.duration_histogram(log, ["method"]).collect()}
    assert got == {"0.01": 2, "0.05": 2, "0.1": 2, "0.25": 2, "0.5": 3, "1.0": 3, "2.5": 3, "5.0": 4, "+Inf": 5}


def test_rate_limit(spark, at):
    rows = [(i, "c", "/api/v1/alerts", at(0)) for i in range(103)] + [(200 + i, "c", "/api/v1/health/ready", at(0)) for i in range(150)] + [(500, "c", "/api/v1/alerts", at(1 / 60)), (501, "d", "/x", at(0))]
    log = spark.createDataFrame(rows, "request_id int, client string, path string, ts timestamp")
    flags = {r.request_id: r.rejected for r in reports.rate_limit_flags(log).collect()}
    assert {i for i, r in flags.items() if r} == {100, 101, 102} and len(flags) == 105


def test_stats_and_shares(spark):
    monitors = spark.createDataFrame([(True, None), (False, None), (True, 1)], "is_active boolean, deleted_at int")
    alerts = spark.createDataFrame([(True,), (False,)], "is_acknowledged boolean")
    n = lambda i: spark.range(i)
    got = {r.metric: r.value for r in reports.system_stats(n(4), monitors, alerts, n(5), n(6), n(7)).collect()}
    assert got == {"users": 4, "monitors_total": 2, "monitors_active": 1, "alerts_total": 2, "alerts_unacknowledged": 1, "snapshots": 5, "diffs": 6, "analyses": 7}
    diffs = spark.createDataFrame([(True, 4, 4), (False, 6, 1), (True, 0, 0)], "is_empty_after_filter boolean, original_lines int, noise_lines_removed int")
    assert tuple(reports.noise_share_report(diffs).first()) == (3, 2, 10, 5, 50.0)
