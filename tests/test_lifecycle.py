from pyspark.sql import functions as F

from changeflow.operators import lifecycle
from changeflow.sources.tables import append_once, read_table, upsert_state, write_table


def test_retention_is_by_age_alone(spark, at):
    now = F.lit(at(24 * 400))
    rows = spark.createDataFrame([(d, at(24 * (400 - d))) for d in (1, 90, 91, 180, 181, 365, 366)], "age int, created_at timestamp")
    tables = {"snapshots": rows, "diffs": rows, "analyses": rows}
    kept = {n: {r.age for r in df.collect()} for n, df in lifecycle.apply_retention(tables, now).items()}
    assert kept == {"snapshots": {1, 90}, "diffs": {1, 90, 91, 180}, "analyses": {1, 90, 91, 180, 181, 365}}
    counts = {r.table_name: (r.deleted, r.kept) for r in lifecycle.retention_counts(tables, now, {"diffs": 90}).collect()}
    assert counts == {"snapshots": (5, 2), "diffs": (5, 2), "analyses": (1, 6)}


def test_purge(spark, at):
    now = F.lit(at(24 * 100))
    monitors = spark.createDataFrame([("old", at(24 * 69)), ("edge", at(24 * 70)), ("live", None)], "monitor_id string, deleted_at timestamp")
    child = spark.createDataFrame([("old",), ("old",), ("edge",), ("live",)], "monitor_id string")
    kept, children = lifecycle.purge_deleted(monitors, {"snapshots": child}, now)
    assert {r.monitor_id for r in kept.collect()} == {"edge", "live"} and children["snapshots"].count() == 2
    counts = {r.table_name: r.deleted for r in lifecycle.purge_counts(monitors, {"snapshots": child}, now).collect()}
    assert counts == {"monitors": 1, "snapshots": 2}


def test_delete_and_restore(spark, at):
    monitors = spark.createDataFrame([(i, True, None, at(9)) for i in "abc"], "monitor_id string, is_active boolean, deleted_at timestamp, next_check_at timestamp")
    actions = spark.createDataFrame([("a", "delete", at(1)), ("b", "delete", at(1)), ("b", "restore", at(2))], "monitor_id string, action string, at timestamp")
    got = {r.monitor_id: (r.is_active, r.deleted_at, r.next_check_at) for r in lifecycle.fold_deletions(monitors, actions).collect()}
    assert got == {"a": (False, at(1), at(9)), "b": (True, None, at(2)), "c": (True, None, at(9))}


def test_actions_and_signups(spark, at):
    alerts = spark.createDataFrame([(1, False), (2, True), (3, False)], "alert_id int, is_acknowledged boolean")
    actions = spark.createDataFrame([(1, at(2)), (1, at(1))], "alert_id int, at timestamp")
    got = {r.alert_id: (r.is_acknowledged, r.acknowledged_at) for r in lifecycle.acknowledge(alerts, actions).collect()}
    assert got == {1: (True, at(1)), 2: (True, None), 3: (False, None)}
    clusters = spark.createDataFrame([(1, False)], "cluster_id int, is_resolved boolean")
    assert lifecycle.resolve(clusters, actions.withColumnRenamed("alert_id", "cluster_id")).first().is_resolved
    signups = spark.createDataFrame([(" A@x.com", at(2)), ("a@X.com ", at(1)), ("b@x.com", at(0))], "email string, created_at timestamp")
    got = {r.email_normalized: (r.email, r.requests) for r in lifecycle.dedupe_signups(signups).collect()}
    assert got == {"a@x.com": ("a@X.com ", 2), "b@x.com": ("b@x.com", 1)}


def test_tables(spark, at, tmp_path):
    rows = spark.createDataFrame([("m", "c", "p", True, at(0)), ("n", "c", "p", True, at(30))], "monitor_id string, error string, render_method string, ok boolean, attempted_at timestamp")
    path = str(tmp_path / "attempts")
    write_table(rows, path, "attempted_at")
    back = read_table(spark, "attempts", path)
    assert back.columns == ["monitor_id", "attempted_at", "ok", "error", "render_method", "day"] and back.count() == 2
    recent = lifecycle.keep_recent(back, F.lit(at(30)), 1, "attempted_at")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert recent.count() == 1 and "PartitionFilters: [isnotnull(day" in plan
    stored = spark.createDataFrame([(1, "old")], "k int, v string")
    incoming = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    assert [tuple(r) for r in append_once(stored, incoming, ["k"]).collect()] == [(2, "a")]
    current = spark.createDataFrame([(1, "x", 5), (2, "y", 1)], "k int, v string, ver int")
    changes = spark.createDataFrame([(1, "late", 4), (2, "z", 2), (3, "w", 0)], "k int, v string, ver int")
    assert {tuple(r) for r in upsert_state(current, changes, ["k"], ["ver"]).collect()} == {(1, "x", 5), (2, "z", 2), (3, "w", 0)}


def test_old_day_folders_go(spark, tmp_path):
    from datetime import date

    from changeflow.sources.tables import write_table

    rows = spark.sql("SELECT id, timestamp_seconds(1704067200 + id * 43200) AS created_at FROM range(10)")
    write_table(rows, str(tmp_path / "t"), "created_at")
    assert lifecycle.drop_day_folders(spark, str(tmp_path / "t"), date(2024, 1, 3)) == ["day=2024-01-01", "day=2024-01-02"]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(4, 10))


def test_actions_at_one_instant(spark, at):
    monitors = spark.createDataFrame([("m", True, None, at(0))], "monitor_id string, is_active boolean, deleted_at timestamp, next_check_at timestamp")
    both = spark.createDataFrame([("m", "restore", at(1)), ("m", "delete", at(1))], "monitor_id string, action string, at timestamp")
    for actions in (both, both.orderBy("action")):
        assert lifecycle.fold_deletions(monitors, actions).first().is_active
