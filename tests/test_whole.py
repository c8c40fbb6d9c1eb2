"""The whole chain, the registry, and the comparison with SQL on a small scale factor."""

import time
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
import check
from changeflow.plans import monitoring
from changeflow.plans.oracles import ORACLES
from changeflow.plans.queries import QUERIES
from tests.conftest import SF


def make_model():
    def model(batch: pd.DataFrame) -> pd.DataFrame:
        price, text = ("critical", "price", "pricing_change"), ("medium", "text", "messaging_change")
        kinds = [price if "$129" in p else text for p in batch["prompt"]]
        body = ['{"significance_level":"%s","summary":"%s changed","categories":["%s"]}' % kind for kind in kinds]
        return pd.DataFrame({"diff_id": batch["diff_id"], "body": body, "is_structured": True, "prompt_tokens": 10, "completion_tokens": 5, "error": None})

    return model


def test_chain(spark):
    """Fifteen daily snapshots: a counter that becomes learned noise, then a price change."""
    start, rows = datetime(2024, 1, 1), []
    for day in range(15):
        price = "$129" if day >= 13 else "$99"
        text = f"Welcome to the product page\nPro costs {price} per month\nLast visited by reader number r{day}x\n© {2000 + day} Acme"
        rows.append((f"s{day:02d}", "m", text, start + timedelta(days=day)))
    snapshots = spark.createDataFrame(rows, "snapshot_id string, monitor_id string, extracted_text string, created_at timestamp")
    monitors = spark.createDataFrame(
        [("m", "u", "Acme", "pricing", "https://acme.example", [])],
        "monitor_id string, user_id string, competitor_name string, page_type string, url string, noise_patterns array<string>",
    )
    settings = spark.createDataFrame(
        [("u", "email", True, "high", None, "u@e", False, None)],
        "user_id string, channel string, is_enabled boolean, min_severity string, webhook_url string, email_address string, digest_mode boolean, digest_hour_utc int",
    )
    out = monitoring.watch(snapshots, monitors, make_model(), settings)
    patterns = out["patterns"].orderBy("observed_at").collect()
    # Learning starts with the tenth snapshot; the third sighting promotes when it is frequent enough.
    assert {p.pattern for p in patterns if "visited" in p.pattern} == {r"^Last\s+visited\s+by\s+reader\s+number\s+.+?$"}
    assert min(p.observed_at for p in patterns) == start + timedelta(days=9)
    diffs = {r.diff_id: r for r in out["diffs"].collect()}
    assert len(diffs) == 14 and diffs["s13"].filtered_diff.count("$") == 2
    assert all(r.noise_lines_removed >= 1 for r in diffs.values())
    decisions = {r.diff_id: r.outcome for r in out["decisions"].collect()}
    assert decisions["s01"] == "created" and decisions["s02"] == "same_summary" and decisions["s13"] == "created"
    alerts = {r.alert_id: r for r in out["alerts"].collect()}
    assert alerts["s13"].severity == "critical"
    assert {r.alert_id for r in out["routes"].collect()} == {"s13"}
    status = {r.snapshot_id: r.status for r in out["snapshots"].collect()}
    assert status["s00"] == "baseline" and status["s13"] == "classified"
    assert out["clusters"].agg({"alert_count": "sum"}).first()[0] == len(alerts)


def stored_tables(spark, monkeypatch, snapshots, monitors):
    """What `watch` writes on its way, by name, and its results."""
    from changeflow.plans import storage

    kept = {}

    def noted(df, name):
        kept[name] = df._jdf.queryExecution().executedPlan().toString()
        return storage.cut_lineage(df, name)

    monkeypatch.setattr(monitoring, "cut_lineage", noted)
    return monitoring.watch(snapshots, monitors, make_model()), kept


MONITOR = "monitor_id int, user_id string, competitor_name string, page_type string, url string, noise_patterns array<string>"


def test_chain_moves_neither_lines_nor_diffs(spark, monkeypatch):
    """A row per line was moved twice with its text, every diff to its monitor's context, and the hunks were stored."""
    rows = [(m * 100 + d, m, f"page {m}\nPro costs ${90 + d // 3} a month\nLast visited by reader number r{d}x\nend", datetime(2024, 1, 1) + timedelta(days=d)) for m in range(5) for d in range(13)]
    snapshots = spark.createDataFrame(rows, "snapshot_id int, monitor_id int, extracted_text string, created_at timestamp")
    monitors = spark.createDataFrame([(m, "u", "Acme", "pricing", "https://acme.example", [r"page \d+"]) for m in range(4)], MONITOR)
    out, kept = stored_tables(spark, monkeypatch, snapshots, monitors)
    assert "MapInArrow" not in kept["responses"] and "Exchange" not in kept["responses"]
    above, *below = kept["diffs"].split("MapInArrow")
    assert "Exchange" not in above and len(below) == 2 and "diff_hunks" not in kept
    assert out["diffs"].count() == 60 and out["diffs"].filter("filtered_diff LIKE '%reader number r12x%'").count() == 5
    # A monitor that is not listed is not asked about; its diffs are there all the same.
    errors = {r.monitor_id: r.error for r in out["analyses"].filter("error IS NOT NULL").collect()}
    assert errors == {4: "monitor_not_found"} and "contexts" not in out["diffs"].columns


def test_rows_of_one_diff_are_one_diff(spark):
    """Two monitors whose snapshots have the same ids: their lines count as lines of one diff, as they did."""
    rows = [(d, m, f"a\nline {d} of the page\nend", datetime(2024, 1, 1) + timedelta(days=d)) for d in range(3) for m in (1, 2)]
    rows += [(10 + r[0], 3, *r[2:]) for r in rows if r[1] == 1]
    snapshots = spark.createDataFrame(rows, "snapshot_id int, monitor_id int, extracted_text string, created_at timestamp")
    monitors = spark.createDataFrame([(m, "u", "Acme", "pricing", "https://acme.example", []) for m in (1, 2, 3)], MONITOR)
    diffs = monitoring.watch(snapshots, monitors, make_model())["diffs"].collect()
    assert {r.diff_id: r.original_lines for r in diffs} == {1: 4, 2: 4, 11: 2, 12: 2} and len(diffs) == 4


def test_stored_tables_leave_no_shuffle_behind(spark, tmp_path):
    """Shuffle files of every stored step lay on the disk until the driver collected its garbage."""
    from changeflow.plans.storage import cut_lineage

    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    blocks = lambda: sum(b.isShuffle() for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.diskBlockManager().getAllBlocks()))
    before = blocks()
    kept = cut_lineage(spark.range(1000).repartition(3, "id"), "moved")
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before and kept.count() == 1000


def test_registry():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    assert set(QUERIES) <= set(queries) and set(ORACLES) <= set(oracles)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 200 and df.columns[0] == "monitor_id"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


SLOW = {"stream_pairs", "stream_diffs", "stream_patterns", "stream_suppress", "stream_clusters", "stream_rate_limit", "stream_dedupe", "stream_digest"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    cursor = con.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cursor.fetchall())


def test_runs_from_any_folder(tmp_path):
    """Python workers find the library wherever the driver was started."""
    import os
    import subprocess
    import sys

    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {entry_point.__file__!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in ("extract_page_text", "strip_noise", "valid_patterns", "candidate_patterns", "classify_with", "suppress_alerts", "assign_clusters", "stream_pairs"):
    assert entry.queries()[name](spark, {SF!r}).collect(), name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "all ran" in done.stdout, done.stderr[-2000:]
