"""Retention, deletion and user actions on stored rows."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions import constants as k
from changeflow.functions.text import days, micros

RETENTION_DAYS = {"snapshots": k.SNAPSHOT_DAYS, "diffs": k.DIFF_DAYS, "analyses": k.ANALYSIS_DAYS}


def keep_recent(df: DataFrame, now: Column, keep_days: int, ts: str = "created_at") -> DataFrame:
    """Rows not older than `keep_days`. A table stored in `day` folders is also cut by folder, so old ones are not read."""
    oldest = now - F.expr(f"INTERVAL {keep_days} DAYS")
    if "day" in df.columns:
        df = df.filter(F.col("day") >= F.to_date(oldest))
    return df.filter(F.col(ts) >= oldest)


def retention_counts(tables: dict[str, DataFrame], now: Column, keep: dict[str, int] | None = None) -> DataFrame:
    """(table_name, deleted, kept) for each table given."""
    keep = {**RETENTION_DAYS, **(keep or {})}
    rows = []
    for name, df in tables.items():
        old = F.col("created_at") < now - F.expr(f"INTERVAL {keep[name]} DAYS")
        rows.append(
            df.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept")).select(
                F.lit(name).alias("table_name"), "deleted", "kept"
            )
        )
    return reduce(DataFrame.unionByName, rows)


def apply_retention(tables: dict[str, DataFrame], now: Column, keep: dict[str, int] | None = None) -> dict[str, DataFrame]:
    keep = {**RETENTION_DAYS, **(keep or {})}
    return {name: keep_recent(df, now, keep[name]) for name, df in tables.items()}


def drop_day_folders(spark: SparkSession, path: str, oldest: date, column: str = "day") -> list[str]:
    """Delete the date folders of a stored table that lie before `oldest`; returns their names.

    The folders are those of `write_table(time_col=...)`. Only names are listed, no file is
    read, so the cost follows the number of days.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        day = name.removeprefix(f"{column}=")
        if status.isDirectory() and day != name and day[:1].isdigit() and date.fromisoformat(day) < oldest:
            files.delete(status.getPath(), True)
            dropped.append(name)
    return sorted(dropped)


def expired_monitors(monitors: DataFrame, now: Column, keep_days: int = k.DELETED_MONITOR_DAYS) -> DataFrame:
    age = micros(now) - micros(F.col("deleted_at"))
    return monitors.filter(F.col("deleted_at").isNotNull() & (age > days(keep_days)))


def purge_deleted(
    monitors: DataFrame, children: dict[str, DataFrame], now: Column, keep_days: int = k.DELETED_MONITOR_DAYS
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Monitors and child tables without the monitors that were deleted long enough ago."""
    gone = expired_monitors(monitors, now, keep_days).select("monitor_id")
    kept = {name: df.join(gone, "monitor_id", "left_anti") for name, df in children.items()}
    return monitors.join(gone, "monitor_id", "left_anti"), kept


def purge_counts(
    monitors: DataFrame, children: dict[str, DataFrame], now: Column, keep_days: int = k.DELETED_MONITOR_DAYS
) -> DataFrame:
    """(table_name, deleted). Child rows are counted per monitor first, so the join is small."""
    gone = expired_monitors(monitors, now, keep_days).select("monitor_id")
    rows = [gone.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("monitors").alias("table_name"), "deleted")]
    for name, df in children.items():
        per_monitor = df.groupBy("monitor_id").agg(F.count(F.lit(1)).alias("n"))
        rows.append(
            per_monitor.join(gone, "monitor_id", "left_semi")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("deleted"))
            .select(F.lit(name).alias("table_name"), "deleted")
        )
    return reduce(DataFrame.unionByName, rows)


def fold_deletions(monitors: DataFrame, actions: DataFrame) -> DataFrame:
    """Monitors after their latest action: (monitor_id, action delete|restore, at).

    Deleting switches a monitor off; restoring switches it on and makes it due at once. Of two
    actions at one instant the restoring one counts.
    """
    last = actions.groupBy("monitor_id").agg(F.max_by("action", F.struct("at", "action")).alias("_action"), F.max("at").alias("_at"))
    acted = monitors.join(last, "monitor_id", "left")
    deleted, restored = F.col("_action") == "delete", F.col("_action") == "restore"
    return acted.withColumns(
        {
            "is_active": F.when(deleted, False).when(restored, True).otherwise(F.col("is_active")),
            "deleted_at": F.when(deleted, F.col("_at")).when(restored, None).otherwise(F.col("deleted_at")),
            "next_check_at": F.when(restored, F.col("_at")).otherwise(F.col("next_check_at")),
        }
    ).drop("_action", "_at")


def first_action(rows: DataFrame, actions: DataFrame, id_col: str, flag: str, at: str) -> DataFrame:
    """Set `flag` and `at` from the first action on each row (acknowledge an alert, resolve a cluster)."""
    first = actions.groupBy(id_col).agg(F.min("at").alias("_at"))
    base = rows.drop(at)
    current = F.col(flag) if flag in rows.columns else F.lit(False)
    return (
        base.join(first, id_col, "left")
        .withColumns({flag: current | F.col("_at").isNotNull(), at: F.col("_at")})
        .drop("_at")
    )


def acknowledge(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    return first_action(alerts, actions, "alert_id", "is_acknowledged", "acknowledged_at")


def resolve(clusters: DataFrame, actions: DataFrame) -> DataFrame:
    return first_action(clusters, actions, "cluster_id", "is_resolved", "resolved_at")


def dedupe_signups(signups: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First sign-up per trimmed, lower-cased address; a grouped min, combined before the shuffle."""
    order = order or ["created_at", "email"]
    normal = F.lower(F.regexp_replace("email", r"(?U)^\s+|\s+$", ""))
    rest = F.struct(*signups.columns)
    return (
        signups.withColumn("email_normalized", normal)
        .groupBy("email_normalized")
        .agg(F.min_by(rest, F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("requests"))
        .select("email_normalized", "_row.*", "requests")
    )
