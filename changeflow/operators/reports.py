"""Reads and reports: listings, pages, statistics, histograms, rate limits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions import constants as k
from changeflow.functions import ranks
from changeflow.functions import scans
from changeflow.functions.text import like_literal


def _where(df: DataFrame, tests: list[tuple[object, Column]]) -> DataFrame:
    """Apply the tests whose argument was given."""
    for given, test in tests:
        if given is not None:
            df = df.filter(test)
    return df


def newest_first(df: DataFrame, id_col: str, at: str = "created_at") -> DataFrame:
    """The order of all listings: newest first, of equal times the least id."""
    return df.orderBy(F.desc(at), id_col)


def list_alerts(
    alerts: DataFrame, user_id=None, severity=None, monitor_id=None, is_acknowledged=None, since=None, until=None
) -> DataFrame:
    listed = _where(
        alerts,
        [
            (user_id, F.col("user_id") == user_id),
            (severity, F.col("severity") == severity),
            (monitor_id, F.col("monitor_id") == monitor_id),
            (is_acknowledged, F.col("is_acknowledged") == is_acknowledged),
            (since, F.col("created_at") >= since),
            (until, F.col("created_at") <= until),
        ],
    )
    return newest_first(listed, "alert_id") if "created_at" in listed.columns else listed


def list_clusters(clusters: DataFrame, user_id=None, is_resolved=None, competitor_name=None) -> DataFrame:
    listed = _where(
        clusters,
        [
            (user_id, F.col("user_id") == user_id),
            (is_resolved, F.col("is_resolved") == is_resolved),
            (competitor_name, F.col("competitor_name") == competitor_name),
        ],
    )
    return newest_first(listed, "cluster_id") if "created_at" in listed.columns else listed


def cluster_members(clusters: DataFrame, alerts: DataFrame) -> DataFrame:
    """Members of the listed clusters, one row each: a cluster of any size stays distributed."""
    head = clusters.select("cluster_id", "title", "alert_count", F.col("severity").alias("cluster_severity"))
    return alerts.join(head, "cluster_id")


def list_monitors(monitors: DataFrame, user_id=None, is_active=None, page_type=None, search: str | None = None) -> DataFrame:
    wanted = f"%{like_literal(search)}%" if search else None
    listed = _where(
        monitors.filter(F.col("deleted_at").isNull()),
        [
            (user_id, F.col("user_id") == user_id),
            (is_active, F.col("is_active") == is_active),
            (page_type, F.col("page_type") == page_type),
            (wanted, F.col("name").ilike(wanted or "") | F.col("url").ilike(wanted or "")),
        ],
    )
    return newest_first(listed, "monitor_id") if "created_at" in listed.columns else listed


DIFF_TEXTS = ("unified_diff", "filtered_diff", "learned_hits")
SNAPSHOT_TEXTS = ("raw_html", "extracted_text")


def list_diffs(diffs: DataFrame, monitor_id=None, has_changes: bool | None = None) -> DataFrame:
    """Without the text columns, which a columnar scan then never reads."""
    narrow = diffs.drop(*DIFF_TEXTS)
    listed = _where(
        narrow,
        [(monitor_id, F.col("monitor_id") == monitor_id), (has_changes, F.col("is_empty_after_filter") != F.lit(has_changes))],
    )
    return newest_first(listed, "diff_id") if "created_at" in listed.columns else listed


def list_snapshots(snapshots: DataFrame, monitor_id=None) -> DataFrame:
    listed = _where(snapshots.drop(*SNAPSHOT_TEXTS), [(monitor_id, F.col("monitor_id") == monitor_id)])
    return newest_first(listed, "snapshot_id") if "created_at" in listed.columns else listed


def page_bounds(page: int = 1, per_page: int = 20, limit: int | None = None) -> tuple[int, int]:
    """(offset, rows) of a page; both count from 1, and smaller numbers are taken as 1."""
    rows = max(1, per_page if limit is None else limit)
    return (max(1, page) - 1) * rows, rows


#: Up to here a page is cut from the first rows, which every task finds among its own.
NEAR_ROWS = 10_000


def paginate(df: DataFrame, order: list[str], page: int = 1, per_page: int = 20, limit: int | None = None, near_rows: int = NEAR_ROWS) -> DataFrame:
    """One page of `df`. `order` entries are "column" or "column desc" and must end in a unique column.

    A page near the top needs the first rows only. One further down is found by its places in
    the range-partitioned order, so that no task gathers all rows before it.
    """
    offset, rows = page_bounds(page, per_page, limit)
    by = ranks.sort_columns(order)
    if offset + rows <= near_rows:
        return df.orderBy(*by).offset(offset).limit(rows)
    placed = ranks.ranked(df, order, "_place")
    return placed.filter((F.col("_place") > offset) & (F.col("_place") <= offset + rows)).orderBy("_place").drop("_place")


def page_totals(df: DataFrame, by: list[str] | None = None, per_page: int = 20) -> DataFrame:
    """Rows and pages of a listing, optionally of each user's listing."""
    total = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", F.ceil(F.col("total") / per_page))


def page_count(total: int, per_page: int = 20) -> int:
    return math.ceil(total / per_page) if per_page else 0


def owned(rows: DataFrame, monitors: DataFrame, user_id=None) -> DataFrame:
    """Rows whose monitor is live (and belongs to `user_id`, when given)."""
    live = monitors.filter(F.col("deleted_at").isNull())
    if user_id is not None:
        live = live.filter(F.col("user_id") == user_id)
    return rows.join(live.select("monitor_id"), "monitor_id", "left_semi")


def owned_lookup(rows: DataFrame, monitors: DataFrame, id_col: str, row_id, user_id) -> DataFrame:
    """One row by id, only through a live monitor of the caller."""
    return owned(rows.filter(F.col(id_col) == row_id), monitors, user_id)


def system_stats(users: DataFrame, monitors: DataFrame, alerts: DataFrame, snapshots: DataFrame, diffs: DataFrame, analyses: DataFrame) -> DataFrame:
    """(metric, value) rows: one combined count per table, nothing crossed."""
    live = F.col("deleted_at").isNull()

    def counts(df: DataFrame, **metrics: Column) -> DataFrame:
        row = df.agg(*[m.alias(n) for n, m in metrics.items()])
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("p")
        return row.select(pairs).select("p.*")

    every = F.count(F.lit(1))
    tables = [
        counts(users, users=every),
        counts(monitors, monitors_total=F.count_if(live), monitors_active=F.count_if(live & F.col("is_active"))),
        counts(alerts, alerts_total=every, alerts_unacknowledged=F.count_if(~F.col("is_acknowledged"))),
        counts(snapshots, snapshots=every),
        counts(diffs, diffs=every),
        counts(analyses, analyses=every),
    ]
    return reduce(DataFrame.unionByName, tables)


def duration_histogram(log: DataFrame, labels: list[str], value: str = "seconds", bounds: list[float] | None = None) -> DataFrame:
    """Cumulative bucket counts with sum and count, one row per label set and bound (+Inf last)."""
    bounds = k.API_BUCKETS if bounds is None else bounds
    counted = log.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("count"),
        F.sum(value).alias("sum"),
    )
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return counted.select(*labels, "count", "sum", F.explode(F.array(*cells)).alias("_c")).select(
        *labels, "_c.le", "_c.n", "count", "sum"
    )


def labelled_counter(df: DataFrame, metric: str, labels: dict[str, Column], amount: Column | None = None) -> DataFrame:
    """(metric, labels, value): one counter family in long form."""
    text = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in labels.items()])
    value = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return df.groupBy(text.alias("labels")).agg(value.cast("double").alias("value")).select(
        F.lit(metric).alias("metric"), "labels", "value"
    )


def labelled_counters(attempts: DataFrame, analyses: DataFrame, alerts: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Every counter of the metrics page in one long table."""
    tokens = analyses.select(
        F.explode(
            F.array(
                F.struct(F.lit("prompt").alias("type"), F.col("prompt_tokens").alias("n")),
                F.struct(F.lit("completion").alias("type"), F.col("completion_tokens").alias("n")),
            )
        ).alias("t")
    ).select("t.*")
    families = [
        labelled_counter(attempts.filter("ok"), "scrape_success_total", {"render_method": F.col("render_method")}),
        labelled_counter(
            attempts.filter("NOT ok"),
            "scrape_failure_total",
            {"render_method": F.col("render_method"), "error_type": F.substring_index("error", ":", 1)},
        ),
        labelled_counter(tokens, "model_tokens_total", {"type": F.col("type")}, F.col("n")),
        labelled_counter(alerts, "alert_created_total", {"severity": F.col("severity")}),
        labelled_counter(
            deliveries,
            "notification_sent_total",
            {"channel": F.col("channel"), "status": F.when(F.col("ok"), "success").otherwise("failure")},
        ),
    ]
    return reduce(DataFrame.unionByName, families)


def rate_limit_flags(log: DataFrame, limit: int = k.REQUESTS_PER_MINUTE, id_col: str = "request_id") -> DataFrame:
    """Add `rejected`: past `limit` requests of a client in a clock minute. Health checks are exempt.

    Requests are numbered by a scan over seconds, so one flooding client is spread out.
    """
    limited = log.filter(~F.col("path").startswith("/api/v1/health")).withColumn("minute", F.date_trunc("minute", "ts"))
    numbered = scans.scan(
        limited, ["client", "minute"], ["ts", id_col], [F.date_trunc("second", F.col("ts"))], nth=scans.count()
    )
    return numbered.withColumn("rejected", F.col("nth") > limit)


def noise_share_report(diffs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Diffs, changed lines, noise lines and the share of noise in everything that changed."""
    totals = diffs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("diffs"),
        F.count_if("is_empty_after_filter").alias("noise_only_diffs"),
        F.sum("original_lines").alias("changed_lines"),
        F.sum("noise_lines_removed").alias("noise_lines"),
    )
    every = F.col("changed_lines")
    return totals.withColumn("noise_percent", F.when(every > 0, F.round(100.0 * F.col("noise_lines") / every, 4)).otherwise(0.0))


def pipeline_report(monitors: DataFrame, snapshots: DataFrame, diffs: DataFrame, alerts: DataFrame) -> DataFrame:
    """(metric, value) rows on the whole chain: what came in, what changed, what was noise, what was alerted."""

    def counts(df: DataFrame, **metrics: Column) -> DataFrame:
        row = df.agg(*[m.cast("double").alias(n) for n, m in metrics.items()])
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("p")
        return row.select(pairs).select("p.*")

    every = F.count(F.lit(1))
    changed, noise = F.coalesce(F.sum("original_lines"), F.lit(0)), F.coalesce(F.sum("noise_lines_removed"), F.lit(0))
    tables = [
        counts(monitors, pages_monitored=F.count_if(F.col("deleted_at").isNull())),
        counts(snapshots, snapshots_processed=every),
        counts(
            diffs,
            diffs_computed=every,
            changes_detected=F.count_if(~F.col("is_empty_after_filter")),
            changed_lines=changed,
            noise_lines_removed=noise,
            noise_percent=F.when(changed > 0, F.round(100.0 * noise / changed, 4)).otherwise(0.0),
        ),
        counts(alerts, alerts_created=every),
    ]
    return reduce(DataFrame.unionByName, tables)
