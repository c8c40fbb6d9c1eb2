"""Notification routing, digests, message rendering and delivery state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions import constants as k
from changeflow.functions import scans
from changeflow.functions.text import escape_html, is_blank, lookup, severity_rank

QUEUE_PART = 1000  # alerts per queue or digest row; a longer one continues in the next part


def route_alerts(alerts: DataFrame, settings: DataFrame, users: DataFrame | None = None, monitors: DataFrame | None = None) -> DataFrame:
    """One row per (alert, channel) to serve: `route` is immediate or digest.

    Alerts already notified, or whose user or monitor is gone, are dropped. Settings hold
    at most one row per (user, channel), so the join multiplies an alert by its channels only.
    A setting without an address falls back on the e-mail of its user, where `users` has one.
    """
    pending = alerts.filter(F.col("notified_at").isNull())
    if monitors is not None:
        pending = pending.join(monitors.select("monitor_id"), "monitor_id", "left_semi")
    if users is not None:
        known = [F.col("email") if "email" in users.columns else F.lit(None).cast("string")]
        pending = pending.join(users.select("user_id", known[0].alias("_email")), "user_id")
    else:
        pending = pending.withColumn("_email", F.lit(None).cast("string"))
    enabled = settings.filter("is_enabled").select(
        "user_id", "channel", "min_severity", "webhook_url", "email_address", "digest_mode", "digest_hour_utc"
    )
    address = F.when(is_blank(F.col("email_address")), F.col("_email")).otherwise(F.col("email_address"))
    routed = pending.join(enabled, "user_id").withColumn("email_address", address).filter(
        severity_rank(F.col("severity")) >= severity_rank(F.col("min_severity"))
    )
    return routed.withColumn("route", F.when(F.col("digest_mode"), "digest").otherwise("immediate")).drop(
        "digest_mode", "min_severity", "_email"
    )


def unroutable_users(alerts: DataFrame, settings: DataFrame) -> DataFrame:
    """Users with pending alerts and no settings at all, with their number of alerts."""
    pending = alerts.filter(F.col("notified_at").isNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts"))
    return pending.join(settings.select("user_id"), "user_id", "left_anti").withColumn("reason", F.lit("no_settings"))


def digest_hour(hour: Column) -> Column:
    """The queue hour; none and midnight both mean nine."""
    return F.when(hour.isNull() | (hour == 0), k.DEFAULT_DIGEST_HOUR).otherwise(hour)


_QUEUE = ["user_id", "channel", "digest_hour_utc"]


def queued_alerts(routes: DataFrame) -> DataFrame:
    """Digest routes with their place in the queue of (user, channel, hour).

    The place comes from a scan over days, so a queue that holds most alerts is not
    numbered by one task.
    """
    digest = routes.filter(F.col("route") == "digest").withColumn("digest_hour_utc", digest_hour(F.col("digest_hour_utc")))
    ranked = scans.scan(digest, _QUEUE, ["created_at", "alert_id"], [scans.by_time("created_at")], place=scans.count())
    return ranked.withColumn("part", F.floor((F.col("place") - 1) / QUEUE_PART).cast("int"))


def digest_queue(routes: DataFrame) -> DataFrame:
    """Alert ids per queue in order, `QUEUE_PART` per row: an array never grows without bound."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "alert_id"))), lambda s: s["alert_id"])
    return queued_alerts(routes).groupBy(*_QUEUE, "part").agg(ids.alias("alert_ids"))


def build_digests(routes: DataFrame, monitors: DataFrame, hour: int, max_summary: int | None = None) -> DataFrame:
    """Digest text per (user, channel) whose hour has come: a header with the total, one line per alert.

    A digest of more than `QUEUE_PART` alerts continues in further parts; only part 0 has
    the header. Empty digests do not exist.
    """
    queued = queued_alerts(routes.filter(digest_hour(F.col("digest_hour_utc")) == hour))
    named = queued.join(monitors.select("monitor_id", F.col("name").alias("monitor_name")), "monitor_id", "left")
    line = F.concat(
        F.lit("• ["), F.upper("severity"), F.lit("] "), F.coalesce("monitor_name", F.lit("Unknown")), F.lit(": "),
        F.col("summary") if max_summary is None else F.substring("summary", 1, max_summary),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"])
    parts = named.groupBy(*_QUEUE, "part").agg(F.array_join(lines, "\n").alias("body"))
    # Places are numbered from 1, so the highest is the total; bodies do not meet in one task for it.
    parts = parts.join(queued.groupBy(*_QUEUE).agg(F.max("place").alias("alerts")), _QUEUE)
    header = F.concat(F.lit("📊 **Daily Digest** — "), F.col("alerts").cast("string"), F.lit(" alert(s)\n\n"))
    return parts.select(
        *_QUEUE, "part", "alerts", F.concat(F.when(F.col("part") == 0, header).otherwise(""), F.col("body")).alias("text")
    )


def render_messages(routes: DataFrame, dashboard_url: str | None = None, sender: str = "changeflow") -> DataFrame:
    """Add `chat_text`, `chat_payload` (JSON), `mail_subject`, `mail_plain` and `mail_html` to routed alerts.

    Needs severity, summary, categories, competitor_name, page_type, url, monitor_name and alert_id.
    """
    severity = F.upper("severity")
    no_name = is_blank(F.col("competitor_name")) if "competitor_name" in routes.columns else F.lit(True)
    competitor = F.when(no_name, "Unknown Competitor").otherwise(F.col("competitor_name"))
    subject_name = F.when(no_name, "Unknown").otherwise(F.col("competitor_name"))
    categories = F.array_join("categories", ", ")
    emoji = lookup(F.col("severity"), k.SEVERITY_EMOJI, k.DEFAULT_EMOJI)
    link = F.concat(F.lit(f"{dashboard_url}/alerts/"), F.col("alert_id").cast("string")) if dashboard_url else None

    def markdown(text: Column) -> Column:
        return F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))

    def plain(text: Column) -> Column:
        return F.struct(F.lit("plain_text").alias("type"), text.alias("text"))

    # The blocks differ in shape, so they are written as JSON one by one and joined.
    blocks = [
        F.to_json(F.struct(F.lit("header").alias("type"), plain(F.concat(emoji, F.lit(" "), severity, F.lit(": Change on "), competitor)).alias("text"))),
        F.to_json(F.struct(F.lit("section").alias("type"), markdown(F.col("summary")).alias("text"))),
        F.to_json(
            F.struct(
                F.lit("section").alias("type"),
                F.array(
                    markdown(F.concat(F.lit("*Page Type:* "), F.col("page_type"))),
                    markdown(F.concat(F.lit("*Monitor:* "), F.col("monitor_name"))),
                    markdown(F.concat(F.lit("*Categories:* "), categories)),
                    markdown(F.concat(F.lit("*URL:* <"), F.col("url"), F.lit("|View Page>"))),
                ).alias("fields"),
            )
        ),
    ]
    if link is not None:
        button = F.struct(
            F.lit("button").alias("type"), plain(F.lit("View Details")).alias("text"), link.alias("url"), F.lit("primary").alias("style")
        )
        blocks.append(F.to_json(F.struct(F.lit("actions").alias("type"), F.array(button).alias("elements"))))
    chat_text = F.concat(emoji, F.lit(" ["), severity, F.lit("] Change detected on "), competitor, F.lit(" ("), F.col("page_type"), F.lit(")"))
    # {"text": ...} without its closing brace, then the blocks.
    opening = F.regexp_replace(F.to_json(F.struct(chat_text.alias("text"))), r"\}$", "")
    payload = F.concat(opening, F.lit(',"blocks":['), F.concat_ws(",", *blocks), F.lit("]}"))

    plain_text = F.concat_ws(
        "\n",
        F.concat(F.lit("["), severity, F.lit("] Change Detected on "), competitor),
        F.lit(""),
        F.col("summary"),
        F.lit(""),
        F.concat(F.lit("Monitor: "), F.col("monitor_name")),
        F.concat(F.lit("Page Type: "), F.col("page_type")),
        F.concat(F.lit("Categories: "), categories),
        F.concat(F.lit("URL: "), F.col("url")),
        F.lit(""),
        F.concat(F.lit("View details: "), link) if link is not None else F.lit(""),
        F.lit("---"),
        F.lit(f"Sent by {sender}"),
    )
    color = lookup(F.col("severity"), k.SEVERITY_COLOR, k.DEFAULT_COLOR)
    cells = [("Monitor", F.col("monitor_name")), ("Page Type", F.col("page_type")), ("Categories", categories), ("URL", F.col("url"))]
    table = F.concat(
        *[
            F.concat(F.lit(f"<tr><td><strong>{title}</strong></td><td>"), F.coalesce(escape_html(value), F.lit("")), F.lit("</td></tr>"))
            for title, value in cells
        ]
    )
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><div style="background-color: '),
        color,
        F.lit('"><h1>'),
        severity,
        F.lit(": Change Detected</h1><p>"),
        escape_html(competitor),
        F.lit(" &mdash; "),
        escape_html(F.col("page_type")),
        F.lit("</p></div><p>"),
        escape_html(F.col("summary")),
        F.lit("</p><table>"),
        table,
        F.lit("</table>"),
        F.concat(F.lit('<a href="'), escape_html(link), F.lit('">View Details</a>')) if link is not None else F.lit(""),
        F.lit(f"<p>Sent by {sender}</p></body></html>"),
    )
    return routes.withColumns(
        {
            "chat_text": chat_text,
            "chat_payload": payload,
            "mail_subject": F.concat(F.lit("["), severity, F.lit("] Change detected on "), subject_name, F.lit(" - "), F.col("page_type")),
            "mail_plain": plain_text,
            "mail_html": html,
        }
    )


def fold_delivery(log: DataFrame, max_error: int | None = None) -> DataFrame:
    """Delivery state per alert from a log (alert_id, channel, ok, error, at).

    Errors are gathered one per channel (the latest), so the list is as long as there are channels.
    """
    per_channel = log.groupBy("alert_id", "channel").agg(
        F.max("ok").alias("sent"),
        F.max("at").alias("at"),
        F.max_by(F.when(~F.col("ok"), F.concat_ws(": ", "channel", "error")), F.when(~F.col("ok"), F.col("at"))).alias("failure"),
    )
    errors = F.array_join(F.array_sort(F.collect_list("failure")), "; ")
    return per_channel.groupBy("alert_id").agg(
        F.coalesce(F.max(F.when(F.col("channel") == "slack", F.col("sent"))), F.lit(False)).alias("notified_via_slack"),
        F.coalesce(F.max(F.when(F.col("channel") == "email", F.col("sent"))), F.lit(False)).alias("notified_via_email"),
        F.max("at").alias("notified_at"),
        F.when(F.length(errors) > 0, errors if max_error is None else F.substring(errors, 1, max_error)).alias("notification_error"),
    )


def settings_view(settings: DataFrame) -> DataFrame:
    """Settings as shown to their owner: the webhook is hidden, only whether there is one."""
    configured = F.coalesce(F.length("webhook_url") > 0, F.lit(False))
    return settings.withColumn("slack_configured", configured).withColumn("webhook_url", F.lit(None).cast("string"))


def reject_settings(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Changes with `problem`: a new, enabled chat channel needs a webhook."""
    known = current.select("user_id", "channel", F.lit(True).alias("_known"))
    problem = F.when(
        (F.col("channel") == "slack") & is_blank(F.col("webhook_url")) & F.col("_known").isNull() & F.coalesce("is_enabled", F.lit(True)),
        "webhook_required",
    )
    return changes.join(known, ["user_id", "channel"], "left").withColumn("problem", problem).drop("_known")
