import json

import pytest
from pyspark.sql import functions as F

from changeflow.operators import notify

ROUTE = (
    "alert_id int, user_id string, monitor_id string, competitor_name string, severity string, summary string, categories array<string>, "
    "notified_at timestamp, created_at timestamp"
)
SETTING = (
    "user_id string, channel string, is_enabled boolean, min_severity string, webhook_url string, email_address string, digest_mode boolean, digest_hour_utc int"
)


@pytest.fixture
def alerts(spark, at):
    rows = [
        (1, "u", "m1", "Acme", "critical", "Price <b>up</b> & away", ["pricing_change", "other"], None, at(0)),
        (2, "u", "m2", None, "medium", "s" * 150, ["other"], None, at(1)),
        (3, "u", "m1", "Acme", "high", "done", ["other"], at(2), at(1)),
        (4, "v", "m1", "Acme", "high", "no settings", ["other"], None, at(1)),
        (5, "w", "gone", "Acme", "high", "no monitor", ["other"], None, at(1)),
    ]
    return spark.createDataFrame(rows, ROUTE)


@pytest.fixture
def settings(spark):
    rows = [
        ("u", "slack", True, "high", "https://h", None, False, None), ("u", "email", True, "medium", None, "u@e", True, 0),
        ("v", "email", False, "low", None, None, False, None), ("w", "email", True, "low", None, None, True, 8),
    ]
    return spark.createDataFrame(rows, SETTING)


@pytest.fixture
def monitors(spark):
    return spark.createDataFrame([("m1", "Pricing", "pricing", "https://e.com"), ("m2", "Blog", "blog", "https://e.com/b")], "monitor_id string, name string, page_type string, url string")


def test_routes(spark, alerts, settings, monitors):
    got = {(r.alert_id, r.channel, r.route) for r in notify.route_alerts(alerts, settings, monitors=monitors).collect()}
    assert got == {(1, "slack", "immediate"), (1, "email", "digest"), (2, "email", "digest")}
    bare = settings.filter("user_id <> 'v'")
    assert [tuple(r) for r in notify.unroutable_users(alerts, bare).collect()] == [("v", 1, "no_settings")]


@pytest.mark.parametrize("hour, queue", [(None, 9), (0, 9), (9, 9), (17, 17)])
def test_digest_hour(spark, hour, queue):
    assert spark.range(1).select(notify.digest_hour(F.lit(hour).cast("int")).alias("h")).first().h == queue


def test_digest(spark, alerts, settings, monitors):
    routes = notify.route_alerts(alerts, settings)
    queue = {(r.user_id, r.digest_hour_utc): r.alert_ids for r in notify.digest_queue(routes).collect()}
    assert queue == {("u", 9): [1, 2], ("w", 8): [5]}
    nine = notify.build_digests(routes, monitors, 9, max_summary=100).collect()
    assert len(nine) == 1 and nine[0].text == (
        "📊 **Daily Digest** — 2 alert(s)\n\n• [CRITICAL] Pricing: Price <b>up</b> & away\n• [MEDIUM] Blog: " + "s" * 100
    )
    assert "Unknown: no monitor" in notify.build_digests(routes, monitors, 8).first().text
    assert notify.build_digests(routes, monitors, 3).count() == 0


def test_long_digest_stays_whole(spark, at, monitors, monkeypatch):
    monkeypatch.setattr(notify, "QUEUE_PART", 7)
    rows = [(i, "u", "m1", "A", "high", f"n{i}", [], None, at(i)) for i in range(20)]
    settings = spark.createDataFrame([("u", "email", True, "low", None, None, True, 9)], SETTING)
    routes = notify.route_alerts(spark.createDataFrame(rows, ROUTE), settings)
    parts = notify.build_digests(routes, monitors, 9).orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1, 2] and {p.alerts for p in parts} == {20}
    lines = "\n".join(p.text for p in parts).split("\n")
    assert lines[0].endswith("20 alert(s)") and [x.split(": ")[1] for x in lines[2:]] == [f"n{i}" for i in range(20)]


def test_messages(alerts, settings, monitors):
    pages = monitors.withColumnRenamed("name", "monitor_name")
    rendered = notify.render_messages(notify.route_alerts(alerts, settings).join(pages, "monitor_id"), "https://d", "us")
    got = {(r.alert_id, r.channel): r for r in rendered.collect()}
    a, b = got[1, "slack"], got[2, "email"]
    assert a.chat_text == "🔴 [CRITICAL] Change detected on Acme (pricing)"
    payload = json.loads(a.chat_payload)
    assert payload["text"] == a.chat_text and [x["type"] for x in payload["blocks"]] == ["header", "section", "section", "actions"]
    assert payload["blocks"][0]["text"]["text"] == "🔴 CRITICAL: Change on Acme"
    assert payload["blocks"][1]["text"]["text"] == "Price <b>up</b> & away"
    assert payload["blocks"][2]["fields"][2]["text"] == "*Categories:* pricing_change, other"
    assert payload["blocks"][3]["elements"][0]["url"] == "https://d/alerts/1"
    assert a.mail_subject == "[CRITICAL] Change detected on Acme - pricing"
    assert b.mail_subject == "[MEDIUM] Change detected on Unknown - blog" and "Unknown Competitor" in b.mail_plain
    assert "View details: https://d/alerts/1" in a.mail_plain and a.mail_plain.endswith("---\nSent by us")
    assert "Price &lt;b&gt;up&lt;/b&gt; &amp; away" in a.mail_html and "<b>up" not in a.mail_html and "#DC2626" in a.mail_html


def test_delivery(spark, at):
    log = [(1, "slack", False, "500", at(0)), (1, "slack", True, None, at(1)), (1, "email", False, "x" * 600, at(2)), (2, "email", True, None, at(0))]
    df = spark.createDataFrame(log, "alert_id int, channel string, ok boolean, error string, at timestamp")
    got = {r.alert_id: r for r in notify.fold_delivery(df).collect()}
    assert (got[1].notified_via_slack, got[1].notified_via_email, got[1].notified_at) == (True, False, at(2))
    assert got[1].notification_error.startswith("email: xxx") and "x" * 600 in got[1].notification_error
    assert (got[2].notified_via_slack, got[2].notified_via_email, got[2].notification_error) == (False, True, None)


def test_settings(spark, settings):
    shown = {(r.user_id, r.channel): (r.webhook_url, r.slack_configured) for r in notify.settings_view(settings).collect()}
    assert shown["u", "slack"] == (None, True) and shown["u", "email"] == (None, False)
    changes = spark.createDataFrame([("n", "slack", True, None), ("n", "email", True, None), ("u", "slack", True, " "), ("x", "slack", False, None)], "user_id string, channel string, is_enabled boolean, webhook_url string")
    got = {(r.user_id, r.channel): r.problem for r in notify.reject_settings(changes, settings).collect()}
    assert got == {("n", "slack"): "webhook_required", ("n", "email"): None, ("u", "slack"): None, ("x", "slack"): None}


def test_address_falls_back_on_the_users(spark, alerts, settings):
    users = spark.createDataFrame([("u", "u@example.com"), ("w", "w@example.com")], "user_id string, email string")
    bare = settings.withColumn("email_address", F.when(F.col("user_id") == "w", "own@example.com"))
    got = {(r.user_id, r.email_address) for r in notify.route_alerts(alerts, bare, users).collect()}
    assert got <= {("u", "u@example.com"), ("w", "own@example.com")} and got
