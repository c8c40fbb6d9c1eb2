"""Canonical table schemas. Times are UTC."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "users": "user_id string, email string, max_monitors int, is_active boolean",
    "monitors": (
        "monitor_id string, user_id string, url string, name string, competitor_name string, page_type string, "
        "css_selector string, noise_patterns array<string>, render_js boolean, check_interval_hours int, "
        "is_active boolean, next_check_at timestamp, last_checked_at timestamp, created_at timestamp, deleted_at timestamp"
    ),
    "pages": (
        "monitor_id string, url string, raw_html string, http_status int, render_method string, "
        "fetch_duration_ms int, fetched_at timestamp"
    ),
    "attempts": "monitor_id string, attempted_at timestamp, ok boolean, error string, render_method string",
    "snapshots": (
        "snapshot_id string, monitor_id string, url string, extracted_text string, text_hash string, "
        "text_length int, created_at timestamp"
    ),
    "diff_lines": "diff_id string, seq int, hunk_no int, op string, text string",
    "diffs": (
        "diff_id string, monitor_id string, snapshot_before_id string, snapshot_after_id string, lines_added int, "
        "lines_removed int, changed_hunks int, diff_size_bytes bigint, original_lines int, noise_lines_removed int, "
        "learned_noise_lines_removed int, learned_hits map<string,int>, filtered_diff string, "
        "is_empty_after_filter boolean, created_at timestamp"
    ),
    "pattern_observations": (
        "monitor_id string, diff_id string, pattern string, template string, similarity double, before string, "
        "after string, blocked_reason string, observed_at timestamp"
    ),
    "pattern_state": (
        "monitor_id string, pattern string, valid_from timestamp, support_count int, avg_similarity double, "
        "recent_diff_count int, confidence double, review_required boolean, blocked_reason string, "
        "is_active boolean, promoted_at timestamp"
    ),
    "filter_events": "monitor_id string, pattern string, diff_id string, at timestamp, count int",
    "responses": (
        "diff_id string, body string, is_structured boolean, prompt_tokens int, completion_tokens int, error string"
    ),
    "analyses": (
        "diff_id string, monitor_id string, significance_level string, summary string, categories array<string>, "
        "prompt_tokens int, completion_tokens int, total_cost_usd double, needs_review boolean, error string, "
        "suppression_reason string, created_at timestamp"
    ),
    "alerts": (
        "alert_id string, monitor_id string, user_id string, competitor_name string, severity string, summary string, "
        "categories array<string>, diff_id string, is_acknowledged boolean, notified_at timestamp, cluster_id string, "
        "created_at timestamp"
    ),
    "clusters": (
        "cluster_id string, user_id string, competitor_name string, title string, severity string, alert_count int, "
        "categories array<string>, keywords array<string>, is_resolved boolean, created_at timestamp, updated_at timestamp"
    ),
    "notification_settings": (
        "user_id string, channel string, is_enabled boolean, min_severity string, webhook_url string, "
        "email_address string, digest_mode boolean, digest_hour_utc int"
    ),
    "request_log": "ts timestamp, client string, method string, path string, status int, duration_ms double",
    "signups": "email string, created_at timestamp",
}
