"""The same results as plain SQL, for an independent engine to check the queries against.

Common table expressions mirror the adapters; each oracle names the ones it needs.
"""

from __future__ import annotations

from changeflow.functions import constants as k

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (needs, sql)


def oracle(name: str, sql: str, needs: tuple[str, ...] = (), recursive: bool = False) -> None:
    ordered: list[str] = []

    def visit(one: str) -> None:
        for inner in CTES[one][0]:
            visit(inner)
        if one not in ordered:
            ordered.append(one)

    for one in needs:
        visit(one)
    parts = [f"{one} AS ({CTES[one][1]})" for one in ordered]
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else ""
    if sql.lstrip().startswith("+WITH"):
        sql = sql.lstrip()[len("+WITH") :]
        head = (head.rstrip() + ", ") if head else f"WITH {'RECURSIVE ' if recursive else ''}"
    ORACLES[name] = head + sql


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(lit(v) for v in values)


RANK = "CASE {c} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
NAME = "CASE {c} WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'noise' END"
STRIP = r"regexp_replace({c}, '^[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+|[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+$', '', 'g')"
DUE_AT = "TIMESTAMP '2024-01-15 00:00:00'"
LEARNED_AT = "TIMESTAMP '2024-11-20 00:00:00'"
USED_AT = "TIMESTAMP '2024-01-25 00:00:00'"
RETAINED_AT = "TIMESTAMP '2025-01-15 00:00:00'"


def rank(c: str) -> str:
    return RANK.format(c=c)


def strip(c: str) -> str:
    return STRIP.format(c=c)


def _stripped(c: str) -> str:
    for pattern in k.GLOBAL_NOISE_PATTERNS:
        if "(?=" in pattern:
            # No look-ahead here: the ending is captured and put back.
            bare = pattern.replace("(?=", "(")
            c = f"regexp_replace({c}, {lit(bare)}, '\\1', 'gi')"
        else:
            wide = pattern.replace(r"[\w-]", r"[\w\p{L}\p{N}-]").replace(r"\w+", r"[\w\p{L}\p{N}]+")
            c = f"regexp_replace({c}, {lit(wide)}, '', 'gi')"
    return c


# ---- adapters --------------------------------------------------------------------------

cte(
    "analyses_v",
    """SELECT event_id AS diff_id, user_id AS monitor_id, user_id % 10 AS user_id,
    CASE WHEN user_id % 30 = 7 THEN '  ' ELSE 'comp' || (user_id % 30) END AS competitor_name,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium'
      WHEN 'click' THEN 'low' ELSE 'noise' END AS severity,
    event_type || ' ' || props AS summary,
    CASE event_type WHEN 'error' THEN ['technical_change'] WHEN 'purchase' THEN ['pricing_change', 'feature_launch']
      WHEN 'signup' THEN ['messaging_change'] WHEN 'click' THEN ['hiring_signal'] ELSE ['other'] END AS categories,
    event_type, ts AS created_at FROM events""",
)
cte(
    "alerts_v",
    """SELECT diff_id AS alert_id, monitor_id, user_id, competitor_name, severity, summary, categories, event_type, created_at,
    diff_id % 3 = 0 AS is_acknowledged, CASE WHEN diff_id % 4 = 0 THEN created_at END AS notified_at
    FROM analyses_v WHERE severity IN ('critical', 'high', 'medium')""",
    ("analyses_v",),
)
cte("snapshots_v", "SELECT event_id AS snapshot_id, user_id AS monitor_id, event_type AS text_hash, ts AS created_at FROM events")
cte(
    "observations_v",
    """SELECT user_id AS monitor_id, event_type AS pattern, event_id AS diff_id,
    CAST(0.58 AS DOUBLE) + CAST(0.42 AS DOUBLE) * (event_id % 97) / 97 AS similarity,
    CASE json_extract_string(props, '$.k') WHEN '0' THEN 'price_or_percentage_signal' WHEN '1' THEN 'change_action_word' END AS blocked_reason,
    make_timestamp(1704067200000000 + 12 * (epoch_us(ts) - 1704067200000000)) AS observed_at FROM events""",
)
cte(
    "filter_events_v",
    "SELECT user_id AS monitor_id, event_type AS pattern, event_id AS diff_id, ts AS used_at, CAST(1 + event_id % 5 AS INTEGER) AS count FROM events",
)
cte(
    "versions_v",
    """SELECT doc_id * 100 + version AS snapshot_id, doc_id AS monitor_id, CAST(version AS INTEGER) AS version,
    array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x, i: (i - 1) || ': ' || x), lambda x, i: i % (version + 7) <> 0), chr(10))
      || chr(10) || 'Last updated: March ' || version AS extracted_text,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(version AS INTEGER)) AS created_at
    FROM documents, range(0, 12) AS r(version)""",
)
cte(
    "lines_v",
    """SELECT doc_id AS diff_id, doc_id AS monitor_id, lang, pos AS seq, CAST(pos // 8 AS INTEGER) AS hunk_no,
    CASE pos % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END AS op,
    CASE pos % 7 WHEN 2 THEN '2024-03-1' || (pos % 10) || ' 10:00' WHEN 4 THEN 'utm_source=x' || doc_id || ' '
      WHEN 5 THEN line || ' session_id=' || doc_id WHEN 6 THEN 'Build v' || pos || ' for site ' || doc_id
      WHEN 1 THEN 'visits: ' || pos ELSE line END AS text
    FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
          CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos FROM documents)""",
)
cte(
    "monitors_v",
    f"""SELECT s_suppkey AS monitor_id, CAST(s_nationkey AS BIGINT) AS user_id,
    'https://site' || (s_suppkey % 4) || '.example.com/p' || (s_suppkey % 3) AS url, s_name AS name,
    'comp' || (s_suppkey % 30) AS competitor_name,
    (['pricing', 'changelog', 'homepage', 'jobs', 'blog', 'docs', 'other'])[CAST(s_suppkey % 7 AS INTEGER) + 1] AS page_type,
    s_suppkey % 5 <> 0 AS is_active,
    {DUE_AT} + to_minutes(CAST(s_suppkey * 7919 % 1000 AS INTEGER) - 500) AS next_check_at,
    CASE WHEN s_suppkey % 4 <> 0 THEN {DUE_AT} - to_minutes(CAST(s_suppkey * 31 % 90 AS INTEGER)) END AS last_checked_at,
    CASE WHEN s_suppkey % 9 = 0 THEN {DUE_AT} - to_days(CAST(s_suppkey % 60 AS INTEGER)) END AS deleted_at,
    TIMESTAMP '2023-01-01 00:00:00' + to_hours(CAST(s_suppkey % 5000 AS INTEGER)) AS created_at FROM supplier""",
)
cte("users_v", "SELECT c_custkey AS user_id, lower(c_name) || '@example.com' AS email, c_acctbal >= 0 AS is_active FROM customer")
cte(
    "settings_v",
    """SELECT c_custkey AS user_id, CASE ch WHEN 0 THEN 'slack' ELSE 'email' END AS channel, (c_custkey + ch) % 5 <> 0 AS is_enabled,
    CASE c_custkey % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'critical' END AS min_severity,
    CASE WHEN ch = 0 AND c_custkey % 7 <> 0 THEN 'https://hooks.example.com/' || c_custkey END AS webhook_url,
    CASE WHEN ch = 1 THEN lower(c_name) || '@example.com' END AS email_address, (c_custkey + ch) % 2 = 0 AS digest_mode,
    CASE c_custkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 9 WHEN 3 THEN CAST(c_custkey % 24 AS INTEGER) END AS digest_hour_utc
    FROM customer, range(0, 2) AS r(ch)""",
)
cte(
    "attempts_v",
    """SELECT event_id AS attempt_id, user_id AS monitor_id, ts AS attempted_at, event_type NOT IN ('error', 'purchase') AS ok,
    CASE WHEN event_type IN ('error', 'purchase') THEN event_type || ': ' || repeat(props, 60) END AS error,
    CASE WHEN event_type = 'click' THEN 'browser' ELSE 'http' END AS render_method, user_id % 11 = 0 AS use_override,
    user_id % 2 = 0 AS has_fallback, event_type <> 'error' AS primary_ok, event_type = 'view' AND value < 5 AS bot_page,
    event_id % 3 <> 0 AS fallback_ok FROM events""",
)
cte(
    "request_log_v",
    """SELECT event_id AS request_id, ts, user_id AS client, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN event_type = 'view' THEN '/api/v1/health' ELSE '/api/v1/' || event_type END AS path,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 100 AS seconds FROM events""",
)
cte(
    "responses_v",
    """SELECT event_id AS diff_id, user_id AS monitor_id, ts AS created_at,
    CASE event_id % 6
      WHEN 0 THEN '{"significance_level":"high","summary":"' || event_type || ' moved","categories":["pricing_change","other"]}'
      WHEN 1 THEN '{"significance_level":"urgent","summary":"' || event_type || '","categories":["hiring_signal"]}'
      WHEN 2 THEN '{"significance_level":"low","summary":"' || repeat(event_type, 300) || '","categories":["partnership","unheard_of"]}'
      WHEN 3 THEN '{"significance_level":"critical","summary":"' || event_type || '","categories":[]}'
      WHEN 4 THEN '{"significance_level":"noise","categories":["feature_removal"]}' END AS body,
    CAST(100 + event_id % 900 AS INTEGER) AS prompt_tokens, CAST(20 + event_id % 200 AS INTEGER) AS completion_tokens,
    CASE WHEN event_id % 6 = 5 THEN 'timeout' END AS error FROM events""",
)
cte(
    "parsed_v",
    f"""SELECT *, total AS total_cost_usd FROM (SELECT diff_id, monitor_id, created_at, error,
    CASE WHEN error IS NOT NULL THEN 'medium' WHEN lvl IN ({in_list(k.SEVERITIES)}) THEN lvl ELSE 'medium' END AS significance_level,
    CASE WHEN error IS NOT NULL THEN {lit(k.FAILED_SUMMARY)} ELSE coalesce(summ, {lit(k.UNCERTAIN_SUMMARY)}) END AS summary,
    CASE WHEN error IS NOT NULL OR len(known) = 0 THEN ['other'] ELSE known END AS categories,
    error IS NOT NULL OR lvl NOT IN ({in_list(k.SEVERITIES)}) OR summ IS NULL OR len(cats) = 0 OR len(known) <> len(cats) AS needs_review,
    CASE WHEN error IS NULL THEN p ELSE 0 END AS prompt_tokens, CASE WHEN error IS NULL THEN c ELSE 0 END AS completion_tokens,
    CASE WHEN error IS NULL THEN round(p * CAST(3e-6 AS DOUBLE) + c * CAST(15e-6 AS DOUBLE), 6) ELSE 0.0 END AS total
    FROM (SELECT *, list_filter(cats, lambda x: list_contains([{in_list(k.CATEGORIES)}], x)) AS known FROM
      (SELECT diff_id, monitor_id, created_at, error, prompt_tokens AS p, completion_tokens AS c,
       json_extract_string(body, '$.significance_level') AS lvl, json_extract_string(body, '$.summary') AS summ,
       json_extract_string(body, '$.categories[*]') AS cats FROM responses_v)))""",
    ("responses_v",),
)
cte(
    "free_text_v",
    """SELECT conv_id, turn, (CASE (conv_id + turn) % 6 WHEN 0 THEN 'This is CRITICAL: a pricing change. ' WHEN 1 THEN 'Looks high, feature_launch. '
    WHEN 2 THEN 'Highly unusual noise. ' WHEN 3 THEN 'another Hiring Signal, low value. ' WHEN 4 THEN 'Partnership news. ' ELSE '' END) || text AS text
    FROM conversations""",
)

# ---- A ------------------------------------------------------------------------------------

oracle(
    "append_once_analyses",
    "SELECT diff_id, monitor_id, severity, created_at FROM analyses_v WHERE severity <> 'critical'",
    ("analyses_v",),
)
oracle(
    "upsert_settings",
    """SELECT user_id, channel, CASE WHEN channel = 'email' AND (user_id % 3 > 0 OR NOT is_enabled) THEN NOT is_enabled ELSE is_enabled END AS is_enabled,
    min_severity, CASE WHEN channel = 'email' THEN CAST(user_id % 3 AS INTEGER) ELSE 0 END AS version FROM settings_v""",
    ("settings_v",),
)

# ---- B ------------------------------------------------------------------------------------

cte(
    "page_text_v",
    f"""SELECT page_id, url, html,
    {strip("regexp_replace(regexp_replace(body, chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), ' +', ' ', 'g')".replace("{{", "{").replace("}}", "}"))} AS txt FROM
    (SELECT page_id, url, html, regexp_replace(replace(replace(replace(replace(replace(replace(array_to_string(list_filter(list_transform(
      string_split_regex(regexp_replace(regexp_replace(html, '(?is)<(head|script|style|noscript|iframe|svg)\\b[^>]*>.*?</(head|script|style|noscript|iframe|svg)>', '<x>', 'g'),
        '(?s)<!--.*?-->', '<x>', 'g'), '<[^>]*>'), lambda x: {strip("replace(x, '&nbsp;', chr(160))")}), lambda x: x <> ''), chr(10)),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS body FROM pages)""",
)
oracle("extract_page_text", "SELECT page_id, sha256(txt) AS text_hash, CAST(length(txt) AS INTEGER) AS text_length FROM page_text_v", ("page_text_v",))
oracle(
    "normalize_page_text",
    f"""SELECT doc_id, sha256({strip("regexp_replace(regexp_replace(replace(replace(text, chr(10), repeat(chr(10), 4)), ' ', '  '), chr(10) || '{3,}', chr(10) || chr(10), 'g'), ' +', ' ', 'g')")}) AS text_hash
    FROM documents""",
)
oracle("fingerprint_text", "SELECT doc_id, sha256(text) AS text_hash, CAST(length(text) AS INTEGER) AS text_length FROM documents")
oracle(
    "flag_js_pages",
    f"""SELECT kind, id, f AS needs_rendering, CASE WHEN f THEN {DUE_AT} + INTERVAL 5 MINUTES END AS recheck_at FROM
    (SELECT 'page' AS kind, page_id AS id, length(txt) < 100 AND contains(lower(html || CASE WHEN contains(url, 'example.com') THEN '<NoScript>' ELSE '' END), '<noscript') AS f FROM page_text_v
    UNION ALL SELECT 'document', doc_id, length(text) < 100 AND contains(lower(text || CASE WHEN lang = 'en' THEN '<NoScript>' ELSE '' END), '<noscript') FROM documents)""",
    ("page_text_v",),
)
oracle(
    "flag_bot_pages",
    f"""SELECT doc_id, length(t) <= 500 AND regexp_matches(t, {lit("(?i)" + k.BOT_PAGE_PATTERN)}) AS is_bot_page FROM
    (SELECT doc_id, text || CASE WHEN lang = 'en' THEN ' Access Denied' ELSE '' END AS t FROM documents)""",
)
oracle(
    "due_monitors",
    f"""SELECT monitor_id, place, CAST(floor((place - 1) / 20) AS BIGINT) AS batch_no FROM
    (SELECT monitor_id, row_number() OVER (ORDER BY next_check_at, monitor_id) AS place FROM monitors_v
     WHERE is_active AND deleted_at IS NULL AND next_check_at <= {DUE_AT})""",
    ("monitors_v",),
)
oracle(
    "skip_recent",
    f"SELECT monitor_id, last_checked_at FROM monitors_v WHERE last_checked_at IS NULL OR {DUE_AT} - last_checked_at >= INTERVAL 30 MINUTES",
    ("monitors_v",),
)
cte(
    "streaks_v",
    """SELECT *, CAST(count(*) FILTER (NOT ok) OVER (PARTITION BY monitor_id, island ORDER BY attempted_at, attempt_id) AS INTEGER) AS consecutive_failures
    FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY monitor_id ORDER BY attempted_at, attempt_id) AS island FROM attempts_v)""",
    ("attempts_v",),
)
oracle("attempt_streaks", "SELECT attempt_id, monitor_id, consecutive_failures FROM streaks_v", ("streaks_v",))
oracle(
    "fold_attempts",
    """SELECT s.monitor_id, t.attempts, CASE WHEN ok THEN 'success' ELSE 'failed' END AS last_status, CASE WHEN NOT ok THEN error END AS last_error,
    consecutive_failures, consecutive_failures >= 5 AS auto_paused, worst_streak, last_checked_at, attempted_at + INTERVAL 6 HOURS AS next_check_at
    FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id ORDER BY attempted_at DESC, attempt_id DESC) AS rn FROM streaks_v) s
    JOIN (SELECT monitor_id, count(*) AS attempts, max(consecutive_failures) AS worst_streak, max(attempted_at) FILTER (ok) AS last_checked_at
          FROM streaks_v GROUP BY monitor_id) t ON s.monitor_id = t.monitor_id WHERE rn = 1""",
    ("streaks_v",),
)
oracle(
    "choose_fetch_route",
    """SELECT attempt_id, CASE WHEN use_override AND has_fallback AND fallback_ok THEN 'override' WHEN use_override AND has_fallback THEN 'failed'
    WHEN primary_ok AND bot_page AND has_fallback AND fallback_ok THEN 'fallback_after_bot_page' WHEN primary_ok THEN 'primary'
    WHEN has_fallback AND fallback_ok THEN 'fallback_after_error' ELSE 'failed' END AS route FROM attempts_v""",
    ("attempts_v",),
)
oracle(
    "validate_urls",
    """SELECT page_id, CAST(variant AS INTEGER) AS variant, CASE variant WHEN 0 THEN NULL WHEN 1 THEN 'scheme_not_allowed' WHEN 2 THEN 'localhost'
    WHEN 3 THEN CASE WHEN page_id % 256 BETWEEN 16 AND 31 THEN 'private_or_reserved_address' END
    WHEN 4 THEN 'private_or_reserved_address' WHEN 6 THEN 'no_hostname' END AS problem FROM pages, range(0, 7) AS r(variant)""",
)
oracle(
    "validate_monitors",
    """SELECT monitor_id, reason IS NULL AS is_valid, reason FROM (SELECT monitor_id,
    CASE WHEN NOT sound THEN 'deleted' WHEN taken - cand >= 3 THEN 'monitor_limit' WHEN cand = 0 THEN 'duplicate_url' END AS reason
    FROM (SELECT *, sum(cand) OVER (PARTITION BY user_id ORDER BY created_at, monitor_id) AS taken FROM
      (SELECT *, deleted_at IS NULL AS sound, CASE WHEN deleted_at IS NULL AND
        row_number() OVER (PARTITION BY user_id, url, deleted_at IS NULL ORDER BY created_at, monitor_id) = 1 THEN 1 ELSE 0 END AS cand FROM monitors_v)))""",
    ("monitors_v",),
)

# ---- C ------------------------------------------------------------------------------------

cte(
    "pairs_v",
    """SELECT *, lag(snapshot_id) OVER w AS before_id, lag(text_hash) OVER w AS before_hash FROM snapshots_v
    WINDOW w AS (PARTITION BY monitor_id ORDER BY created_at, snapshot_id)""",
    ("snapshots_v",),
)
oracle("pair_snapshots", "SELECT snapshot_id, before_id, before_hash FROM pairs_v", ("pairs_v",))
oracle(
    "snapshot_status",
    """SELECT snapshot_id, CASE WHEN before_id IS NULL THEN 'baseline' WHEN text_hash = before_hash THEN 'no_change' WHEN text_hash = 'view' THEN 'no_change'
    WHEN text_hash = 'error' THEN 'classified' ELSE 'diffed' END AS status FROM pairs_v""",
    ("pairs_v",),
)
cte(
    "version_pairs_v",
    """SELECT * FROM (SELECT snapshot_id AS diff_id, monitor_id, lag(extracted_text) OVER (PARTITION BY monitor_id ORDER BY created_at) AS before_text,
    extracted_text AS after_text FROM versions_v) WHERE before_text IS NOT NULL AND before_text <> after_text""",
    ("versions_v",),
)
oracle(
    "diff_repeated_lines",
    """SELECT doc_id AS diff_id, sha256(b) AS before_hash, sha256(a) AS after_hash, CAST(0 AS INTEGER) AS last_hunk FROM
    (SELECT doc_id, array_to_string(l, chr(10)) AS b, array_to_string(list_filter(l, lambda x, i: (i - 1) % 5 <> 1), chr(10)) AS a FROM
      (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') AS l FROM documents))
    WHERE a <> b""",
)
oracle(
    "diff_roundtrip",
    "SELECT diff_id, sha256(before_text) AS before_hash, sha256(after_text) AS after_hash FROM version_pairs_v",
    ("version_pairs_v",),
)
oracle(
    "diff_line_balance",
    "SELECT diff_id, CAST(len(string_split(after_text, chr(10))) - len(string_split(before_text, chr(10))) AS BIGINT) AS net_lines FROM version_pairs_v",
    ("version_pairs_v",),
)
# The lines of a version are numbered, so no line occurs twice and common lines keep their order:
# the only diff that keeps all of them removes what is not in the later text and adds what is not
# in the earlier one. Context is three lines around a change; a longer quiet stretch parts hunks.
cte(
    "version_lines_v",
    """SELECT diff_id, monitor_id, side, CAST(unnest(range(len(l))) AS INTEGER) AS idx, unnest(l) AS text FROM
    (SELECT diff_id, monitor_id, 'b' AS side, string_split(before_text, chr(10)) AS l FROM version_pairs_v
     UNION ALL SELECT diff_id, monitor_id, 'a', string_split(after_text, chr(10)) FROM version_pairs_v)""",
    ("version_pairs_v",),
)
cte(
    "merged_v",
    """SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY anchor, kind, idx) AS m FROM
    (SELECT *, CASE WHEN shared THEN 2 WHEN side = 'b' THEN 0 ELSE 1 END AS kind, CASE WHEN shared THEN ' ' WHEN side = 'b' THEN '-' ELSE '+' END AS op,
      count(*) FILTER (shared) OVER (PARTITION BY diff_id, side ORDER BY idx) - CASE WHEN shared THEN 1 ELSE 0 END AS anchor
     FROM (SELECT *, count(*) OVER (PARTITION BY diff_id, text) = 2 AS shared FROM version_lines_v)) WHERE NOT (shared AND side = 'a')""",
    ("version_lines_v",),
)
cte(
    "diff_v",
    """SELECT diff_id, monitor_id, op, text, b_pos, a_pos, CAST(row_number() OVER w - 1 AS INTEGER) AS seq, CAST(sum(jump) OVER w - 1 AS INTEGER) AS hunk_no FROM
    (SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY diff_id ORDER BY m) = 1 THEN 0 ELSE 1 END AS jump FROM
      (SELECT *, max(CASE WHEN op <> ' ' THEN m END) OVER p AS back, min(CASE WHEN op <> ' ' THEN m END) OVER f AS ahead,
        count(*) FILTER (op <> '+') OVER p - CASE WHEN op <> '+' THEN 1 ELSE 0 END AS b_pos, count(*) FILTER (op <> '-') OVER p - CASE WHEN op <> '-' THEN 1 ELSE 0 END AS a_pos
       FROM merged_v WINDOW p AS (PARTITION BY diff_id ORDER BY m ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY diff_id ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
     WHERE m - back <= 3 OR ahead - m <= 3) WINDOW w AS (PARTITION BY diff_id ORDER BY m ROWS UNBOUNDED PRECEDING)""",
    ("merged_v",),
)


def _range(start: str, n: str) -> str:
    return f"CASE {n} WHEN 0 THEN {start} || ',0' WHEN 1 THEN CAST({start} + 1 AS VARCHAR) ELSE ({start} + 1) || ',' || {n} END"


cte(
    "noted_v",
    f"""SELECT *, op <> ' ' AND length(left_over) < 5 AND (left_over <> {strip("text")} OR {strip("text")} = '') AS is_noise
    FROM (SELECT *, {strip(_stripped("text"))} AS left_over FROM diff_v)""",
    ("diff_v",),
)
cte(
    "hunks_v",
    f"""SELECT *, '@@ -' || {_range("b_start", "n_before")} || ' +' || {_range("a_start", "n_after")} || ' @@' AS header FROM
    (SELECT diff_id, hunk_no, any_value(monitor_id) AS monitor_id, min(b_pos) AS b_start, min(a_pos) AS a_start, count(*) FILTER (op <> '+') AS n_before, count(*) FILTER (op <> '-') AS n_after,
      count(*) FILTER (op = '+') AS added, count(*) FILTER (op = '-') AS removed, sum(strlen(text) + 2) AS bytes, count(*) FILTER (is_noise) AS noise,
      string_agg(op || text, chr(10) ORDER BY seq) AS body, string_agg(op || text, chr(10) ORDER BY seq) FILTER (NOT is_noise) AS kept
     FROM noted_v GROUP BY diff_id, hunk_no)""",
    ("noted_v",),
)
oracle("diff_snapshots", "SELECT diff_id, seq, hunk_no, op, sha256(text) AS text_hash FROM diff_v", ("diff_v",))
oracle(
    "diff_stats",
    """SELECT diff_id, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(removed) AS BIGINT) AS lines_removed, count(*) AS changed_hunks,
    CAST(sum(bytes + strlen(header) + 1) + 25 AS BIGINT) AS diff_size_bytes FROM hunks_v GROUP BY diff_id""",
    ("hunks_v",),
)
oracle(
    "render_unified",
    """SELECT diff_id, CAST(strlen(t) AS INTEGER) AS bytes, sha256(t) AS text_hash FROM (SELECT diff_id, '--- previous' || chr(10) || '+++ current' || chr(10)
    || string_agg(header || chr(10) || body, chr(10) ORDER BY hunk_no) || chr(10) AS t FROM hunks_v GROUP BY diff_id)""",
    ("hunks_v",),
)
oracle(
    "filtered_text",
    """SELECT diff_id, count(*) FILTER (added + removed > noise) = 0 AS is_empty_after_filter, sha256('--- previous' || chr(10) || '+++ current' || chr(10)
    || string_agg(header || chr(10) || kept, chr(10) ORDER BY hunk_no) FILTER (added + removed > noise)) AS text_hash FROM hunks_v GROUP BY diff_id""",
    ("hunks_v",),
)
oracle(
    "meaningful_changes",
    """SELECT monitor_id, count(*) AS diffs, count(*) FILTER (changed = noise) AS noise_only_diffs, CAST(sum(changed) AS BIGINT) AS changed_lines, CAST(sum(noise) AS BIGINT) AS noise_lines,
    round(100.0 * sum(noise) / sum(changed), 4) AS noise_percent FROM
    (SELECT diff_id, any_value(monitor_id) AS monitor_id, sum(added + removed) AS changed, sum(noise) AS noise FROM hunks_v GROUP BY diff_id) GROUP BY monitor_id""",
    ("hunks_v",),
)
oracle("last_change", "SELECT monitor_id, max(created_at) AS last_change_at FROM analyses_v GROUP BY monitor_id", ("analyses_v",))

# ---- D ------------------------------------------------------------------------------------


cte(
    "residual_v",
    f"""SELECT *, CASE WHEN lang = 'en' THEN regexp_replace(g, 'visits: \\d+', '', 'gi') ELSE g END AS m FROM
    (SELECT *, CASE WHEN op <> ' ' THEN {_stripped("text")} END AS g FROM lines_v)""",
    ("lines_v",),
)
cte(
    "marked_v",
    f"""SELECT *, coalesce(op <> ' ' AND length(residual) < 5 AND (residual <> {strip("text")} OR {strip("text")} = ''), false) AS is_noise FROM (SELECT *, {strip("CASE WHEN b OR v THEN '' ELSE m END")} AS residual FROM
    (SELECT *, coalesce(lang <> 'en' AND regexp_matches(m, '(?i)^Build\\s+.+?$'), false) AS b,
      coalesce(lang <> 'en' AND regexp_matches(m, '(?i)^visits:\\s+.+?$'), false) AS v FROM residual_v))""",
    ("residual_v",),
)
# valid_patterns has no oracle: whether a pattern compiles is a matter of the dialect.
oracle("strip_noise", "SELECT diff_id, seq, sha256(residual) AS residual_hash FROM marked_v WHERE op <> ' '", ("marked_v",))
oracle(
    "classify_noise_lines",
    r"""SELECT diff_id, seq, is_noise, CASE WHEN is_noise AND b THEN '^Build\s+.+?$' WHEN is_noise AND v THEN '^visits:\s+.+?$' ELSE '' END AS hit_patterns FROM marked_v""",
    ("marked_v",),
)
oracle(
    "learned_hits",
    r"""SELECT diff_id, CASE WHEN b THEN '^Build\s+.+?$' ELSE '^visits:\s+.+?$' END AS pattern, count(*) AS count FROM marked_v WHERE is_noise AND (b OR v) GROUP BY 1, 2""",
    ("marked_v",),
)
oracle(
    "drop_empty_hunks",
    """SELECT diff_id, hunk_no, seq FROM (SELECT *, bool_or(op <> ' ') OVER (PARTITION BY diff_id, hunk_no) AS alive FROM marked_v WHERE NOT is_noise) WHERE alive""",
    ("marked_v",),
)
cte(
    "filtered_v",
    r"""SELECT diff_id, any_value(monitor_id) AS monitor_id, count(*) FILTER (op <> ' ') AS original_lines, count(*) FILTER (is_noise) AS noise_lines_removed,
    count(*) FILTER (is_noise AND (b OR v)) AS learned_noise_lines_removed, count(*) FILTER (op <> ' ' AND NOT is_noise) = 0 AS is_empty_after_filter,
    concat_ws(',', CASE WHEN count(*) FILTER (is_noise AND b) > 0 THEN '^Build\s+.+?$=' || count(*) FILTER (is_noise AND b) END,
      CASE WHEN count(*) FILTER (is_noise AND v) > 0 THEN '^visits:\s+.+?$=' || count(*) FILTER (is_noise AND v) END) AS hits
    FROM marked_v GROUP BY diff_id""",
    ("marked_v",),
)
oracle(
    "filter_diffs",
    "SELECT diff_id, original_lines, noise_lines_removed, learned_noise_lines_removed, is_empty_after_filter, hits FROM filtered_v",
    ("filtered_v",),
)

# ---- E ------------------------------------------------------------------------------------

COLLAPSE = "regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '[\\s\\x{a0}]+', ' ', 'g')"
oracle(
    "replacement_pairs",
    """+WITH c AS (SELECT *, sum(CASE WHEN op = ' ' OR hunk_no <> coalesce(prev_hunk, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY seq) AS block
      FROM (SELECT *, lag(hunk_no) OVER (PARTITION BY diff_id ORDER BY seq) AS prev_hunk FROM lines_v)),
    d AS (SELECT *, row_number() OVER (PARTITION BY diff_id, block, op ORDER BY seq) AS rn FROM (SELECT *, """
    + COLLAPSE
    + """ AS content FROM c WHERE op <> ' ') WHERE content <> '')
    SELECT a.diff_id, a.seq, sha256(r.content) AS before_hash, sha256(a.content) AS after_hash
    FROM d a JOIN d r ON a.diff_id = r.diff_id AND a.block = r.block AND a.rn = r.rn AND a.op = '+' AND r.op = '-'""",
    ("lines_v",),
)
_TERMS = "|".join(k.BUSINESS_TERMS)
_EDGE = r"(^|[^\w\p{L}\p{N}])"
_END = r"([^\w\p{L}\p{N}]|$)"
oracle(
    "safeguard_reason",
    f"""SELECT doc_id, CASE
    WHEN regexp_matches(t, '(?i)\\$\\s?\\d|\\d+(?:\\.\\d+)?\\s?%|{_EDGE}(?:usd|eur|gbp|cad|aud){_END}') THEN 'price_or_percentage_signal'
    WHEN regexp_matches(lower(t), '{_EDGE}({_TERMS}){_END}') AND regexp_matches(t, '\\d') THEN 'digit_adjacent_business_term'
    WHEN regexp_matches(t, '(?i){_EDGE}(launch(?:ed)?|deprecat(?:e|ed|ion)|remove(?:d)?|announce(?:d|ment)?|release(?:d)?){_END}') THEN 'change_action_word'
    ELSE 'protected_token:' || list_min(list_filter(regexp_extract_all(lower(t), '[a-zA-Z][a-zA-Z0-9_-]+'),
      lambda x: list_contains([{in_list(k.PROTECTED_WORDS)}, 'acme', 'the-of'], x))) END AS reason
    FROM (SELECT doc_id, text || ' ' || source AS t FROM documents)""",
)
oracle(
    "learning_gate",
    """SELECT snapshot_id AS diff_id, n AS snapshots_seen, CASE WHEN text_hash = 'view' THEN 'empty_diff' WHEN n < 10 THEN 'insufficient_snapshot_history'
    WHEN text_hash = 'click' THEN 'no_replacement_pairs' END AS skip_reason
    FROM (SELECT *, count(*) OVER (PARTITION BY monitor_id ORDER BY created_at, snapshot_id) AS n FROM snapshots_v)""",
    ("snapshots_v",),
)
cte(
    "history_v",
    """SELECT *, count(*) OVER w AS support_count, sum(similarity) OVER w / count(*) OVER w AS avg_similarity, min(observed_at) OVER w AS first_seen_at,
    bool_or(blocked_reason IS NOT NULL) OVER w AS review_required, last_value(blocked_reason IGNORE NULLS) OVER w AS latest_blocked_reason,
    count(*) OVER (PARTITION BY monitor_id ORDER BY observed_at RANGE BETWEEN INTERVAL 60 DAYS PRECEDING AND CURRENT ROW) AS recent_diffs
    FROM observations_v WINDOW w AS (PARTITION BY monitor_id, pattern ORDER BY observed_at, diff_id ROWS UNBOUNDED PRECEDING)""",
    ("observations_v",),
)
cte(
    "state_v",
    """SELECT *, max(CASE WHEN promoted THEN observed_at END) OVER (PARTITION BY monitor_id, pattern ORDER BY observed_at, diff_id ROWS UNBOUNDED PRECEDING) AS promoted_at
    FROM (SELECT *, is_active AND NOT coalesce(prev_active AND pow(0.5, (epoch_us(observed_at) - epoch_us(prev_at)) / 86400000000.0 / 21.0) >= 0.2, false) AS promoted
    FROM (SELECT *, lag(is_active) OVER w AS prev_active, lag(observed_at) OVER w AS prev_at, lead(observed_at) OVER w AS valid_to
    FROM (SELECT *, NOT review_required AND support_count >= 3 AND confidence >= 0.78 AS is_active
    FROM (SELECT *, CAST(round(CAST(least(0.995, greatest(0.0, 0.45 * least(1.0, CAST(support_count AS DOUBLE) / greatest(recent_diffs, 1)) + 0.35 * avg_similarity + 0.2)) AS DECIMAL(18, 10)), 4) AS DOUBLE) AS confidence FROM history_v))
    WINDOW w AS (PARTITION BY monitor_id, pattern ORDER BY observed_at, diff_id)))""",
    ("history_v",),
)
oracle(
    "patterns_as_of",
    """SELECT d.diff_id, s.pattern FROM observations_v d JOIN state_v s ON d.monitor_id = s.monitor_id AND s.is_active AND s.observed_at < d.observed_at
    AND (s.valid_to IS NULL OR d.observed_at <= s.valid_to) AND pow(0.5, (epoch_us(d.observed_at) - epoch_us(s.observed_at)) / 86400000000.0 / 21.0) >= 0.2""",
    ("observations_v", "state_v"),
)
oracle(
    "pattern_history",
    """SELECT monitor_id, pattern, diff_id, support_count, round(avg_similarity, 6) AS avg_similarity, first_seen_at, review_required, latest_blocked_reason FROM history_v""",
    ("history_v",),
)
oracle("recent_diff_count", "SELECT diff_id, recent_diffs FROM history_v", ("history_v",))
oracle(
    "decay_score",
    f"SELECT diff_id, round(pow(0.5, greatest(epoch_us({LEARNED_AT}) - epoch_us(observed_at), 0) / 86400000000.0 / 21.0), 6) AS decay FROM observations_v",
    ("observations_v",),
)
oracle("pattern_confidence", "SELECT monitor_id, pattern, diff_id, recent_diffs, confidence FROM state_v", ("state_v",))
oracle(
    "pattern_state_resumed",
    """SELECT monitor_id, pattern, diff_id, support_count, round(avg_similarity, 6) AS avg_similarity, confidence, is_active, promoted, promoted_at, valid_to AS superseded_at FROM state_v""",
    ("state_v",),
)
ORACLES["stream_patterns"] = ORACLES["pattern_state_resumed"]
oracle("promote_patterns", "SELECT monitor_id, pattern, diff_id, is_active, promoted, promoted_at FROM state_v", ("state_v",))
oracle(
    "review_flags",
    "SELECT monitor_id, pattern, arg_max(review_required, observed_at) AS review_required, last(latest_blocked_reason ORDER BY observed_at) AS latest_blocked_reason FROM state_v GROUP BY 1, 2",
    ("state_v",),
)
oracle(
    "recent_examples",
    """SELECT monitor_id, pattern, diff_id, CAST(rn AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id, pattern ORDER BY observed_at DESC, diff_id DESC) AS rn
    FROM observations_v) WHERE rn <= 8""",
    ("observations_v",),
)
oracle(
    "record_usage",
    r"""SELECT diff_id AS monitor_id, diff_id, CASE WHEN b THEN '^Build\s+.+?$' ELSE '^visits:\s+.+?$' END AS pattern, CAST(count(*) AS INTEGER) AS count
    FROM marked_v WHERE is_noise AND (b OR v) GROUP BY 1, 2, 3""",
    ("marked_v",),
)
oracle(
    "usage_totals",
    "SELECT monitor_id, pattern, CAST(sum(count) AS BIGINT) AS total_lines_filtered, max(used_at) AS last_matched_at FROM filter_events_v GROUP BY 1, 2",
    ("filter_events_v",),
)
oracle(
    "tracked_events",
    """SELECT monitor_id, pattern, diff_id, count FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id, pattern ORDER BY used_at DESC, diff_id DESC) AS rn FROM filter_events_v)
    WHERE rn <= 5""",
    ("filter_events_v",),
)
oracle(
    "recent_filter_sum",
    f"""SELECT monitor_id, pattern, CAST(coalesce(sum(count) FILTER (used_at >= {USED_AT} - INTERVAL 7 DAYS), 0) AS BIGINT) AS lines_filtered_7d FROM filter_events_v GROUP BY 1, 2""",
    ("filter_events_v",),
)
cte(
    "summary_v",
    f"""SELECT s.monitor_id, count(*) AS learned_patterns,
    count(*) FILTER (is_active AND pow(0.5, greatest(epoch_us({LEARNED_AT}) - epoch_us(observed_at), 0) / 86400000000.0 / 21.0) >= 0.2) AS active_patterns,
    count(*) FILTER (review_required) AS manual_review_patterns, CAST(coalesce(sum(total), 0) AS BIGINT) AS total_lines_filtered,
    CAST(coalesce(sum(week), 0) AS BIGINT) AS lines_filtered_7d, CAST(round(CAST(avg(confidence) AS DECIMAL(18, 10)), 3) AS DOUBLE) AS avg_confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id, pattern ORDER BY observed_at DESC, diff_id DESC) AS rn FROM state_v) s
    LEFT JOIN (SELECT monitor_id, pattern, sum(count) AS total, sum(count) FILTER (used_at >= {USED_AT} - INTERVAL 7 DAYS) AS week
      FROM filter_events_v GROUP BY 1, 2) u ON s.monitor_id = u.monitor_id AND s.pattern = u.pattern
    WHERE rn = 1 GROUP BY s.monitor_id""",
    ("state_v", "filter_events_v"),
)
oracle(
    "summarize_patterns",
    """SELECT m.monitor_id, coalesce(learned_patterns, 0) AS learned_patterns, coalesce(active_patterns, 0) AS active_patterns,
    coalesce(manual_review_patterns, 0) AS manual_review_patterns, coalesce(total_lines_filtered, 0) AS total_lines_filtered,
    coalesce(lines_filtered_7d, 0) AS lines_filtered_7d, coalesce(avg_confidence, 0.0) AS avg_confidence
    FROM (SELECT DISTINCT user_id AS monitor_id FROM events) m LEFT JOIN summary_v s ON m.monitor_id = s.monitor_id""",
    ("summary_v",),
)
oracle(
    "learning_overview",
    """SELECT row_number() OVER (ORDER BY lines_filtered_7d DESC, learned_patterns DESC, avg_confidence DESC, m.monitor_id) AS place, m.monitor_id, name, learned_patterns, active_patterns, lines_filtered_7d, avg_confidence FROM monitors_v m JOIN summary_v s ON m.monitor_id = s.monitor_id
    WHERE deleted_at IS NULL""",
    ("monitors_v", "summary_v"),
)
oracle(
    "monitor_patterns",
    """SELECT s.monitor_id, s.pattern, s.confidence, CAST(coalesce(total, 0) AS BIGINT) AS total_lines_filtered, last_matched_at FROM
    (SELECT *, row_number() OVER (PARTITION BY monitor_id, pattern ORDER BY observed_at DESC, diff_id DESC) AS rn FROM state_v) s
    LEFT JOIN (SELECT monitor_id, pattern, sum(count) AS total, max(used_at) AS last_matched_at FROM filter_events_v GROUP BY 1, 2) u
      ON s.monitor_id = u.monitor_id AND s.pattern = u.pattern WHERE rn = 1""",
    ("state_v", "filter_events_v"),
)
oracle(
    "learning_run_stats",
    "SELECT diff_id, count(*) AS candidates, count(*) AS updated, count(*) FILTER (promoted) AS promoted, count(*) FILTER (blocked_reason IS NOT NULL) AS blocked FROM state_v GROUP BY diff_id",
    ("state_v",),
)

# ---- F ------------------------------------------------------------------------------------

_CUT = f"""CASE WHEN length(text) <= 1000 THEN text ELSE
    array_to_string(list_slice(string_split(text, chr(10)), 1, len(string_split(left(text, 1000), chr(10))) - 1), chr(10)) || {lit(k.TRUNCATION_MARK).replace(chr(10), "' || chr(10) || '")} END"""
oracle("truncate_diffs", f"SELECT doc_id, length(text) > 1000 AS was_truncated, sha256({_CUT}) AS text_hash FROM documents")
oracle(
    "build_prompts",
    f"""SELECT doc_id, sha256('**Competitor**: ' || CASE WHEN lang <> 'en' AND source <> '' THEN source ELSE 'Unknown' END || chr(10) || '**Page Type**: ' || lang || chr(10)
    || '**URL**: https://example.com/' || doc_id || chr(10)
    || CASE WHEN doc_id % 7 = 0 THEN {lit(k.TRUNCATION_NOTE).replace(chr(10), "' || chr(10) || '")} || chr(10) ELSE '' END
    || chr(10) || '**Changes Detected**:' || chr(10) || '```diff' || chr(10) || text || chr(10) || '```') AS prompt_hash FROM documents""",
)
oracle(
    "parse_responses",
    "SELECT diff_id, significance_level, summary, array_to_string(categories, ',') AS categories, needs_review FROM parsed_v",
    ("parsed_v",),
)
oracle(
    "default_analysis",
    "SELECT diff_id, summary, prompt_tokens, completion_tokens, total_cost_usd, error FROM parsed_v WHERE error IS NOT NULL",
    ("parsed_v",),
)
_LEVEL = " ".join(f"WHEN regexp_matches(text, '(?i)(^|[^\\w\\p{{L}}\\p{{N}}]){n}([^\\w\\p{{L}}\\p{{N}}]|$)') THEN '{n}'" for n in k.SEVERITIES)
oracle(
    "fallback_parse",
    f"""SELECT conv_id, turn, CASE {_LEVEL} ELSE 'medium' END AS level,
    CASE WHEN len(found) = 0 THEN 'other' ELSE array_to_string(found, ',') END AS categories, sha256({strip("text")}) AS summary_hash
    FROM (SELECT *, list_filter([{in_list(k.CATEGORIES)}], lambda x: contains(lower(text), x) OR contains(lower(text), replace(x, '_', ' '))) AS found FROM free_text_v)""",
    ("free_text_v",),
)
oracle(
    "classification_cost",
    """SELECT monitor_id, CAST(created_at AS DATE) AS day, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
    CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(total_cost_usd), 6) AS total_cost_usd FROM parsed_v GROUP BY 1, 2""",
    ("parsed_v",),
)
_PROMPT = """'**Competitor**: ' || m.competitor_name || chr(10) || '**Page Type**: ' || page_type || chr(10) || '**URL**: ' || url || chr(10) || chr(10)
    || '**Changes Detected**:' || chr(10) || '```diff' || chr(10) || CASE WHEN severity <> 'low' THEN summary ELSE severity END || chr(10) || '```'"""
oracle(
    "classification_inputs",
    f"SELECT diff_id, sha256({_PROMPT}) AS prompt_hash FROM analyses_v d JOIN monitors_v m ON d.monitor_id = m.monitor_id",
    ("analyses_v", "monitors_v"),
)
oracle(
    "build_analyses",
    """SELECT asked.diff_id, d.monitor_id, CASE WHEN found THEN significance_level END AS significance_level,
    CASE WHEN found THEN array_to_string(p.categories, ',') END AS categories, CASE WHEN found THEN needs_review END AS needs_review,
    CASE WHEN d.diff_id IS NULL THEN 'diff_not_found' WHEN m.monitor_id IS NULL THEN 'monitor_not_found' ELSE p.error END AS error
    FROM (SELECT event_id * 2 AS diff_id FROM events) asked LEFT JOIN analyses_v d ON asked.diff_id = d.diff_id
    LEFT JOIN monitors_v m ON d.monitor_id = m.monitor_id LEFT JOIN parsed_v p ON asked.diff_id = p.diff_id,
    LATERAL (SELECT d.diff_id IS NOT NULL AND m.monitor_id IS NOT NULL AS found)""",
    ("analyses_v", "monitors_v", "parsed_v"),
)
oracle(
    "alert_candidates",
    "SELECT diff_id, monitor_id, severity FROM analyses_v WHERE severity IN ('critical', 'high', 'medium')",
    ("analyses_v",),
)
oracle(
    "classify_with",
    f"""SELECT diff_id, (['critical', 'high', 'medium', 'low', 'noise'])[n % 5 + 1] AS significance_level, n || ' characters' AS summary,
    CAST(n // 4 AS INTEGER) AS prompt_tokens, round((n // 4) * CAST(3e-6 AS DOUBLE) + 20 * CAST(15e-6 AS DOUBLE), 6) AS total_cost_usd
    FROM (SELECT diff_id, length({_PROMPT}) AS n FROM analyses_v d JOIN monitors_v m ON d.monitor_id = m.monitor_id)""",
    ("analyses_v", "monitors_v"),
)

# ---- G ------------------------------------------------------------------------------------


def _normal(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\d+\\.?\\d*%?', '', 'g'), '\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}', '', 'g'), '\\s+', ' ', 'g'))"


oracle(
    "normalize_summary",
    f"SELECT diff_id, {_normal("summary || '  up 12.5% since 2024-01-02, now $' || monitor_id")} AS normalized FROM analyses_v",
    ("analyses_v",),
)
cte(
    "normal_alerts_v",
    f"SELECT *, {_normal('summary')} AS txt, {rank('severity')} AS sev FROM alerts_v",
    ("alerts_v",),
)
oracle(
    "same_summary_rule",
    """SELECT c.alert_id AS diff_id, EXISTS (SELECT 1 FROM normal_alerts_v h WHERE h.monitor_id = c.monitor_id AND h.txt = c.txt
      AND h.created_at + INTERVAL 1 HOUR <= c.created_at AND h.created_at + INTERVAL 1 HOUR >= c.created_at - INTERVAL 24 HOURS) AS same_summary
    FROM normal_alerts_v c""",
    ("normal_alerts_v",),
)
oracle(
    "severity_rule",
    f"""SELECT c.alert_id AS diff_id, CASE WHEN max(h.sev) IS NOT NULL THEN {NAME.format(c="max(h.sev)")} END AS recent_max, coalesce(any_value(c.sev) <= max(h.sev), false) AS not_above
    FROM normal_alerts_v c LEFT JOIN normal_alerts_v h ON h.monitor_id = c.monitor_id AND h.created_at + INTERVAL 1 HOUR <= c.created_at
      AND h.created_at + INTERVAL 1 HOUR >= c.created_at - INTERVAL 24 HOURS GROUP BY c.alert_id""",
    ("normal_alerts_v",),
)
cte(
    "oscillation_v",
    """SELECT snapshot_id, monitor_id, created_at, n_hashes, flips, n_hashes >= 4 AND d = 2 AND flips >= 4 AS oscillates
    FROM (SELECT *, CAST(len(h) AS INTEGER) AS n_hashes, len(list_distinct(h)) AS d,
      CAST(len(list_filter(range(1, len(h)), lambda i: h[i] <> h[i + 1])) AS INTEGER) AS flips
    FROM (SELECT *, list(text_hash) OVER (PARTITION BY monitor_id ORDER BY created_at, snapshot_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS h FROM snapshots_v))""",
    ("snapshots_v",),
)
oracle("oscillation_rule", "SELECT snapshot_id, oscillates, flips, n_hashes FROM oscillation_v", ("oscillation_v",))
# In this data an alert and its snapshot are one event, so the as-of look-up is an equality.
cte(
    "candidates_v",
    """SELECT a.monitor_id, a.alert_id AS id, a.created_at AS t, a.sev, a.severity, a.txt, o.oscillates, o.flips, o.n_hashes,
    row_number() OVER (PARTITION BY a.monitor_id ORDER BY a.created_at, a.alert_id) AS rn
    FROM normal_alerts_v a JOIN oscillation_v o ON a.alert_id = o.snapshot_id""",
    ("normal_alerts_v", "oscillation_v"),
)
# State: the created alerts of the last 24 h. `alive` is the state before the row, `kept` after it.
_STEP = """SELECT monitor_id, id, rn, severity, flips, n_hashes, mx, outcome,
      CASE WHEN outcome = 'created' THEN list_append(alive, {'t': t, 'sev': sev, 'txt': txt}) ELSE alive END AS kept
    FROM (SELECT *, CASE WHEN list_contains(list_transform(alive, lambda x: x.txt), txt) THEN 'same_summary' WHEN sev <= mx THEN 'severity'
        WHEN oscillates THEN 'oscillation' ELSE 'created' END AS outcome
      FROM (SELECT *, coalesce(list_max(list_transform(alive, lambda x: x.sev)), -1) AS mx FROM ({source})))"""
_START = """SELECT *, CAST([] AS STRUCT(t TIMESTAMP, sev INTEGER, txt VARCHAR)[]) AS alive FROM candidates_v WHERE rn = 1"""
_NEXT = """SELECT c.*, list_filter(p.kept, lambda x: x.t >= c.t - INTERVAL 24 HOURS) AS alive FROM replay p JOIN candidates_v c ON c.monitor_id = p.monitor_id AND c.rn = p.rn + 1"""
_REPLAY = f"+WITH replay AS ({_STEP.replace('{source}', _START)} UNION ALL {_STEP.replace('{source}', _NEXT)}) "
oracle(
    "suppress_alerts",
    _REPLAY
    + f"""SELECT id AS diff_id, outcome, CASE outcome WHEN 'same_summary' THEN 'Similar alert sent within last 24h'
    WHEN 'severity' THEN 'Severity ' || severity || ' does not exceed recent max (' || {NAME.format(c="mx")} || ')'
    WHEN 'oscillation' THEN 'Page oscillating between 2 states (' || flips || ' flips in last ' || n_hashes || ' snapshots)' END AS reason FROM replay""",
    ("candidates_v",),
    recursive=True,
)
oracle(
    "suppression_report",
    _REPLAY
    + """SELECT CASE WHEN outcome = 'created' THEN 'created' ELSE 'suppressed' END AS kind, CASE WHEN outcome = 'created' THEN severity ELSE outcome END AS label,
    count(*) AS n FROM replay GROUP BY 1, 2""",
    ("candidates_v",),
    recursive=True,
)

# ---- H ------------------------------------------------------------------------------------


def _keywords(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-zA-Z]+'), lambda x: length(x) > 2 AND NOT list_contains([{in_list(k.STOP_WORDS)}], x))))"


def _jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / {union} END"


_HALF = "CAST(ln(CAST(2 AS DOUBLE)) AS DOUBLE) / 4.0"


def _near(a: str, b: str) -> str:
    return f"exp(-(abs(epoch_us({a}) - epoch_us({b})) / CAST(3600000000 AS DOUBLE)) * (ln(CAST(2 AS DOUBLE)) / CAST(4 AS DOUBLE)))"


def _combined(near: str, category: str, keyword: str) -> str:
    return f"CAST(0.4 AS DOUBLE) * ({near}) + CAST(0.3 AS DOUBLE) * ({category}) + CAST(0.3 AS DOUBLE) * ({keyword})"


oracle(
    "extract_keywords",
    f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, sha256(array_to_string(w, ' ')) AS words_hash FROM (SELECT doc_id, {_keywords('text')} AS w FROM documents)",
)
oracle(
    "jaccard",
    f"""SELECT doc_id, round({_jaccard("w", "n")}, 6) AS score FROM (SELECT doc_id, {_keywords("text")} AS w,
    {_keywords("lang || ' ' || source || ' the and thereof with der'")} AS n FROM documents)""",
)
cte("keyed_alerts_v", f"SELECT *, {_keywords('summary')} AS keywords FROM alerts_v", ("alerts_v",))
oracle(
    "alert_similarity",
    f"""SELECT alert_id, previous_id, round({_combined("t", "c", "w")}, 6) AS combined, round(t, 6) AS temporal, round(c, 6) AS category, round(w, 6) AS keyword FROM
    (SELECT alert_id, p_id AS previous_id, {_near("created_at", "p_at")} AS t, {_jaccard("categories", "p_cat")} AS c, {_jaccard("keywords", "p_kw")} AS w FROM
    (SELECT *, lag(alert_id) OVER w AS p_id, lag(created_at) OVER w AS p_at, lag(categories) OVER w AS p_cat, lag(keywords) OVER w AS p_kw FROM keyed_alerts_v
    WINDOW w AS (PARTITION BY user_id, competitor_name ORDER BY created_at, alert_id)) WHERE p_id IS NOT NULL)""",
    ("keyed_alerts_v",),
)
oracle(
    "score_open_clusters",
    f"""SELECT alert_id, cluster_id, round(score, 6) AS score, score >= 0.45 AS merges FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY score DESC, opened) AS rn FROM
    (SELECT a.alert_id, c.alert_id AS cluster_id, c.created_at AS opened, {_combined(_near("a.created_at", "c.created_at"), _jaccard("a.categories", "c.categories"), _jaccard("a.keywords", "c.keywords"))} AS score
    FROM keyed_alerts_v a JOIN keyed_alerts_v c ON a.user_id = c.user_id AND a.competitor_name = c.competitor_name AND c.severity = 'critical' AND c.alert_id % 5 <> 0
    AND trim(a.competitor_name) <> '' AND c.created_at <= a.created_at AND c.created_at >= a.created_at - INTERVAL 48 HOURS)) WHERE rn = 1""",
    ("keyed_alerts_v",),
)
# Replay per (user, competitor): the state is the list of clusters touched in the last 48 h, oldest first.
cte(
    "ordered_alerts_v",
    """SELECT user_id, competitor_name, alert_id AS id, created_at AS t, categories AS cats, keywords AS kws,
    row_number() OVER (PARTITION BY user_id, competitor_name ORDER BY created_at, alert_id) AS rn FROM keyed_alerts_v WHERE trim(competitor_name) <> ''""",
    ("keyed_alerts_v",),
)
_ONE = "{'id': id, 'at': t, 'cats': cats, 'kws': kws}"
_FIRST = f"""SELECT user_id, competitor_name, id, rn, id AS cluster_id, CAST(NULL AS DOUBLE) AS merge_score, [{_ONE}] AS opened FROM ordered_alerts_v WHERE rn = 1"""
_SCORES = f"""list_transform(open, lambda x: {_combined(_near("t", "x.at"), _jaccard("cats", "x.cats"), _jaccard("kws", "x.kws"))})"""
_LATER = f"""SELECT user_id, competitor_name, id, rn, CASE WHEN best >= 0.45 THEN open[pos].id ELSE id END AS cluster_id, CASE WHEN best >= 0.45 THEN best END AS merge_score,
    CASE WHEN best >= 0.45 THEN list_transform(open, lambda x: CASE WHEN x.id = open[pos].id THEN
        {{'id': x.id, 'at': t, 'cats': list_distinct(list_concat(x.cats, cats)), 'kws': list_distinct(list_concat(x.kws, kws))}} ELSE x END)
      ELSE list_append(open, {_ONE}) END AS opened
    FROM (SELECT *, coalesce(list_max(scores), 0.0) AS best, list_position(scores, list_max(scores)) AS pos FROM (SELECT *, {_SCORES} AS scores FROM
      (SELECT a.*, list_filter(p.opened, lambda x: x.at >= a.t - INTERVAL 48 HOURS) AS open FROM replay p JOIN ordered_alerts_v a
       ON a.user_id = p.user_id AND a.competitor_name = p.competitor_name AND a.rn = p.rn + 1)))"""
oracle(
    "assign_clusters",
    f"""+WITH replay AS ({_FIRST} UNION ALL {_LATER}) SELECT a.alert_id, r.cluster_id, round(r.merge_score, 6) AS merge_score FROM alerts_v a LEFT JOIN replay r ON a.alert_id = r.id""",
    ("ordered_alerts_v",),
    recursive=True,
)
cte(
    "daily_v",
    """SELECT *, user_id || '/' || trim(competitor_name) || '/' || CAST(created_at AS DATE) AS cluster_id FROM keyed_alerts_v""",
    ("keyed_alerts_v",),
)
cte(
    "rollup_v",
    f"""SELECT cluster_id, max(sev) AS sev, count(*) AS alert_count, min(created_at) AS created_at, max(created_at) AS updated_at,
    array_to_string(list_sort(list_distinct(flatten(list(categories)))), ',') AS categories, array_to_string(list_sort(list_distinct(flatten(list(keywords)))), ',') AS keywords,
    trim(any_value(competitor_name)) AS competitor, first(categories[1] ORDER BY created_at, alert_id) AS first_category
    FROM (SELECT *, {rank("severity")} AS sev FROM daily_v) GROUP BY cluster_id""",
    ("daily_v",),
)
oracle(
    "cluster_rollup",
    f"SELECT cluster_id, {NAME.format(c='sev')} AS severity, alert_count, categories, keywords, created_at, updated_at FROM rollup_v",
    ("rollup_v",),
)
oracle(
    "cluster_title",
    """SELECT cluster_id, competitor || ' — ' || array_to_string(list_transform(string_split(first_category, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM rollup_v""",
    ("rollup_v",),
)

# ---- I ------------------------------------------------------------------------------------

cte(
    "routes_v",
    f"""SELECT a.*, s.channel, CASE WHEN digest_mode THEN 'digest' ELSE 'immediate' END AS route, CASE WHEN coalesce(digest_hour_utc, 0) = 0 THEN 9 ELSE digest_hour_utc END AS hour
    FROM alerts_v a JOIN settings_v s ON a.user_id = s.user_id WHERE notified_at IS NULL AND is_enabled AND {rank("severity")} >= {rank("min_severity")}""",
    ("alerts_v", "settings_v"),
)
oracle("route_alerts", "SELECT alert_id, channel, route FROM routes_v", ("routes_v",))
oracle(
    "unroutable_users",
    """SELECT monitor_id AS user_id, count(*) AS alerts, 'no_settings' AS reason FROM alerts_v WHERE notified_at IS NULL
    AND monitor_id NOT IN (SELECT user_id FROM users_v WHERE is_active) GROUP BY monitor_id""",
    ("alerts_v", "users_v"),
)
cte(
    "queued_v",
    """SELECT *, row_number() OVER (PARTITION BY user_id, channel, hour ORDER BY created_at, alert_id) AS place FROM routes_v WHERE route = 'digest'""",
    ("routes_v",),
)
oracle(
    "digest_queue",
    """SELECT user_id, channel, hour AS digest_hour_utc, CAST((place - 1) // 1000 AS INTEGER) AS part, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY place) AS alert_ids FROM queued_v GROUP BY 1, 2, 3, 4""",
    ("queued_v",),
)
oracle(
    "build_digests",
    """SELECT user_id, channel, part, alerts, sha256(CASE WHEN part = 0 THEN '📊 **Daily Digest** — ' || alerts || ' alert(s)' || chr(10) || chr(10) ELSE '' END || body) AS text_hash FROM
    (SELECT user_id, channel, CAST((place - 1) // 1000 AS INTEGER) AS part, any_value(n) AS alerts,
      string_agg('• [' || upper(severity) || '] ' || coalesce(name, 'Unknown') || ': ' || summary, chr(10) ORDER BY place) AS body
     FROM (SELECT q.*, m.name, count(*) OVER (PARTITION BY q.user_id, channel, hour) AS n FROM queued_v q LEFT JOIN monitors_v m ON q.monitor_id = m.monitor_id WHERE hour = 9)
     GROUP BY 1, 2, 3)""",
    ("queued_v", "monitors_v"),
)
_EMOJI = "CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' ELSE '⚪' END"
cte(
    "rendered_v",
    """SELECT r.*, m.name, m.page_type, m.url, CASE WHEN trim(r.competitor_name) = '' THEN 'Unknown Competitor' ELSE r.competitor_name END AS who,
    CASE WHEN trim(r.competitor_name) = '' THEN 'Unknown' ELSE r.competitor_name END AS short_who FROM routes_v r JOIN monitors_v m ON r.monitor_id = m.monitor_id""",
    ("routes_v", "monitors_v"),
)
oracle(
    "render_messages",
    f"""SELECT alert_id, channel, {_EMOJI} || ' [' || upper(severity) || '] Change detected on ' || who || ' (' || page_type || ')' AS chat_text,
    '[' || upper(severity) || '] Change detected on ' || short_who || ' - ' || page_type AS mail_subject,
    '[' || upper(severity) || '] Change Detected on ' || who || chr(10) || chr(10) || summary || chr(10) || chr(10) || 'Monitor: ' || name || chr(10) || 'Page Type: ' || page_type || chr(10)
    || 'Categories: ' || array_to_string(categories, ', ') || chr(10) || 'URL: ' || url || chr(10) || chr(10) || 'View details: https://dash.example.com/alerts/' || alert_id || chr(10)
    || '---' || chr(10) || 'Sent by changeflow' AS mail_plain FROM rendered_v""",
    ("rendered_v",),
)
_MD = "'{{\"type\":\"mrkdwn\",\"text\":' || to_json({0}) || '}}'"
_HTML_CELL = "'<tr><td><strong>{0}</strong></td><td>' || {1} || '</td></tr>'"


def _html(c: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = f"replace({c}, '{raw}', '{safe}')"
    return f"replace({c}, chr(39), '&#x27;')"


_FIELDS = " || ',' || ".join(
    _MD.format(c) for c in ("'*Page Type:* ' || page_type", "'*Monitor:* ' || name", "'*Categories:* ' || cats", "'*URL:* <' || url || '|View Page>'")
)
_CELLS = " || ".join(_HTML_CELL.format(t, _html(c)) for t, c in (("Monitor", "name"), ("Page Type", "page_type"), ("Categories", "cats"), ("URL", "url")))
_COLOR = "CASE severity WHEN 'critical' THEN '#DC2626' WHEN 'high' THEN '#EA580C' WHEN 'medium' THEN '#CA8A04' ELSE '#6B7280' END"
_LINK = "'https://dash.example.com/alerts/' || alert_id"
oracle(
    "render_payloads",
    f"""SELECT alert_id, channel, '{{"text":' || to_json({_EMOJI} || ' [' || upper(severity) || '] Change detected on ' || who || ' (' || page_type || ')') || ',"blocks":['
    || '{{"type":"header","text":{{"type":"plain_text","text":' || to_json({_EMOJI} || ' ' || upper(severity) || ': Change on ' || who) || '}}}},'
    || '{{"type":"section","text":' || {_MD.format("summary")} || '}},' || '{{"type":"section","fields":[' || {_FIELDS} || ']}},'
    || '{{"type":"actions","elements":[{{"type":"button","text":{{"type":"plain_text","text":"View Details"}},"url":' || to_json({_LINK}) || ',"style":"primary"}}]}}]}}' AS chat_payload,
    sha256('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><div style="background-color: ' || {_COLOR} || '"><h1>' || upper(severity) || ': Change Detected</h1><p>'
    || {_html("who")} || ' &mdash; ' || {_html("page_type")} || '</p></div><p>' || {_html("summary")} || '</p><table>' || {_CELLS} || '</table><a href="' || {_LINK}
    || '">View Details</a><p>Sent by changeflow</p></body></html>') AS html_hash FROM (SELECT *, array_to_string(categories, ', ') AS cats FROM rendered_v)""",
    ("rendered_v",),
)
cte(
    "deliveries_v",
    "SELECT attempt_id // 2 AS alert_id, CASE attempt_id % 2 WHEN 0 THEN 'slack' ELSE 'email' END AS channel, ok, error, attempted_at AS done_at FROM attempts_v",
    ("attempts_v",),
)
oracle(
    "fold_delivery",
    """SELECT alert_id, coalesce(bool_or(ok) FILTER (channel = 'slack'), false) AS notified_via_slack, coalesce(bool_or(ok) FILTER (channel = 'email'), false) AS notified_via_email,
    max(done_at) AS notified_at, string_agg(channel || ': ' || error, '; ' ORDER BY channel) FILTER (NOT ok) AS notification_error FROM deliveries_v GROUP BY alert_id""",
    ("deliveries_v",),
)
oracle(
    "settings_view",
    "SELECT user_id, channel, CAST(NULL AS VARCHAR) AS webhook_url, webhook_url IS NOT NULL AS slack_configured FROM settings_v",
    ("settings_v",),
)
oracle(
    "reject_settings",
    """SELECT user_id, channel, CASE WHEN channel = 'slack' AND webhook_url IS NULL AND is_enabled AND user_id % 2 <> 0 THEN 'webhook_required' END AS problem FROM settings_v""",
    ("settings_v",),
)

# ---- J ------------------------------------------------------------------------------------

oracle(
    "list_alerts",
    """SELECT alert_id, user_id, created_at FROM alerts_v WHERE severity = 'high' AND NOT is_acknowledged
    AND created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",
    ("alerts_v",),
)
oracle(
    "list_clusters",
    """SELECT d.cluster_id, d.alert_id, r.alert_count FROM daily_v d JOIN rollup_v r ON d.cluster_id = r.cluster_id WHERE r.competitor = 'comp3'""",
    ("daily_v", "rollup_v"),
)
oracle(
    "list_monitors",
    "SELECT monitor_id, name FROM monitors_v WHERE deleted_at IS NULL AND is_active AND (name ILIKE '%SITE1%' OR url ILIKE '%SITE1%')",
    ("monitors_v",),
)
oracle("list_diffs", "SELECT diff_id, monitor_id, original_lines FROM filtered_v WHERE NOT is_empty_after_filter", ("filtered_v",))
oracle("list_snapshots", "SELECT snapshot_id, monitor_id, version, created_at FROM versions_v", ("versions_v",))
_TYPED = "CAST(snapshot_id AS VARCHAR) AS snapshot_id, CAST(monitor_id AS VARCHAR) AS monitor_id, text_hash, CAST(length(text_hash) AS INTEGER) AS text_length, created_at"
oracle("read_table_snapshots", f"SELECT {_TYPED} FROM snapshots_v WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'", ("snapshots_v",))
oracle("stream_table_snapshots", f"SELECT {_TYPED} FROM snapshots_v", ("snapshots_v",))
oracle("append_stream_analyses", "SELECT diff_id, monitor_id, severity, created_at FROM analyses_v", ("analyses_v",))
ORACLES["classify_from_ledger"] = ORACLES["classify_with"]
oracle("paginate", "SELECT alert_id, created_at FROM alerts_v ORDER BY created_at DESC, alert_id LIMIT 50 OFFSET 100", ("alerts_v",))
oracle(
    "paginate_deep",
    """SELECT alert_id, created_at FROM (SELECT alert_id, created_at, row_number() OVER (ORDER BY created_at DESC, alert_id) AS place, count(*) OVER () AS n FROM alerts_v)
    WHERE place > 50 * greatest(CAST(ceil(n / 50.0) AS BIGINT) - 2, 0) AND place <= 50 * greatest(CAST(ceil(n / 50.0) AS BIGINT) - 1, 1)""",
    ("alerts_v",),
)
oracle(
    "page_totals",
    "SELECT user_id, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM alerts_v GROUP BY user_id",
    ("alerts_v",),
)
oracle(
    "owned_lookup",
    "SELECT snapshot_id, monitor_id FROM snapshots_v WHERE monitor_id IN (SELECT monitor_id FROM monitors_v WHERE deleted_at IS NULL)",
    ("snapshots_v", "monitors_v"),
)
oracle(
    "system_stats",
    """SELECT 'users' AS metric, count(*) AS value FROM users_v UNION ALL SELECT 'monitors_total', count(*) FROM monitors_v WHERE deleted_at IS NULL
    UNION ALL SELECT 'monitors_active', count(*) FROM monitors_v WHERE deleted_at IS NULL AND is_active UNION ALL SELECT 'alerts_total', count(*) FROM alerts_v
    UNION ALL SELECT 'alerts_unacknowledged', count(*) FROM alerts_v WHERE NOT is_acknowledged UNION ALL SELECT 'snapshots', count(*) FROM snapshots_v
    UNION ALL SELECT 'diffs', count(*) FROM documents UNION ALL SELECT 'analyses', count(*) FROM analyses_v""",
    ("users_v", "monitors_v", "alerts_v", "snapshots_v", "analyses_v"),
)
_BOUNDS = ", ".join(f"('{b}', CAST({b} AS DOUBLE))" for b in k.API_BUCKETS) + ", ('+Inf', CAST('Infinity' AS DOUBLE))"
oracle(
    "duration_histogram",
    f"""SELECT method, path, status, le, count(*) FILTER (seconds <= bound) AS n, count(*) AS count, round(sum(seconds), 6) AS sum
    FROM request_log_v, (VALUES {_BOUNDS}) AS b(le, bound) GROUP BY method, path, status, le""",
    ("request_log_v",),
)
oracle(
    "labelled_counters",
    """SELECT 'scrape_success_total' AS metric, 'render_method=' || render_method AS labels, CAST(count(*) AS DOUBLE) AS value FROM attempts_v WHERE ok GROUP BY 2
    UNION ALL SELECT 'scrape_failure_total', 'render_method=' || render_method || ',error_type=' || split_part(error, ':', 1), CAST(count(*) AS DOUBLE) FROM attempts_v WHERE NOT ok GROUP BY 2
    UNION ALL SELECT 'model_tokens_total', 'type=prompt', CAST(sum(prompt_tokens) AS DOUBLE) FROM parsed_v
    UNION ALL SELECT 'model_tokens_total', 'type=completion', CAST(sum(completion_tokens) AS DOUBLE) FROM parsed_v
    UNION ALL SELECT 'alert_created_total', 'severity=' || severity, CAST(count(*) AS DOUBLE) FROM alerts_v GROUP BY 2
    UNION ALL SELECT 'notification_sent_total', 'channel=' || channel || ',status=' || CASE WHEN ok THEN 'success' ELSE 'failure' END, CAST(count(*) AS DOUBLE) FROM deliveries_v GROUP BY 2""",
    ("attempts_v", "parsed_v", "alerts_v", "deliveries_v"),
)
oracle(
    "rate_limit_flags",
    """SELECT request_id, nth, nth > 1 AS rejected FROM (SELECT request_id, row_number() OVER (PARTITION BY client, date_trunc('minute', ts) ORDER BY ts, request_id) AS nth
    FROM request_log_v WHERE path NOT LIKE '/api/v1/health%')""",
    ("request_log_v",),
)
oracle(
    "noise_share_report",
    """SELECT count(*) AS diffs, count(*) FILTER (is_empty_after_filter) AS noise_only_diffs, CAST(sum(original_lines) AS BIGINT) AS changed_lines,
    CAST(sum(noise_lines_removed) AS BIGINT) AS noise_lines, round(100.0 * sum(noise_lines_removed) / sum(original_lines), 4) AS noise_percent FROM filtered_v""",
    ("filtered_v",),
)

oracle(
    "pipeline_report",
    """SELECT unnest(['pages_monitored', 'snapshots_processed', 'diffs_computed', 'changes_detected', 'changed_lines', 'noise_lines_removed', 'noise_percent', 'alerts_created']) AS metric,
    unnest([(SELECT count(*) FILTER (deleted_at IS NULL) FROM monitors_v)::DOUBLE, (SELECT count(*) FROM versions_v)::DOUBLE, count(*)::DOUBLE,
      count(*) FILTER (NOT is_empty_after_filter)::DOUBLE, sum(original_lines)::DOUBLE, sum(noise_lines_removed)::DOUBLE,
      round(100.0 * sum(noise_lines_removed) / sum(original_lines), 4)::DOUBLE, (SELECT count(*) FROM alerts_v)::DOUBLE]) AS value FROM filtered_v""",
    ("monitors_v", "versions_v", "filtered_v", "alerts_v"),
)

# ---- K ------------------------------------------------------------------------------------

_OLD = {"snapshots": k.SNAPSHOT_DAYS, "diffs": k.DIFF_DAYS, "analyses": k.ANALYSIS_DAYS}
oracle(
    "apply_retention",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, diff_id FROM observations_v WHERE observed_at >= {RETAINED_AT} - INTERVAL {d} DAYS" for n, d in _OLD.items()
    ),
    ("observations_v",),
)
oracle(
    "retention_counts",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, count(*) FILTER (observed_at < {RETAINED_AT} - INTERVAL {d} DAYS) AS deleted,
        count(*) FILTER (observed_at >= {RETAINED_AT} - INTERVAL {d} DAYS) AS kept FROM observations_v"""
        for n, d in _OLD.items()
    ),
    ("observations_v",),
)
cte("gone_v", f"SELECT monitor_id FROM monitors_v WHERE deleted_at < {DUE_AT} - INTERVAL 30 DAYS", ("monitors_v",))
oracle(
    "purge_deleted",
    """SELECT 'snapshots' AS table_name, snapshot_id AS id FROM snapshots_v WHERE monitor_id NOT IN (SELECT monitor_id FROM gone_v)
    UNION ALL SELECT 'monitors', monitor_id FROM monitors_v WHERE monitor_id NOT IN (SELECT monitor_id FROM gone_v)""",
    ("snapshots_v", "monitors_v", "gone_v"),
)
oracle(
    "purge_counts",
    """SELECT 'monitors' AS table_name, count(*) AS deleted FROM gone_v UNION ALL SELECT 'snapshots', count(*) FROM snapshots_v WHERE monitor_id IN (SELECT monitor_id FROM gone_v)
    UNION ALL SELECT 'alerts', count(*) FROM alerts_v WHERE monitor_id IN (SELECT monitor_id FROM gone_v)""",
    ("snapshots_v", "alerts_v", "gone_v"),
)
oracle(
    "fold_deletions",
    """SELECT m.monitor_id, CASE event_type WHEN 'error' THEN false WHEN 'signup' THEN true ELSE is_active END AS is_active,
    CASE event_type WHEN 'error' THEN ts WHEN 'signup' THEN NULL ELSE deleted_at END AS deleted_at, CASE event_type WHEN 'signup' THEN ts ELSE next_check_at END AS next_check_at
    FROM monitors_v m LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events WHERE event_type IN ('error', 'signup')) WHERE rn = 1) e
    ON m.monitor_id = e.user_id""",
    ("monitors_v",),
)
oracle(
    "acknowledge_alerts",
    """SELECT a.alert_id, is_acknowledged OR clicked_at IS NOT NULL AS is_acknowledged, clicked_at AS acknowledged_at FROM alerts_v a
    LEFT JOIN (SELECT event_id + user_id AS alert_id, min(ts) AS clicked_at FROM events WHERE event_type = 'click' GROUP BY 1) c ON a.alert_id = c.alert_id""",
    ("alerts_v",),
)
oracle(
    "resolve_clusters",
    """SELECT r.cluster_id, seen IS NOT NULL AS is_resolved, seen AS resolved_at FROM rollup_v r
    LEFT JOIN (SELECT cluster_id, min(created_at) AS seen FROM daily_v WHERE is_acknowledged GROUP BY 1) s ON r.cluster_id = s.cluster_id""",
    ("daily_v", "rollup_v"),
)
oracle(
    "dedupe_signups",
    """SELECT email_normalized, first(c_custkey ORDER BY created_at, c_custkey) AS signup_id, count(*) AS requests FROM
    (SELECT lower(c_mktsegment) || '+' || c_nationkey || '@example.com' AS email_normalized, c_custkey, c_custkey * 7919 % 100000 AS created_at FROM customer) GROUP BY 1""",
)

# ---- L: the streams must give what the batch rules give --------------------------------------

ORACLES["stream_pairs"] = ORACLES["pair_snapshots"]
ORACLES["pair_snapshots_resumed"] = ORACLES["pair_snapshots"]
ORACLES["stream_diffs"] = ORACLES["diff_snapshots"]
oracle("stream_suppress", _REPLAY + "SELECT id AS diff_id, outcome FROM replay", ("candidates_v",), recursive=True)
oracle(
    "stream_clusters",
    f"+WITH replay AS ({_FIRST} UNION ALL {_LATER}) SELECT a.alert_id, r.cluster_id, round(r.merge_score, 6) AS merge_score FROM alerts_v a LEFT JOIN replay r ON r.id = a.alert_id",
    ("ordered_alerts_v", "alerts_v"),
    recursive=True,
)
oracle(
    "stream_rate_limit",
    """SELECT client, minute, requests, greatest(0, requests - 1) AS rejected FROM (SELECT client, date_trunc('minute', ts) AS minute, count(*) AS requests
    FROM request_log_v WHERE path NOT LIKE '/api/v1/health%' GROUP BY 1, 2)""",
    ("request_log_v",),
)
oracle("stream_dedupe", "SELECT snapshot_id, monitor_id, text_hash, created_at FROM snapshots_v", ("snapshots_v",))
ORACLES["stream_digest"] = ORACLES["build_digests"]
