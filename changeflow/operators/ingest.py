"""Pages, monitors and fetch attempts: extraction, fingerprints, scheduling, validation."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions import constants as k
from changeflow.functions import ranks, scans
from changeflow.functions.text import matches, micros, trim_ws

VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset([*k.DROPPED_TAGS, "template"])
_SIMPLE = re.compile(r"^(?P<tag>\*|[a-zA-Z][\w-]*)?(?P<marks>(?:[.#][\w-]+)*)$")


def _selector_parts(selector: str | None):
    """A descendant chain of tag/.class/#id compounds, or None when it is anything else."""
    parts = []
    for piece in (selector or "").split():
        found = _SIMPLE.match(piece)
        if not found:
            return None
        marks = re.findall(r"[.#][\w-]+", found["marks"])
        tag = (found["tag"] or "*").lower()
        parts.append((tag, {m[1:] for m in marks if m[0] == "."}, {m[1:] for m in marks if m[0] == "#"}))
    return parts or None


class _TextCollector(HTMLParser):
    """Collects visible text nodes, and those below the first element a selector picks."""

    def __init__(self, parts):
        super().__init__(convert_charrefs=True)
        self.parts = parts
        self.stack: list[tuple[str, set, str]] = []
        self.hidden = 0
        self.inside = None  # stack depth of the picked element while it is open
        self.picked: list[str] | None = None
        self.all: list[str] = []

    def _is_picked(self) -> bool:
        wanted = list(self.parts)
        for depth, (tag, classes, ident) in enumerate(reversed(self.stack)):
            want_tag, want_classes, want_ids = wanted[-1]
            if want_tag in ("*", tag) and want_classes <= classes and want_ids <= {ident}:
                wanted.pop()
                if not wanted:
                    return True
            elif depth == 0:
                return False
        return False

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        self.stack.append((tag, set((attributes.get("class") or "").split()), attributes.get("id") or ""))
        self.hidden += tag in _UNSEEN
        if self.parts and self.picked is None and not self.hidden and self._is_picked():
            self.picked, self.inside = [], len(self.stack)
        if tag in VOID_TAGS:
            self._close_to(len(self.stack) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self._close_to(depth)
                return

    def _close_to(self, depth: int):
        while len(self.stack) > depth:
            self.hidden -= self.stack.pop()[0] in _UNSEEN
        if self.inside is not None and len(self.stack) < self.inside:
            self.inside = None

    def handle_data(self, data):
        text = data.strip()
        if text and not self.hidden:
            self.all.append(text)
            if self.inside is not None:
                self.picked.append(text)


def visible_text(html: str | None, selector: str | None = None) -> str:
    if not html:
        return ""
    collector = _TextCollector(_selector_parts(selector))
    collector.feed(html)
    collector.close()
    return "\n".join(collector.all if collector.picked is None else collector.picked)


@F.pandas_udf(T.StringType())
def _visible_text(html: pd.Series, selector: pd.Series) -> pd.Series:
    return pd.Series([visible_text(h, s) for h, s in zip(html, selector)], dtype=object)


def normalize_page_text(c: Column) -> Column:
    """At most one blank line in a row, single spaces, no blank ends."""
    return trim_ws(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), " +", " "))


def extract_page_text(pages: DataFrame, html_col: str = "raw_html", selector_col: str | None = None) -> DataFrame:
    """Add `extracted_text`. Parsing is per page in Arrow batches; the clean-up is native."""
    selector = F.col(selector_col) if selector_col else F.lit(None).cast("string")
    return pages.withColumn("extracted_text", normalize_page_text(_visible_text(F.col(html_col), selector)))


def fingerprint_text(df: DataFrame, text_col: str = "extracted_text") -> DataFrame:
    return df.withColumns({"text_hash": F.sha2(F.col(text_col), 256), "text_length": F.length(text_col)})


def flag_js_pages(
    df: DataFrame, html_col: str = "raw_html", text_col: str = "extracted_text", at_col: str | None = None
) -> DataFrame:
    """`needs_rendering`: hardly any text and a noscript block. With `at_col`, also when to look again."""
    flag = (F.length(text_col) < k.JS_PAGE_MIN_CHARS) & F.lower(html_col).contains("<noscript")
    out = df.withColumn("needs_rendering", flag)
    if at_col:
        again = F.col(at_col) + F.expr(f"INTERVAL {k.JS_RECHECK_MINUTES} MINUTES")
        out = out.withColumn("recheck_at", F.when(F.col("needs_rendering"), again))
    return out


def flag_bot_pages(df: DataFrame, text_col: str = "extracted_text") -> DataFrame:
    short = F.length(text_col) <= k.BOT_PAGE_MAX_CHARS
    return df.withColumn("is_bot_page", short & matches(F.col(text_col), k.BOT_PAGE_PATTERN))


def due_monitors(monitors: DataFrame, now: Column, batch_size: int = k.SCRAPE_BATCH_SIZE) -> DataFrame:
    """Live monitors to check, oldest first, with their place in line and batch number.

    The place is a global rank over range partitions (`functions/ranks.py`): no task sees all
    rows, however many are due in one hour.
    """
    due = monitors.filter(
        F.col("is_active") & F.col("deleted_at").isNull() & (F.col("next_check_at") <= now)
    )
    placed = ranks.ranked(due, ["next_check_at", "monitor_id"], "place")
    return placed.withColumn("batch_no", F.floor((F.col("place") - 1) / batch_size))


def skip_recent(monitors: DataFrame, now: Column, minutes: int = k.RECENT_MINUTES, force: bool = False) -> DataFrame:
    if force:
        return monitors
    age = micros(now) - micros(F.col("last_checked_at"))
    return monitors.filter(F.col("last_checked_at").isNull() | (age >= minutes * 60_000_000))


def attempt_streaks(attempts: DataFrame, id_col: str = "attempt_id") -> DataFrame:
    """Per attempt: how many failures in a row it closes (0 for a success)."""
    order = ["attempted_at", id_col]
    days = [scans.by_time("attempted_at")]
    counted = scans.scan(attempts, ["monitor_id"], order, days, _n=scans.count())
    # The count only grows, so its value at the latest success is a running maximum.
    reset = scans.scan(counted, ["monitor_id"], order, days, _n_at_ok=scans.highest(F.when(F.col("ok"), F.col("_n"))))
    streak = F.col("_n") - F.coalesce("_n_at_ok", F.lit(0))
    return reset.withColumn("consecutive_failures", streak.cast("int")).drop("_n", "_n_at_ok")


def fold_attempts(
    attempts: DataFrame, interval_hours: int = 6, id_col: str = "attempt_id", pause_after: int = k.PAUSE_AFTER_FAILURES, max_error: int | None = None
) -> DataFrame:
    """State of each monitor after its attempt log; the last error whole, or its first `max_error` characters.

    Only narrow columns are scanned; of the errors, each task passes on the last one of a monitor.
    """
    newest = F.struct("attempted_at", id_col)
    streaks = attempt_streaks(attempts.select(id_col, "monitor_id", "attempted_at", "ok"), id_col)
    last = F.struct("ok", "attempted_at", "consecutive_failures")
    state = streaks.groupBy("monitor_id").agg(
        F.max_by(last, newest).alias("_last"),
        F.max(F.when(F.col("ok"), F.col("attempted_at"))).alias("last_checked_at"),
        F.max("consecutive_failures").alias("worst_streak"),
        F.count(F.lit(1)).alias("attempts"),
    )
    errors = attempts.groupBy("monitor_id").agg(F.max_by(F.struct("error"), newest).alias("_error"))
    folded = state.join(errors, "monitor_id").withColumn("last", F.struct("_last.*", "_error.error"))
    return folded.select(
        "monitor_id",
        "attempts",
        F.when(F.col("last.ok"), "success").otherwise("failed").alias("last_status"),
        F.when(~F.col("last.ok"), F.col("last.error") if max_error is None else F.substring("last.error", 1, max_error)).alias("last_error"),
        F.col("last.consecutive_failures").alias("consecutive_failures"),
        (F.col("last.consecutive_failures") >= pause_after).alias("auto_paused"),
        "worst_streak",
        "last_checked_at",
        (F.col("last.attempted_at") + F.expr(f"INTERVAL {interval_hours} HOURS")).alias("next_check_at"),
    )


def choose_fetch_route(attempts: DataFrame) -> DataFrame:
    """Which way each attempt went, from what the log says happened."""
    rescued = F.col("has_fallback") & F.col("fallback_ok")
    route = (
        F.when(F.col("use_override") & F.col("has_fallback"), F.when(F.col("fallback_ok"), "override").otherwise("failed"))
        .when(~F.col("primary_ok") & rescued, "fallback_after_error")
        .when(~F.col("primary_ok"), "failed")
        .when(F.col("bot_page") & rescued, "fallback_after_bot_page")
        .otherwise("primary")
    )
    return attempts.withColumn("route", route)


# ---- validation --------------------------------------------------------------


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# fixed values: special-purpose IPv4 blocks, as prefixes of a dotted address
_PRIVATE_IPV4 = (
    r"^(?:(?:0|10|127)\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.0\.[02]\.|192\.168\.|198\.1[89]\.|"
    r"198\.51\.100\.|203\.0\.113\.|(?:24\d|25[0-5])\.)"
)
# fixed values: loopback, mapped, unique-local, link-local and documentation IPv6 prefixes
_PRIVATE_IPV6 = r"^(?:::|f[cd]|fe[89ab]|2001:db8|::ffff:)"


def _private_ipv4(host: Column) -> Column:
    """True for a dotted IPv4 literal in a private, loopback, link-local or reserved block."""
    return host.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") & host.rlike(_PRIVATE_IPV4)


def url_problem(url: Column) -> Column:
    """Why a URL must not be fetched, or null. Literal checks only: names are not resolved."""
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    bracketed = F.lower(F.regexp_extract(bare, r"^\[([^\]]*)\]", 1))
    host = F.lower(F.when(bare.startswith("["), bracketed).otherwise(F.regexp_replace(bare, r":.*$", "")))
    private_ipv6 = bare.startswith("[") & host.rlike(_PRIVATE_IPV6)
    return (
        F.when(~scheme.isin("http", "https"), "scheme_not_allowed")
        .when(F.length(host) == 0, "no_hostname")
        .when(host.isin("localhost", "127.0.0.1", "::1", "0.0.0.0"), "localhost")
        .when(_private_ipv4(host) | private_ipv6, "private_or_reserved_address")
    )


def _compiles(pattern: str | None) -> bool:
    try:
        re.compile(pattern or "")
        return True
    except (re.error, OverflowError, RecursionError):
        return False


@F.pandas_udf(T.BooleanType())
def compiles(pattern: pd.Series) -> pd.Series:
    verdict = {p: _compiles(p) for p in pattern.unique()}
    return pattern.map(verdict).astype(bool)


def pattern_problems(patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """One row per distinct pattern with the first problem found, or null. Only distinct patterns reach Python."""
    p = F.col(pattern_col)
    return patterns.select(p.alias("pattern")).distinct().withColumn("_ok", compiles("pattern")).select(
        "pattern",
        F.when(F.length("pattern") > k.MAX_PATTERN_CHARS, "pattern_too_long")
        .when(F.col("pattern").rlike(k.NESTED_QUANTIFIER_PATTERN), "nested_quantifiers")
        .when(~F.col("_ok"), "pattern_does_not_compile")
        .alias("pattern_problem"),
    )


def validate_monitors(
    monitors: DataFrame, max_monitors: int = k.MAX_MONITORS_PER_USER, slices: list[Column] | None = None
) -> DataFrame:
    """Check monitors in order of creation; add `is_valid` and the first failing `reason`.

    A monitor counts against the user's limit, and blocks its URL for that user, only
    when it was itself accepted. Order of checks: field bounds, limit, URL, duplicate,
    patterns.
    """
    slices = slices or [scans.by_time("created_at")]
    bounds = F.when(~F.length("name").between(1, 255), "bad_name")
    if "competitor_name" in monitors.columns:
        bounds = bounds.when(F.length("competitor_name") > 255, "bad_competitor_name")
    if "css_selector" in monitors.columns:
        bounds = bounds.when(F.length("css_selector") > 1000, "bad_selector")
    bounds = bounds.when(~F.col("page_type").isin(k.PAGE_TYPES), "bad_page_type").when(
        ~F.col("check_interval_hours").between(1, 168), "bad_interval"
    )
    checked = monitors.withColumns({"_bounds": bounds, "_url": url_problem(F.col("url")), "_pattern": F.lit(None).cast("string")})

    if "noise_patterns" in monitors.columns:
        listed = monitors.select("monitor_id", F.posexplode("noise_patterns").alias("_pos", "pattern"))
        first_bad = (
            listed.join(pattern_problems(listed), "pattern")
            .filter(F.col("pattern_problem").isNotNull())
            .groupBy("monitor_id")
            .agg(F.min_by("pattern_problem", "_pos").alias("_found"))
        )
        checked = checked.join(first_bad, "monitor_id", "left").withColumn(
            "_pattern", F.when(F.size("noise_patterns") > 50, "too_many_patterns").otherwise(F.col("_found"))
        ).drop("_found")

    live = F.col("deleted_at").isNull()
    sound = live & F.coalesce("_bounds", "_url", "_pattern").isNull()
    order = ["created_at", "monitor_id"]
    # First sound row of each (user, url): the only one of its URL that can be accepted.
    first = checked.filter(sound).groupBy("user_id", "url").agg(F.min(F.struct(*order)).alias("_first"))
    marked = checked.join(first, ["user_id", "url"], "left").withColumn(
        "_candidate", sound & (F.struct(*order) == F.col("_first"))
    )
    ranked = scans.scan(marked, ["user_id"], order, slices, _taken=scans.count(F.when(F.col("_candidate"), 1)))
    before = F.col("_taken") - F.col("_candidate").cast("long")
    reason = (
        F.when(~live, "deleted")
        .when(F.col("_bounds").isNotNull(), F.col("_bounds"))
        .when(before >= max_monitors, "monitor_limit")
        .when(F.col("_url").isNotNull(), F.col("_url"))
        .when(F.col("_first") < F.struct(*order), "duplicate_url")
        .otherwise(F.col("_pattern"))
    )
    return ranked.select(*monitors.columns, reason.alias("reason")).withColumn("is_valid", F.col("reason").isNull())
