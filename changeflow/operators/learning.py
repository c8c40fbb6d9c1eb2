"""Adaptive noise learning: replacement pairs, candidate patterns, their history and summaries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions import constants as k
from changeflow.functions import ranks, scans
from changeflow.functions.similarity import matching_runs, similarity
from changeflow.functions.text import PY_FLAGS, collapse_ws, days, matches, micros, steady_round, string_array

_TOKEN = re.compile(r"\s+|\S+")


def replacement_pairs(lines: DataFrame) -> DataFrame:
    """(diff_id, seq, before, after): each added line with the removed line it replaces.

    Inside a block (between context lines and hunk borders) the oldest unmatched removed
    line is taken first. The count of added lines that found none is a running maximum,
    so this needs no loop and no order of signs. Everything is placed by diff once.

    In diffs in hunks (`diff_hunks`) the removed lines of a block come before the added ones, so
    the n-th added line replaces the n-th removed one; the pairs are made inside the row.
    """
    if "replaced" in lines.columns:
        return lines.select("diff_id", F.inline("replaced"))
    if "hunks" in lines.columns:
        return lines.select("diff_id", F.inline(_replaced(F.col("hunks"))))
    by_diff = Window.partitionBy("diff_id").orderBy("seq")
    placed = lines.repartition("diff_id")
    breaks = (F.col("op") == " ") | ~F.col("hunk_no").eqNullSafe(F.lag("hunk_no").over(by_diff))
    blocks = placed.withColumn("_break", breaks.cast("int")).withColumn("_block", F.sum("_break").over(by_diff))
    changed = blocks.filter(F.col("op").isin("+", "-")).withColumn("_content", collapse_ws(F.col("text")))
    changed = changed.filter(F.length("_content") > 0)

    by_block = Window.partitionBy("diff_id", "_block").orderBy("seq")
    upto = by_block.rowsBetween(Window.unboundedPreceding, 0)
    counted = changed.withColumn("_removed", F.count_if(F.col("op") == "-").over(upto)).withColumn(
        "_added", F.count_if(F.col("op") == "+").over(upto)
    )
    unmatched = F.greatest(F.lit(0), F.max(F.col("_added") - F.col("_removed")).over(upto))
    walked = counted.withColumn("_missed", unmatched).withColumn("_missed_before", F.lag("_missed", 1, 0).over(by_block))
    place = F.when(F.col("op") == "-", F.col("_removed")).when(
        F.col("_missed") == F.col("_missed_before"), F.col("_added") - F.col("_missed")
    )
    return (
        walked.withColumn("_place", place)
        .filter(F.col("_place").isNotNull())
        .groupBy("diff_id", "_block", "_place")
        .agg(
            F.max(F.when(F.col("op") == "+", F.col("seq"))).alias("seq"),
            F.max(F.when(F.col("op") == "-", F.col("_content"))).alias("before"),
            F.max(F.when(F.col("op") == "+", F.col("_content"))).alias("after"),
        )
        .filter(F.col("before").isNotNull() & F.col("after").isNotNull())
        .select("diff_id", "seq", "before", "after")
    )


def replaced_lines(diffs: DataFrame, carry: tuple[str, ...] = ("monitor_id", "created_at"), learns: Column | None = None) -> DataFrame:
    """Diffs in hunks to (diff_id, carry.., replaced): the pairs of each that `candidate_patterns` looks at.

    A row per diff, for `observe_patterns`; `learns` says which diffs can be learned from, the others get no pairs.
    """
    tested = F.filter(_replaced(F.col("hunks")), lambda p: _may_propose(p["before"], p["after"]))
    return diffs.select("diff_id", *carry, (tested if learns is None else F.when(learns, tested)).alias("replaced"))


def _may_propose(before: Column, after: Column) -> Column:
    shorter, both = F.least(F.length(before), F.length(after)), F.length(before) + F.length(after)
    return (before != after) & (2 * shorter >= k.MIN_SIMILARITY * both)


def _replaced(hunks: Column) -> Column:
    def content(rows: Column) -> Column:
        seen = F.transform(rows, lambda s: F.struct(s["seq"].alias("seq"), collapse_ws(s["text"]).alias("content")))
        return F.filter(seen, lambda s: F.length(s["content"]) > 0)

    def pairs_of(h: Column, b: Column) -> Column:
        sides = F.struct(
            content(F.slice(h["lines"], b["at"] + 1, b["removed"])).alias("old"), content(F.slice(h["lines"], b["at"] + b["removed"] + 1, b["added"])).alias("new")
        )
        # A row of both sides first, so that each is made once.
        def zipped(s: Column) -> Column:
            both = F.zip_with(s["old"], s["new"], lambda o, n: F.struct(n["seq"].alias("seq"), o["content"].alias("before"), n["content"].alias("after")))
            return F.filter(both, lambda p: p["before"].isNotNull() & p["after"].isNotNull())

        return F.flatten(F.transform(F.array(sides), zipped))

    def of_hunk(h: Column) -> Column:
        replaced = F.filter(h["blocks"], lambda b: (b["removed"] > 0) & (b["added"] > 0))
        return F.flatten(F.transform(replaced, lambda b: pairs_of(h, b)))

    return F.flatten(F.transform(hunks, of_hunk))


def propose_pattern(before: str, after: str):
    """(pattern, template, similarity) for a pair of lines, or None."""
    alike = similarity(before, after, k.MIN_SIMILARITY)
    if alike is None:
        return None
    old, new = _TOKEN.findall(before), _TOKEN.findall(after)
    regex, words, fixed_chars, gaps = "", [], 0, 0
    seen_old = seen_new = 0
    for a, b, size in [*matching_runs(old, new), (len(old), len(new), 0)]:
        if a > seen_old or b > seen_new:
            gaps += 1
            regex += ".+?"
            if not words or words[-1] != "{var}":
                words.append("{var}")
        same = old[a : a + size]
        regex += "".join(r"\s+" if token.isspace() else re.escape(token) for token in same)
        solid = [token for token in same if not token.isspace()]
        if solid:
            words.append(" ".join(solid))
            fixed_chars += sum(map(len, solid))
        seen_old, seen_new = a + size, b + size
    if not gaps or fixed_chars < k.MIN_LITERAL_CHARS:
        return None
    return f"^{regex}$", " ".join(words), alike


_PROPOSAL = T.StructType(
    [
        T.StructField("pattern", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)


@F.pandas_udf(_PROPOSAL)
def _proposals(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    known = {}
    rows = []
    for pair in zip(before, after):
        if pair not in known:
            known[pair] = propose_pattern(*pair) or (None, None, None)
        rows.append(known[pair])
    return pd.DataFrame(rows, columns=["pattern", "template", "similarity"])


def candidate_patterns(pairs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(diff_id, pattern, template, similarity, before, after): first pair per pattern of a diff.

    Equality is tested natively, and so is a bound that only needs the lengths; a pair that
    recurs in many diffs reaches Python once. With `max_chars`, pairs with a longer line are
    left out.
    """
    if max_chars is not None:
        pairs = pairs.filter((F.length("before") <= max_chars) & (F.length("after") <= max_chars))
    tested = pairs.filter(_may_propose(F.col("before"), F.col("after")))
    proposed = tested.select("before", "after").distinct().withColumn("_p", _proposals("before", "after"))
    known = proposed.select("before", "after", "_p.*").filter(F.col("pattern").isNotNull())
    found = tested.select("diff_id", "seq", "before", "after").join(known, ["before", "after"])
    first = F.min_by(F.struct("template", "similarity", "before", "after"), "seq")
    return found.groupBy("diff_id", "pattern").agg(first.alias("_first")).select("diff_id", "pattern", "_first.*")


def safeguard_reason(before: Column, after: Column, competitor: Column | None = None) -> Column:
    """Why a pair must not be learned on its own, or null; the first of four tests that fires."""
    both = F.concat_ws(" ", before, after)
    lower = F.lower(both)
    token = r"[a-zA-Z][a-zA-Z0-9_-]+"
    business = lower.rlike(PY_FLAGS + r"\b(" + "|".join(k.BUSINESS_TERMS) + r")\b") & lower.rlike(PY_FLAGS + r"\d")
    protected = string_array(k.PROTECTED_WORDS)
    if competitor is not None:
        names = F.regexp_extract_all(F.lower(F.coalesce(competitor, F.lit(""))), F.lit(token), F.lit(0))
        protected = F.concat(protected, F.filter(names, lambda x: F.length(x) > 2))
    touched = F.array_min(F.array_intersect(F.regexp_extract_all(lower, F.lit(token), F.lit(0)), protected))
    return (
        F.when(matches(both, k.PRICE_PATTERN), "price_or_percentage_signal")
        .when(business, "digit_adjacent_business_term")
        .when(matches(both, k.ACTION_PATTERN), "change_action_word")
        .when(touched.isNotNull(), F.concat(F.lit("protected_token:"), touched))
    )


def _gate_scan(scanned, snapshots: DataFrame, carry: DataFrame | None) -> DataFrame:
    rows = snapshots.select("monitor_id", "snapshot_id", "created_at")
    return scanned(rows, ["monitor_id"], ["created_at", "snapshot_id"], [scans.by_time("created_at")], carry, snapshots_seen=scans.count())


def gate_carry(snapshots: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """How many snapshots each monitor has had, for a later `learning_gate`."""
    return _gate_scan(scans.carry_of, snapshots, carry)


def learning_gate(diffs: DataFrame, snapshots: DataFrame, pair_counts: DataFrame | None = None, carry: DataFrame | None = None) -> DataFrame:
    """Add `snapshots_seen` and `skip_reason` (null: learn from it) to diffs named after their snapshot.

    `pair_counts` is (diff_id, pairs); leave it out when only diffs with pairs matter.
    `diffs` may carry `changed_lines`; 0 means an empty diff. `carry` (from `gate_carry`)
    counts snapshots of earlier runs.
    """
    seen = _gate_scan(scans.scan, snapshots, carry).select(F.col("snapshot_id").alias("diff_id"), "snapshots_seen")
    empty = F.col("changed_lines") == 0 if "changed_lines" in diffs.columns else F.lit(False)
    reason = F.when(empty, "empty_diff").when(
        F.coalesce("snapshots_seen", F.lit(0)) < k.MIN_SNAPSHOTS_FOR_LEARNING, "insufficient_snapshot_history"
    )
    gated = diffs.join(seen, "diff_id", "left")
    if pair_counts is not None:
        gated = gated.join(pair_counts, "diff_id", "left")
        reason = reason.when(F.coalesce("pairs", F.lit(0)) == 0, "no_replacement_pairs")
    return gated.withColumn("skip_reason", reason).drop("pairs")


def observe_patterns(
    lines: DataFrame, diffs: DataFrame, snapshots: DataFrame, monitors: DataFrame | None = None, carry: DataFrame | None = None
) -> DataFrame:
    """`pattern_observations` from unfiltered diff lines, or diffs in hunks, or their `replaced_lines`. `diffs` is (diff_id, monitor_id, created_at)."""
    gate = learning_gate(diffs.select("diff_id", "monitor_id", "created_at"), snapshots, carry=carry)
    ready = gate.filter(F.col("skip_reason").isNull()).select("diff_id", "monitor_id", F.col("created_at").alias("observed_at"))
    if "hunks" in lines.columns or "replaced" in lines.columns:  # replaced lines are few beside all lines, so only they meet the gate
        pairs = replacement_pairs(lines).join(ready.select("diff_id"), "diff_id", "left_semi")
    else:
        pairs = replacement_pairs(lines.join(ready.select("diff_id"), "diff_id", "left_semi"))
    found = candidate_patterns(pairs).join(ready, "diff_id")
    competitor = None
    if monitors is not None:
        found = found.join(monitors.select("monitor_id", "competitor_name"), "monitor_id")
        competitor = F.col("competitor_name")
    reason = safeguard_reason(F.col("before"), F.col("after"), competitor)
    return found.withColumn("blocked_reason", reason).select(
        "monitor_id", "diff_id", "pattern", "template", "similarity", "before", "after", "blocked_reason", "observed_at"
    )


# ---- scores -------------------------------------------------------------------


def decay_score(last_seen: Column, now: Column) -> Column:
    age_days = F.greatest(micros(now) - micros(last_seen), F.lit(0)) / 86_400_000_000
    return F.pow(F.lit(0.5), age_days / k.DECAY_HALF_LIFE_DAYS)


def confidence(support: Column, avg_similarity: Column, recent_diffs: Column, decay: Column) -> Column:
    ratio = F.least(F.lit(1.0), support / F.greatest(recent_diffs, F.lit(1)))
    score = 0.45 * ratio + 0.35 * avg_similarity + 0.20 * decay
    return steady_round(F.least(F.lit(0.995), F.greatest(F.lit(0.0), score)), 4)


_PATTERN_KEY = ["monitor_id", "pattern"]
_PATTERN_ORDER = ["observed_at", "diff_id"]


def _by_day() -> list[Column]:
    return [scans.by_time("observed_at")]


def _once_per_diff(observations: DataFrame) -> DataFrame:
    """A diff counts once per pattern: its first observation."""
    rest = [c for c in observations.columns if c not in (*_PATTERN_KEY, "diff_id")]
    return (
        observations.groupBy(*_PATTERN_KEY, "diff_id")
        .agg(F.min_by(F.struct(*rest), "observed_at").alias("_row"))
        .select(*_PATTERN_KEY, "diff_id", "_row.*")
    )


def _history_tracks() -> dict[str, scans.Track]:
    return {
        "support_count": scans.count(),
        "_similarity": scans.total(F.col("similarity")),
        "first_seen_at": scans.lowest(F.col("observed_at")),
        "_blocked": scans.count(F.col("blocked_reason")),
        "latest_blocked_reason": scans.latest(F.col("blocked_reason")),
    }


def pattern_history(observations: DataFrame) -> DataFrame:
    """Running support, mean similarity, first seen and review state per observation.

    Review is sticky; the blocked reason is the latest one.
    """
    history = scans.scan(_once_per_diff(observations), _PATTERN_KEY, _PATTERN_ORDER, _by_day(), **_history_tracks())
    return history.withColumns(
        {"avg_similarity": F.col("_similarity") / F.col("support_count"), "review_required": F.col("_blocked") > 0}
    ).drop("_similarity", "_blocked")


def recent_diff_count(diffs: DataFrame, lookback_days: int = k.LOOKBACK_DAYS, tail: DataFrame | None = None) -> DataFrame:
    """Diffs of the same monitor in the last 60 days, inclusive, counting the diff itself.

    `tail` (from `recent_tail`) holds diffs of earlier runs that are still in reach; they are
    counted, but get no row.
    """
    rows = diffs.select("monitor_id", "diff_id", "created_at")
    counted = rows
    if tail is not None:
        counted = rows.withColumn("_new", F.lit(True)).unionByName(tail.select(*rows.columns).withColumn("_new", F.lit(False)))
    out = scans.count_back(counted, ["monitor_id"], "created_at", "diff_id", days(lookback_days), scans.by_time, "recent_diffs")
    return out if tail is None else out.filter("_new").drop("_new")


def recent_tail(diffs: DataFrame, tail: DataFrame | None = None, lookback_days: int = k.LOOKBACK_DAYS) -> DataFrame:
    """(monitor_id, diff_id, created_at): diffs that a later one of the monitor may still count."""
    rows = diffs.select("monitor_id", "diff_id", "created_at")
    rows = rows if tail is None else rows.unionByName(tail.select(*rows.columns))
    newest = rows.groupBy("monitor_id").agg(F.max("created_at").alias("_newest"))
    near = micros(F.col("created_at")) >= micros(F.col("_newest")) - days(lookback_days)
    return rows.join(newest, "monitor_id").filter(near).select(*rows.columns)


def _may_activate(review: Column, support: Column, score: Column) -> Column:
    return ~review & (support >= k.MIN_SUPPORT) & (score >= k.MIN_CONFIDENCE)


def _state_tracks() -> dict[str, scans.Track]:
    return {
        **_history_tracks(),
        "_prev": scans.before(F.struct("observed_at", "recent_diffs")),
        "superseded_at": scans.following(F.col("observed_at")),
    }


def _promoted_track() -> dict[str, scans.Track]:
    return {"promoted_at": scans.latest(F.when(F.col("promoted"), F.col("observed_at")))}


def pattern_state(observations: DataFrame, diffs: DataFrame, before: dict[str, DataFrame] | None = None) -> DataFrame:
    """The stored state of every pattern after each of its observations.

    At an observation the pattern was just seen, so its decay is 1 there; it may have
    decayed since the observation before, which ends an active spell. The state before is
    worked out from the same running sums less this row, so one scan gives both.
    `superseded_at` is the time of the next observation of the pattern.

    `before` (from `pattern_carry`) holds what earlier runs leave behind: the state then goes
    on from there, and only new observations are read.
    """
    before = before or {}
    recent = recent_diff_count(diffs, tail=before.get("recent")).select("monitor_id", "diff_id", "recent_diffs")
    observed = (
        _once_per_diff(observations)
        .join(recent, ["monitor_id", "diff_id"], "left")
        .withColumn("recent_diffs", F.coalesce("recent_diffs", F.lit(0)))
    )
    seen = scans.scan(observed, _PATTERN_KEY, _PATTERN_ORDER, _by_day(), before.get("history"), **_state_tracks())
    n, similarity, blocked = F.col("support_count"), F.col("_similarity"), F.col("_blocked")
    prev = F.try_element_at("_prev", F.lit(-1))
    score_before = confidence(n - 1, (similarity - F.col("similarity")) / F.nullif(n - 1, F.lit(0)), prev["recent_diffs"], F.lit(1.0))
    review_before = blocked - F.col("blocked_reason").isNotNull().cast("int") > 0
    undecayed = decay_score(prev["observed_at"], F.col("observed_at")) >= k.MIN_DECAY
    scored = seen.withColumns(
        {
            "avg_similarity": similarity / n,
            "review_required": blocked > 0,
            "confidence": confidence(n, similarity / n, F.col("recent_diffs"), F.lit(1.0)),
            "_was_active": F.coalesce(_may_activate(review_before, n - 1, score_before) & undecayed, F.lit(False)),
        }
    ).withColumn("is_active", _may_activate(F.col("review_required"), n, F.col("confidence")))
    marked = scored.withColumn("promoted", F.col("is_active") & ~F.col("_was_active")).drop(
        "_prev", "_was_active", "_similarity", "_blocked"
    )
    return scans.scan(marked, _PATTERN_KEY, _PATTERN_ORDER, _by_day(), before.get("promoted"), **_promoted_track())


def pattern_carry(state: DataFrame, diffs: DataFrame, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """What a later `pattern_state` goes on from, out of the (stored) state and diffs of this run.

    history and promoted: one row per pattern. recent: diffs of the last 60 days of each
    monitor. open: the last state of each pattern, which is in force until it is superseded.
    """
    before = before or {}
    rest = [c for c in state.columns if c not in _PATTERN_KEY]
    states = state if "open" not in before else before["open"].select(*state.columns).unionByName(state)
    last = states.groupBy(*_PATTERN_KEY).agg(F.max_by(F.struct(*rest), F.struct(*_PATTERN_ORDER)).alias("_row"))
    return {
        "history": scans.carry_of(state, _PATTERN_KEY, _PATTERN_ORDER, _by_day(), before.get("history"), **_state_tracks()),
        "promoted": scans.carry_of(state, _PATTERN_KEY, _PATTERN_ORDER, _by_day(), before.get("promoted"), **_promoted_track()),
        "recent": recent_tail(diffs, before.get("recent")),
        "open": last.select(*_PATTERN_KEY, "_row.*").select(*state.columns),
    }


def superseded_states(open_states: DataFrame, state: DataFrame) -> DataFrame:
    """`open_states` with `superseded_at` set where this run's state has a successor: corrections of stored rows."""
    first = state.groupBy(*_PATTERN_KEY).agg(F.min("observed_at").alias("_next"))
    joined = open_states.join(first, _PATTERN_KEY, "left")
    return joined.withColumn("superseded_at", F.coalesce("superseded_at", "_next")).select(*open_states.columns)


def latest_state(state: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per pattern; with `now`, decay at that time and its effect on `is_active`."""
    rest = [c for c in state.columns if c not in _PATTERN_KEY]
    last = (
        state.groupBy(*_PATTERN_KEY)
        .agg(F.max_by(F.struct(*rest), F.struct(*_PATTERN_ORDER)).alias("_row"))
        .select(*_PATTERN_KEY, "_row.*")
        .withColumnRenamed("observed_at", "last_seen_at")
    )
    if now is None:
        return last
    return last.withColumn("decay_score", decay_score(F.col("last_seen_at"), now)).withColumn(
        "is_active", F.col("is_active") & (F.col("decay_score") >= k.MIN_DECAY)
    )


def recent_diff_ids(observations: DataFrame, n: int = k.MAX_DIFF_IDS) -> DataFrame:
    """The newest `n` diffs of each pattern, ranked by recency."""
    return recent_examples(observations.select(*_PATTERN_KEY, "diff_id", "observed_at").distinct(), n)


def recent_examples(observations: DataFrame, n: int = k.MAX_EXAMPLES) -> DataFrame:
    """The newest `n` observations of each pattern, ranked by recency."""
    return scans.newest(observations, _PATTERN_KEY, _PATTERN_ORDER, _by_day(), n)


# ---- use of learned patterns ---------------------------------------------------


def record_usage(diffs: DataFrame) -> DataFrame:
    """`filter_events` from the hit maps of filtered diffs."""
    return diffs.select(
        "monitor_id", "diff_id", F.col("created_at").alias("at"), F.explode("learned_hits").alias("pattern", "count")
    ).filter(F.col("count") > 0)


def usage_totals(events: DataFrame) -> DataFrame:
    return events.groupBy(*_PATTERN_KEY).agg(
        F.sum("count").alias("total_lines_filtered"), F.max("at").alias("last_matched_at")
    )


def tracked_events(events: DataFrame, n: int = k.MAX_FILTER_EVENTS) -> DataFrame:
    """The newest `n` events per pattern, for a caller who keeps only so many; sums are taken over all."""
    return scans.newest(events, _PATTERN_KEY, ["at", "diff_id"], [scans.by_time("at")], n).drop("recency")


def recent_filter_sum(events: DataFrame, now: Column, within_days: int = 7) -> DataFrame:
    recent = micros(F.col("at")) >= micros(now) - days(within_days)
    return events.groupBy(*_PATTERN_KEY).agg(
        F.coalesce(F.sum(F.when(recent, F.col("count"))), F.lit(0)).alias("lines_filtered_7d")
    )


def with_usage(latest: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Latest pattern rows with their usage; zeros where a pattern was never used."""
    return (
        latest.join(usage_totals(events), _PATTERN_KEY, "left")
        .join(recent_filter_sum(events, now), _PATTERN_KEY, "left")
        .fillna(0, ["total_lines_filtered", "lines_filtered_7d"])
    )


def summarize_patterns(used: DataFrame, monitors: DataFrame | None = None) -> DataFrame:
    """Per monitor counts; with `monitors`, those without any pattern appear with zeros."""
    summary = used.groupBy("monitor_id").agg(
        F.count(F.lit(1)).alias("learned_patterns"),
        F.count_if("is_active").alias("active_patterns"),
        F.count_if("review_required").alias("manual_review_patterns"),
        F.sum("total_lines_filtered").alias("total_lines_filtered"),
        F.sum("lines_filtered_7d").alias("lines_filtered_7d"),
        steady_round(F.avg("confidence"), 3).alias("avg_confidence"),
    )
    if monitors is None:
        return summary
    counts = [c for c in summary.columns if c != "monitor_id"]
    return monitors.select("monitor_id").join(summary, "monitor_id", "left").fillna(0, counts)


def learning_overview(summary: DataFrame, monitors: DataFrame, user_id=None) -> DataFrame:
    """Live monitors that have patterns, with their summary and `place` in `OVERVIEW_ORDER`."""
    live = monitors.filter(F.col("deleted_at").isNull())
    if user_id is not None:
        live = live.filter(F.col("user_id") == user_id)
    items = live.select("monitor_id", "user_id", "name", "competitor_name").join(summary.filter("learned_patterns > 0"), "monitor_id")
    return ranks.ranked(items, OVERVIEW_ORDER)


OVERVIEW_ORDER = ["lines_filtered_7d desc", "learned_patterns desc", "avg_confidence desc", "monitor_id"]


def monitor_patterns(used: DataFrame, monitor_id=None) -> DataFrame:
    """Patterns of one monitor (or of each), most trusted first."""
    if monitor_id is not None:
        used = used.filter(F.col("monitor_id") == monitor_id)
    return used.orderBy("monitor_id", F.desc("confidence"), "pattern")


def learning_run_stats(state: DataFrame) -> DataFrame:
    """Per diff: candidates, promoted and blocked. Every candidate updates its pattern."""
    return state.groupBy("diff_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count(F.lit(1)).alias("updated"),
        F.count_if("promoted").alias("promoted"),
        F.count_if(F.col("blocked_reason").isNotNull()).alias("blocked"),
    )
