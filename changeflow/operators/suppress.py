"""Alert suppression: same summary, severity not above the recent maximum, oscillating page."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions import constants as k
from changeflow.functions import replay, scans
from changeflow.functions.text import PY_FLAGS, collapse_ws, hours, lookup, micros, severity_name, severity_rank

WINDOW = hours(k.SUPPRESS_HOURS)


def normalize_summary(c: Column) -> Column:
    """Lower case without numbers, dates and repeated blanks: equal for alerts of one kind."""
    text = F.regexp_replace(F.lower(c), PY_FLAGS + r"\d+\.?\d*%?", "")
    text = F.regexp_replace(text, PY_FLAGS + r"\d{4}[-/]\d{2}[-/]\d{2}", "")
    return collapse_ws(text)


# ---- rules against a given alert history -----------------------------------------


def _with_history(candidates: DataFrame, history: DataFrame, keys: list[str], extra: dict[str, Column]) -> DataFrame:
    """Candidates and history in one time line: history rows sort before a candidate of the same instant."""
    old = history.select(
        "monitor_id", F.lit(None).cast(candidates.schema["diff_id"].dataType).alias("diff_id"), "created_at",
        *[c.alias(n) for n, c in extra.items()], F.lit(0).alias("_side"), F.col("alert_id").alias("_row"),
    )
    new = candidates.select(
        "monitor_id", "diff_id", "created_at", *[c.alias(n) for n, c in extra.items()],
        F.lit(1).alias("_side"), F.col("diff_id").alias("_row"),
    )
    return old.unionByName(new)


def same_summary_rule(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """(diff_id, same_summary): a stored alert of the monitor, at most 24 h old, reads the same.

    Needs only the time of the latest alert with that text, so no pairs are formed.
    """
    merged = _with_history(candidates, history, ["monitor_id"], {"_text": normalize_summary(F.col("summary"))})
    seen = scans.scan(
        merged,
        ["monitor_id", "_text"],
        ["created_at", "_side", "_row"],
        [scans.by_time("created_at")],
        _last=scans.highest(F.when(F.col("_side") == 0, F.col("created_at"))),
    )
    recent = micros(F.col("_last")) >= micros(F.col("created_at")) - WINDOW
    return seen.filter("_side = 1").select("diff_id", F.coalesce(recent, F.lit(False)).alias("same_summary"))


def severity_rule(candidates: DataFrame, history: DataFrame, severity_col: str = "severity") -> DataFrame:
    """(diff_id, recent_max, not_above): the highest severity stored in the last 24 h, and whether it stands.

    One latest-time column per severity replaces the range join.
    """
    merged = _with_history(candidates, history, ["monitor_id"], {"_rank": severity_rank(F.col(severity_col))})
    seen = scans.scan(
        merged,
        ["monitor_id"],
        ["created_at", "_side", "_row"],
        [scans.by_time("created_at")],
        **{
            f"_last{rank}": scans.highest(F.when((F.col("_side") == 0) & (F.col("_rank") == rank), F.col("created_at")))
            for rank in k.SEVERITY_ORDER.values()
        },
    )
    cutoff = micros(F.col("created_at")) - WINDOW
    top = F.greatest(*[F.when(micros(F.col(f"_last{r}")) >= cutoff, F.lit(r)) for r in k.SEVERITY_ORDER.values()])
    return seen.filter("_side = 1").select(
        "diff_id", severity_name(top).alias("recent_max"), F.coalesce(F.col("_rank") <= top, F.lit(False)).alias("not_above"),
        top.isNotNull().alias("_any"),
    ).withColumn("recent_max", F.when(F.col("_any"), F.col("recent_max"))).drop("_any")


def _hash_scan(scanned, snapshots: DataFrame, slices: list[Column] | None, carry: DataFrame | None) -> DataFrame:
    return scanned(
        snapshots.select("monitor_id", "snapshot_id", "text_hash", "created_at").filter(F.col("text_hash").isNotNull()),
        ["monitor_id"],
        ["created_at", "snapshot_id"],
        slices or [scans.by_time("created_at")],
        carry,
        prev=scans.before(F.col("text_hash"), k.OSCILLATION_WINDOW - 1),
    )


def oscillation_flags(snapshots: DataFrame, slices: list[Column] | None = None, carry: DataFrame | None = None) -> DataFrame:
    """Per snapshot: whether the newest six hashes up to it flip between two states, with counts."""
    seen = _hash_scan(scans.scan, snapshots, slices, carry)
    hashes = F.concat("prev", F.array("text_hash"))
    n = F.size("hashes")
    flips = F.size(
        F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.element_at("hashes", i) != F.element_at("hashes", i + 1))
    )
    return (
        seen.withColumn("hashes", hashes)
        .withColumn("n_hashes", n)
        .withColumn("flips", F.when(n > 1, flips).otherwise(0))
        .withColumn(
            "oscillates",
            (n >= k.OSCILLATION_MIN_HASHES) & (F.size(F.array_distinct("hashes")) == 2) & (F.col("flips") >= k.OSCILLATION_MIN_FLIPS),
        )
        .drop("prev", "hashes")
    )


_FLAG = "struct<oscillates:boolean,flips:int,n_hashes:int>"


def _flag_rows(snapshots: DataFrame, carry: DataFrame | None) -> DataFrame:
    flagged = snapshots if "oscillates" in snapshots.columns else oscillation_flags(snapshots, carry=carry)
    return flagged.select(
        "monitor_id", "created_at", F.lit(0).alias("_side"), F.col("snapshot_id").alias("diff_id"),
        F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("text"),
        F.struct("oscillates", "flips", "n_hashes").cast(_FLAG).alias("_flag"),
    )


def _flag_scan(scanned, rows: DataFrame, carry: DataFrame | None) -> DataFrame:
    return scanned(rows, ["monitor_id"], ["created_at", "_side", "diff_id"], [scans.by_time("created_at")], carry, _seen=scans.latest(F.col("_flag")))


def oscillation_at(candidates: DataFrame, snapshots: DataFrame, before: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per candidate: `oscillates`, `flips` and `n_hashes` of the latest snapshot up to its time (as-of, by one scan).

    Keeps monitor_id, diff_id, created_at, rank and text of the candidates. `snapshots` may have
    their `oscillation_flags` already. `before` (from `oscillation_carry`) holds the newest hashes
    and flags of earlier runs.
    """
    before = before or {}
    asked = candidates.select(
        "monitor_id", "created_at", F.lit(1).alias("_side"), "diff_id", "rank", "text", F.lit(None).cast(_FLAG).alias("_flag"),
    )
    seen = _flag_scan(scans.scan, _flag_rows(snapshots, before.get("hashes")).unionByName(asked), before.get("flags"))
    return seen.filter("_side = 1").select(
        "monitor_id", "diff_id", "created_at", "rank", "text",
        F.coalesce("_seen.oscillates", F.lit(False)).alias("oscillates"),
        F.coalesce("_seen.flips", F.lit(0)).alias("flips"),
        F.coalesce("_seen.n_hashes", F.lit(0)).alias("n_hashes"),
    )


def oscillation_carry(snapshots: DataFrame, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Per monitor, for a later `oscillation_at`: the newest hashes, and the flag of the last snapshot."""
    before = before or {}
    return {
        "hashes": _hash_scan(scans.carry_of, snapshots, None, before.get("hashes")),
        "flags": _flag_scan(scans.carry_of, _flag_rows(snapshots, before.get("hashes")), before.get("flags")),
    }


# ---- the chain: only alerts that were created count as history --------------------

CREATED, SAME, BELOW, FLIPS = 0, 1, 2, 3
OUTCOMES = {CREATED: "created", SAME: "same_summary", BELOW: "severity", FLIPS: "oscillation"}


def outcome_name(code: Column) -> Column:
    return lookup(code, OUTCOMES, None)


def suppress_run(times: list[int], ranks: list[int], texts: list[str], flips: list[bool], alive: list[list]) -> tuple[list[int], list[int]]:
    """Decide one monitor's candidates in time order; `alive` holds the alerts of the last 24 h and is brought up to date.

    Returns outcomes and the recent maximum rank (-1: none). An alert is created only when its
    severity exceeds every alive one, so at most one per severity is alive, in rising order:
    the last has the maximum, the first expires first.
    """
    outcomes, recent = [], []
    for t, rank, text, flip in zip(times, ranks, texts, flips, strict=True):
        while alive and alive[0][0] < t - WINDOW:
            del alive[0]
        top = alive[-1][1] if alive else -1
        recent.append(top)
        if any(a[2] == text for a in alive):
            outcomes.append(SAME)
        elif rank <= top:
            outcomes.append(BELOW)
        elif flip:
            outcomes.append(FLIPS)
        else:
            outcomes.append(CREATED)
            alive.append([t, rank, text])
    return outcomes, recent


class SuppressFold:
    """The rules as a fold: the state is the alerts alive, as text [[time, rank, summary], ..]."""

    columns = ["rank", "text", "oscillates", "flips", "n_hashes"]
    outputs = "_outcome int, _recent int, _flips int, _n_hashes int"

    def fresh(self) -> list[list]:
        return []

    def run(self, times: list[int], ids: list, columns: dict[str, list], state: list[list]) -> list[list]:
        return [*suppress_run(times, columns["rank"], columns["text"], columns["oscillates"], state), columns["flips"], columns["n_hashes"]]

    def expire(self, state: list[list], at: int) -> list[list]:
        return [a for a in state if a[0] >= at - WINDOW]

    def pack(self, state: list[list]) -> str:
        return json.dumps(state)

    def unpack(self, text: str) -> list[list]:
        return json.loads(text)


def decide_alerts(
    candidates: DataFrame, snapshots: DataFrame, severity_col: str = "severity", partitions: int | None = None,
    slice_rows: int | None = None, start: DataFrame | None = None, before: dict[str, DataFrame] | None = None,
) -> tuple[DataFrame, replay.Replayed]:
    """`suppress_alerts`, and the replay behind it: how many rounds it took and the states it ended with.

    `start` (monitor_id, state) continues an earlier replay, `before` (from `oscillation_carry`)
    its view of the pages.
    """
    narrow = candidates.select(
        "monitor_id", "diff_id", "created_at",
        severity_rank(F.col(severity_col)).alias("rank"), normalize_summary(F.col("summary")).alias("text"),
    )
    flagged = oscillation_at(narrow, snapshots, before).withColumns({"t": micros(F.col("created_at")), "row_id": F.col("diff_id")})
    sizes = candidates.select("monitor_id", micros(F.col("created_at")).alias("t"))
    replayed = replay.replay(flagged, ["monitor_id"], SuppressFold(), sizes, start, slice_rows, partitions)
    decided = replayed.rows.drop("monitor_id").withColumnRenamed("row_id", "diff_id")
    reason = (
        F.when(F.col("_outcome") == SAME, f"Similar alert sent within last {k.SUPPRESS_HOURS}h")
        .when(
            F.col("_outcome") == BELOW,
            F.format_string("Severity %s does not exceed recent max (%s)", F.col(severity_col), severity_name(F.col("_recent"))),
        )
        .when(
            F.col("_outcome") == FLIPS,
            F.format_string("Page oscillating between 2 states (%d flips in last %d snapshots)", F.col("_flips"), F.col("_n_hashes")),
        )
    )
    out = (
        candidates.join(decided, "diff_id")
        .withColumns({"outcome": outcome_name(F.col("_outcome")), "reason": reason})
        .select(*candidates.columns, "outcome", "reason")
    )
    return out, replayed


def suppress_alerts(
    candidates: DataFrame, snapshots: DataFrame, severity_col: str = "severity", partitions: int | None = None, slice_rows: int | None = None
) -> DataFrame:
    """Add `outcome` (created, same_summary, severity, oscillation) and `reason` to every candidate.

    The rules feed back on their own result, so a monitor is replayed in order. What is
    replayed is narrow (no texts beyond the normalised one), and a monitor with many
    candidates is cut into slices of equal numbers of rows that are replayed side by side
    until their states agree (`functions/replay.py`). The state is at most five alerts.
    """
    return decide_alerts(candidates, snapshots, severity_col, partitions, slice_rows)[0]


def created_alerts(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("outcome") == "created").drop("outcome", "reason")


def suppression_report(decided: DataFrame, severity_col: str = "severity") -> DataFrame:
    """Created by severity and suppressed by rule, in long form."""
    label = F.when(F.col("outcome") == "created", F.col(severity_col)).otherwise(F.col("outcome"))
    kind = F.when(F.col("outcome") == "created", "created").otherwise("suppressed")
    return decided.groupBy(kind.alias("kind"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
