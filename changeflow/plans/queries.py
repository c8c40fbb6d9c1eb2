"""Every operator as a query on the benchmark tables: name -> (spark, sf_dir) -> DataFrame.

Arrays come out as sorted, joined strings and doubles rounded to six places, so that
results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import change, classify, cluster, ingest, learning, lifecycle, noise, notify, reports, suppress
from changeflow.plans import monitoring
from changeflow.plans.storage import cut_lineage, new_folder
from changeflow.sources import adapters as a
from changeflow.sources.tables import append_once, append_stream, read_table, stream_table, upsert_state, write_table
from changeflow.streaming import stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DUE_AT = "TIMESTAMP_NTZ '2024-01-15 00:00:00'"
LEARNED_AT = "TIMESTAMP_NTZ '2024-11-20 00:00:00'"
USED_AT = "TIMESTAMP_NTZ '2024-01-25 00:00:00'"
RETAINED_AT = "TIMESTAMP_NTZ '2025-01-15 00:00:00'"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def joined(name: str):
    return F.array_join(F.array_sort(name), ",").alias(name)


# ---- A. sources and sinks ----------------------------------------------------------


def _snapshot_table(spark, sf, name: str) -> str:
    """The snapshots as a canonical table in date folders."""
    rows = a.snapshots(spark, sf).select(
        F.col("snapshot_id").cast("string").alias("snapshot_id"), F.col("monitor_id").cast("string").alias("monitor_id"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("extracted_text"), "text_hash", F.length("text_hash").alias("text_length"), F.col("created_at").cast("timestamp").alias("created_at"),
    )
    folder = new_folder(spark, name)
    write_table(rows, f"{folder}/table", "created_at")
    return folder


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select("snapshot_id", "monitor_id", "text_hash", "text_length", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query
def read_table_snapshots(spark, sf):
    """Snapshots of one week, read with their declared schema from the folders of those days."""
    folder = _snapshot_table(spark, sf, "snapshots")
    rows = read_table(spark, "snapshots", f"{folder}/table")
    return _typed(rows.filter("day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"))


@query
def stream_table_snapshots(spark, sf):
    """The same table as a typed stream of files, a few at a time."""
    folder = _snapshot_table(spark, sf, "snapshot-stream")
    rows = stream_table(spark, "snapshots", f"{folder}/table", files_per_trigger=16)
    stages.run_available(_typed(rows), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("snapshot_id string, monitor_id string, text_hash string, text_length int, created_at timestamp_ntz").parquet(f"{folder}/out")


@query
def append_stream_analyses(spark, sf):
    """Analyses that arrive twice, in several micro-batches: each is stored once, in its first version."""
    folder = new_folder(spark, "appended")
    rows = a.analyses(spark, sf).select("diff_id", "monitor_id", "severity", "created_at")
    rows.repartition(3, "diff_id").write.parquet(f"{folder}/in")
    rows.repartition(2).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    append_stream(stream, f"{folder}/stored", ["diff_id"], f"{folder}/checkpoint", ["created_at"])
    return spark.read.schema(rows.schema).parquet(f"{folder}/stored").select(*rows.columns)


@query
def append_once_analyses(spark, sf):
    rows = a.analyses(spark, sf).select("diff_id", "monitor_id", "severity", "created_at")
    stored = rows.filter("severity = 'critical'")
    later = rows.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    return append_once(stored, later.unionByName(rows), ["diff_id"], ["created_at"])


@query
def upsert_settings(spark, sf):
    current = a.settings(spark, sf).select("user_id", "channel", "is_enabled", "min_severity").withColumn("version", F.lit(0))
    changes = current.filter("channel = 'email'").withColumns(
        {"is_enabled": ~F.col("is_enabled"), "version": (F.col("user_id") % 3).cast("int")}
    )
    return upsert_state(current, changes, ["user_id", "channel"], ["version", "is_enabled"])


# ---- B. ingest ----------------------------------------------------------------------


@query
def extract_page_text(spark, sf):
    pages = a.table(spark, sf, "pages")
    texts = ingest.fingerprint_text(ingest.extract_page_text(pages, "html"))
    return texts.select("page_id", "text_hash", "text_length")


@query
def normalize_page_text(spark, sf):
    docs = a.table(spark, sf, "documents")
    spread = F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n\n\n")), F.lit(" "), F.lit("  "))
    return docs.select("doc_id", F.sha2(ingest.normalize_page_text(spread), 256).alias("text_hash"))


@query
def fingerprint_text(spark, sf):
    docs = a.table(spark, sf, "documents")
    return ingest.fingerprint_text(docs, "text").select("doc_id", "text_hash", "text_length")


@query
def flag_js_pages(spark, sf):
    """Pages, and documents taken as pages (many of them short); some of each with the sign of a script page."""
    pages = a.table(spark, sf, "pages").withColumn("html", F.concat("html", F.when(F.col("url").contains("example.com"), "<NoScript>").otherwise("")))
    pages = ingest.extract_page_text(pages, "html").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "html", "extracted_text")
    docs = a.table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.concat("text", F.when(F.col("lang") == "en", "<NoScript>").otherwise("")).alias("html"), F.col("text").alias("extracted_text")
    )
    flagged = ingest.flag_js_pages(pages.unionByName(docs).withColumn("at", F.expr(DUE_AT)), "html", "extracted_text", "at")
    return flagged.select("kind", "id", "needs_rendering", "recheck_at")


@query
def flag_bot_pages(spark, sf):
    docs = a.table(spark, sf, "documents").withColumn(
        "text", F.concat("text", F.when(F.col("lang") == "en", " Access Denied").otherwise(""))
    )
    return ingest.flag_bot_pages(docs, "text").select("doc_id", "is_bot_page")


@query
def due_monitors(spark, sf):
    return ingest.due_monitors(a.monitors(spark, sf).select("monitor_id", "is_active", "deleted_at", "next_check_at"), F.expr(DUE_AT)).select("monitor_id", "place", "batch_no")


@query
def skip_recent(spark, sf):
    return ingest.skip_recent(a.monitors(spark, sf), F.expr(DUE_AT)).select("monitor_id", "last_checked_at")


@query
def attempt_streaks(spark, sf):
    return ingest.attempt_streaks(a.attempts(spark, sf).select("attempt_id", "monitor_id", "attempted_at", "ok")).select("attempt_id", "monitor_id", "consecutive_failures")


@query
def fold_attempts(spark, sf):
    return ingest.fold_attempts(a.attempts(spark, sf))


@query
def choose_fetch_route(spark, sf):
    return ingest.choose_fetch_route(a.attempts(spark, sf)).select("attempt_id", "route")


@query
def validate_urls(spark, sf):
    """Every page URL in seven spellings, most of them to be refused."""
    pages = a.table(spark, sf, "pages")
    host = lambda h: F.concat(F.lit(f"http://{h}/"), F.col("page_id").cast("string"))
    last = (F.col("page_id") % 256).cast("string")
    spelled = F.array(
        F.col("url"),
        F.concat(F.lit("ftp://"), F.col("page_id").cast("string")),
        host("LOCALHOST:8080"),
        F.concat(F.lit("http://172."), last, F.lit(".0.1/x")),
        F.concat(F.lit("https://192.168.1."), last),
        F.concat(F.lit("https://8.8.4."), last, F.lit(":8443/path?q=1")),
        F.lit("https:///nohost"),
    )
    variants = pages.select("page_id", F.posexplode(spelled).alias("variant", "u"))
    return variants.select("page_id", "variant", ingest.url_problem(F.col("u")).alias("problem"))


@query
def validate_monitors(spark, sf):
    return ingest.validate_monitors(a.monitors(spark, sf), max_monitors=3).select("monitor_id", "is_valid", "reason")


# ---- C. change detection --------------------------------------------------------------


@query
def pair_snapshots(spark, sf):
    return change.pair_snapshots(a.snapshots(spark, sf)).select("snapshot_id", "before_id", "before_hash")


def _halves(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows before the middle of their time, and the others."""
    ends = df.agg(F.unix_micros(F.min(column).cast("timestamp")).alias("a"), F.unix_micros(F.max(column).cast("timestamp")).alias("b")).first()
    early = F.unix_micros(F.col(column).cast("timestamp")) < ((ends.a or 0) + (ends.b or 0)) // 2
    return df.filter(early), df.filter(~early)


@query
def pair_snapshots_resumed(spark, sf):
    """Two runs, the second from what the first stored: the same pairs as one run gives."""
    early, late = _halves(a.snapshots(spark, sf), "created_at")
    carry = cut_lineage(change.pair_carry(early), "pair-carry")
    pairs = change.pair_snapshots(early).unionByName(change.pair_snapshots(late, carry=carry))
    return pairs.select("snapshot_id", "before_id", "before_hash")


@query
def snapshot_status(spark, sf):
    snaps = a.snapshots(spark, sf)
    emptied = snaps.filter("text_hash = 'view'").select(
        F.col("snapshot_id").alias("snapshot_after_id"), F.lit(True).alias("is_empty_after_filter")
    )
    done = snaps.filter("text_hash = 'error'").select(F.col("snapshot_id").alias("diff_id"))
    return change.snapshot_status(change.pair_snapshots(snaps), emptied, done).select("snapshot_id", "status")


def version_pairs(spark, sf) -> DataFrame:
    snaps = ingest.fingerprint_text(a.versions(spark, sf))
    return change.changed_pairs(snaps)


@query
def diff_snapshots(spark, sf):
    lines = change.diff_snapshots(version_pairs(spark, sf))
    return lines.select("diff_id", "seq", "hunk_no", "op", F.sha2("text", 256).alias("text_hash"))


@query
def diff_repeated_lines(spark, sf):
    """Both sides rebuilt from the diff of texts whose lines repeat: one word a line, every fifth line gone."""
    words = F.filter(F.split("text", r"[ \t\n\r\x0b\x0c]+"), lambda x: x != "")
    docs = a.table(spark, sf, "documents").select("doc_id", words.alias("lines"))
    pairs = docs.select(
        F.col("doc_id").alias("diff_id"),
        F.array_join("lines", "\n").alias("text_before"),
        F.array_join(F.filter("lines", lambda x, i: i % 5 != 1), "\n").alias("text_after"),
    ).filter("text_before <> text_after")
    diffs = change.diff_hunks(pairs, context=1_000_000_000, carry=())
    last = F.array_max(F.transform("hunks", lambda h: h["hunk_no"]))
    return diffs.select("diff_id", _side("+").alias("before_hash"), _side("-").alias("after_hash"), last.alias("last_hunk"))


def _side(skipped: str):
    """The hash of one side of a diff in hunks: its lines but those of the other side."""
    kept = F.filter(change.all_lines(F.col("hunks")), lambda s: s["op"] != skipped)
    return F.sha2(F.array_join(kept["text"], "\n"), 256)


@query
def diff_roundtrip(spark, sf):
    """With all context kept, context and removed lines give back the text before, context and added the text after."""
    diffs = change.diff_hunks(version_pairs(spark, sf), context=1_000_000)
    return diffs.select("diff_id", _side("+").alias("before_hash"), _side("-").alias("after_hash"))


@query
def diff_stats(spark, sf):
    return change.diff_stats(change.diff_hunks(version_pairs(spark, sf)))


@query
def diff_line_balance(spark, sf):
    stats = change.diff_stats(change.diff_hunks(version_pairs(spark, sf)))
    return stats.select("diff_id", (F.col("lines_added") - F.col("lines_removed")).cast("long").alias("net_lines"))


@query
def render_unified(spark, sf):
    text = change.render_unified(change.diff_hunks(version_pairs(spark, sf)))
    return text.select("diff_id", F.octet_length("unified_diff").alias("bytes"), F.sha2("unified_diff", 256).alias("text_hash"))


@query
def last_change(spark, sf):
    return change.last_change(a.analyses(spark, sf))


# ---- D. noise filtering -----------------------------------------------------------------


def patterned_lines(spark, sf) -> DataFrame:
    """Lines with per-monitor patterns (one of them broken) for English sites, learned ones for the rest."""
    docs = a.table(spark, sf, "documents")
    own = docs.filter("lang = 'en'").select(
        F.col("doc_id").alias("monitor_id"), F.array(F.lit(r"visits: \d+"), F.lit("[invalid")).alias("noise_patterns")
    )
    learned = docs.filter("lang <> 'en'").select(
        F.col("doc_id").alias("diff_id"), F.array(F.lit(r"^Build\s+.+?$"), F.lit(r"^visits:\s+.+?$")).alias("learned_patterns")
    )
    return noise.attach_patterns(a.lines(spark, sf), own, learned)


@query
def valid_patterns(spark, sf):
    """Lines of the documents taken as patterns: which of them compile."""
    lines = a.table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("pattern"))
    checked = noise.valid_patterns(lines.distinct())
    return checked.groupBy("is_valid").agg(F.count(F.lit(1)).alias("patterns"))


@query
def strip_noise(spark, sf):
    stripped = noise.strip_noise(patterned_lines(spark, sf)).filter("op <> ' '")
    return stripped.select("diff_id", "seq", F.sha2("residual", 256).alias("residual_hash"))


@query
def classify_noise_lines(spark, sf):
    marked = noise.classify_noise_lines(patterned_lines(spark, sf))
    return marked.select("diff_id", "seq", "is_noise", joined("hit_patterns"))


@query
def learned_hits(spark, sf):
    return noise.learned_hits(noise.classify_noise_lines(patterned_lines(spark, sf)))


@query
def drop_empty_hunks(spark, sf):
    kept = noise.drop_empty_hunks(noise.classify_noise_lines(patterned_lines(spark, sf)))
    return kept.select("diff_id", "hunk_no", "seq")


@query
def filter_diffs(spark, sf):
    diffs = noise.filter_diffs(patterned_lines(spark, sf), with_text=False)
    hits = F.array_join(
        F.transform(F.array_sort(F.map_entries("learned_hits")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )
    return diffs.select(
        "diff_id", "original_lines", "noise_lines_removed", "learned_noise_lines_removed", "is_empty_after_filter", hits.alias("hits")
    )


@query
def filtered_text(spark, sf):
    """Filtered unified text of every version pair, global patterns only."""
    diffs = noise.filter_diffs(change.diff_hunks(version_pairs(spark, sf)))
    return diffs.select("diff_id", "is_empty_after_filter", F.sha2("filtered_diff", 256).alias("text_hash"))


@query
def patterns_as_of(spark, sf):
    obs = a.observations(spark, sf)
    diffs = obs.select("monitor_id", "diff_id", F.col("observed_at").alias("created_at"))
    return noise.patterns_as_of(diffs, learning.pattern_state(obs, diffs)).select("diff_id", "pattern")


# ---- E. noise learning ---------------------------------------------------------------------


@query
def replacement_pairs(spark, sf):
    pairs = learning.replacement_pairs(a.lines(spark, sf))
    return pairs.select("diff_id", "seq", F.sha2("before", 256).alias("before_hash"), F.sha2("after", 256).alias("after_hash"))


@query
def candidate_patterns(spark, sf):
    pairs = learning.replacement_pairs(change.diff_hunks(version_pairs(spark, sf)))
    return learning.candidate_patterns(pairs).select("diff_id", "pattern", "template", r6("similarity"))


@query
def safeguard_reason(spark, sf):
    docs = a.table(spark, sf, "documents")
    reason = learning.safeguard_reason(F.col("text"), F.col("source"), F.lit("Acme The-Of"))
    return docs.select("doc_id", reason.alias("reason"))


@query
def learning_gate(spark, sf):
    snaps = a.snapshots(spark, sf)
    diffs = snaps.select(F.col("snapshot_id").alias("diff_id"), "monitor_id", F.length("text_hash").alias("changed_lines"))
    diffs = diffs.withColumn("changed_lines", F.when(F.col("changed_lines") == 4, 0).otherwise(F.col("changed_lines")))
    pairs = snaps.filter("text_hash <> 'click'").select(F.col("snapshot_id").alias("diff_id"), F.lit(1).alias("pairs"))
    return learning.learning_gate(diffs, snaps, pairs).select("diff_id", "snapshots_seen", "skip_reason")


@query
def pattern_history(spark, sf):
    return learning.pattern_history(a.observations(spark, sf)).select(
        "monitor_id", "pattern", "diff_id", "support_count", r6("avg_similarity"), "first_seen_at", "review_required", "latest_blocked_reason"
    )


def _observed_diffs(obs: DataFrame) -> DataFrame:
    return obs.select("monitor_id", "diff_id", F.col("observed_at").alias("created_at"))


@query
def recent_diff_count(spark, sf):
    return learning.recent_diff_count(_observed_diffs(a.observations(spark, sf))).select("diff_id", "recent_diffs")


@query
def decay_score(spark, sf):
    obs = a.observations(spark, sf)
    score = learning.decay_score(F.col("observed_at"), F.expr(LEARNED_AT))
    return obs.select("diff_id", F.round(score, 6).alias("decay"))


@query
def pattern_confidence(spark, sf):
    obs = a.observations(spark, sf)
    return learning.pattern_state(obs, _observed_diffs(obs)).select("monitor_id", "pattern", "diff_id", "recent_diffs", "confidence")


@query
def promote_patterns(spark, sf):
    obs = a.observations(spark, sf)
    return learning.pattern_state(obs, _observed_diffs(obs)).select(
        "monitor_id", "pattern", "diff_id", "is_active", "promoted", "promoted_at"
    )


@query
def pattern_state_resumed(spark, sf):
    """Learning in two runs: the second goes on from stored sums, and gives the first its successors."""
    early, late = _halves(a.observations(spark, sf), "observed_at")
    first = cut_lineage(learning.pattern_state(early, _observed_diffs(early)), "first-state")
    before = {name: cut_lineage(df, f"carry-{name}") for name, df in learning.pattern_carry(first, _observed_diffs(early)).items()}
    second = cut_lineage(learning.pattern_state(late, _observed_diffs(late), before), "second-state")
    corrected = learning.superseded_states(before["open"], second)
    key = ["monitor_id", "pattern", "diff_id"]
    whole = upsert_state(first.unionByName(second), corrected, key, [F.col("superseded_at").isNotNull(), "superseded_at"])
    return whole.select(*key, "support_count", r6("avg_similarity"), "confidence", "is_active", "promoted", "promoted_at", "superseded_at")


@query
def review_flags(spark, sf):
    obs = a.observations(spark, sf)
    state = learning.pattern_state(obs, _observed_diffs(obs))
    return learning.latest_state(state).select("monitor_id", "pattern", "review_required", "latest_blocked_reason")


@query
def recent_examples(spark, sf):
    return learning.recent_examples(a.observations(spark, sf)).select("monitor_id", "pattern", "diff_id", "recency")


@query
def record_usage(spark, sf):
    diffs = noise.filter_diffs(patterned_lines(spark, sf), with_text=False, carry=("monitor_id",))
    return learning.record_usage(diffs.withColumn("created_at", F.expr(USED_AT))).select("monitor_id", "diff_id", "pattern", "count")


@query
def usage_totals(spark, sf):
    return learning.usage_totals(a.filter_events(spark, sf))


@query
def tracked_events(spark, sf):
    return learning.tracked_events(a.filter_events(spark, sf), 5).select("monitor_id", "pattern", "diff_id", "count")


@query
def recent_filter_sum(spark, sf):
    return learning.recent_filter_sum(a.filter_events(spark, sf), F.expr(USED_AT))


def _used_patterns(spark, sf) -> DataFrame:
    obs = a.observations(spark, sf)
    now = F.expr(LEARNED_AT)
    latest = learning.latest_state(learning.pattern_state(obs, _observed_diffs(obs)), now)
    return learning.with_usage(latest, a.filter_events(spark, sf), F.expr(USED_AT))


@query
def summarize_patterns(spark, sf):
    every = a.table(spark, sf, "events").select(F.col("user_id").alias("monitor_id")).distinct()
    return learning.summarize_patterns(_used_patterns(spark, sf), every)


@query
def learning_overview(spark, sf):
    items = learning.learning_overview(learning.summarize_patterns(_used_patterns(spark, sf)), a.monitors(spark, sf))
    return items.select("place", "monitor_id", "name", "learned_patterns", "active_patterns", "lines_filtered_7d", "avg_confidence")


@query
def monitor_patterns(spark, sf):
    """The patterns of every monitor, most trusted first."""
    listed = learning.monitor_patterns(_used_patterns(spark, sf))
    return listed.select("monitor_id", "pattern", "confidence", "total_lines_filtered", "last_matched_at")


@query
def learning_run_stats(spark, sf):
    obs = a.observations(spark, sf)
    return learning.learning_run_stats(learning.pattern_state(obs, _observed_diffs(obs)))


# ---- F. classification -----------------------------------------------------------------------


@query
def truncate_diffs(spark, sf):
    docs = classify.truncate_diffs(a.table(spark, sf, "documents"), "text", 1000)
    return docs.select("doc_id", "was_truncated", F.sha2("diff_text", 256).alias("text_hash"))


@query
def build_prompts(spark, sf):
    docs = a.table(spark, sf, "documents").selectExpr(
        "doc_id", "CASE WHEN lang <> 'en' THEN source END AS competitor_name", "lang AS page_type",
        "concat('https://example.com/', doc_id) AS url", "text AS diff_text", "doc_id % 7 = 0 AS was_truncated",
    )
    prompts = classify.build_prompts(docs)
    return prompts.select("doc_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query
def parse_responses(spark, sf):
    return classify.parse_responses(a.responses(spark, sf)).select(
        "diff_id", "significance_level", "summary", F.array_join("categories", ",").alias("categories"), "needs_review"
    )


@query
def default_analysis(spark, sf):
    parsed = classify.parse_responses(a.responses(spark, sf))
    return parsed.select("diff_id", "summary", "prompt_tokens", "completion_tokens", "total_cost_usd", "error").filter("error IS NOT NULL")


@query
def fallback_parse(spark, sf):
    texts = a.free_text_responses(spark, sf).withColumn("p", classify.fallback_parse(F.col("text")))
    return texts.select(
        "conv_id", "turn", F.col("p.level").alias("level"), F.array_join("p.categories", ",").alias("categories"),
        F.sha2("p.summary", 256).alias("summary_hash"),
    )


@query
def classification_cost(spark, sf):
    parsed = classify.parse_responses(a.responses(spark, sf)).withColumn("day", F.to_date("created_at"))
    return classify.cost_totals(parsed, ["monitor_id", "day"])


def _stored_diffs(spark, sf) -> DataFrame:
    return a.analyses(spark, sf).select(
        "diff_id", "monitor_id", "created_at", (F.col("severity") == "noise").alias("is_empty_after_filter"),
        F.when(F.col("severity") != "low", F.col("summary")).alias("filtered_diff"), F.col("severity").alias("unified_diff"),
    )


@query
def classification_inputs(spark, sf):
    prompts = classify.classification_inputs(_stored_diffs(spark, sf), a.monitors(spark, sf))
    return prompts.select("diff_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query
def build_analyses(spark, sf):
    """Twice every diff id is asked for, so half of the requests name a diff that is not there."""
    diffs = _stored_diffs(spark, sf)
    asked = diffs.select((F.col("diff_id") * 2).alias("diff_id"))
    built = classify.build_analyses(diffs, a.monitors(spark, sf), a.responses(spark, sf).drop("monitor_id", "created_at"), asked)
    return built.select("diff_id", "monitor_id", "significance_level", F.array_join("categories", ",").alias("categories"), "needs_review", "error")


@query
def alert_candidates(spark, sf):
    return classify.alert_candidates(a.analyses(spark, sf), "severity").select("diff_id", "monitor_id", "severity")


def stub_model(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a model: the level follows the length of the prompt."""
    levels = ["critical", "high", "medium", "low", "noise"]
    size = batch["prompt"].str.len()
    body = [
        f'{{"significance_level":"{levels[n % 5]}","summary":"{n} characters","categories":["other"]}}' for n in size
    ]
    return pd.DataFrame(
        {"diff_id": batch["diff_id"], "body": body, "is_structured": True, "prompt_tokens": size // 4, "completion_tokens": 20, "error": None}
    )


@query
def classify_with(spark, sf):
    prompts = classify.classification_inputs(_stored_diffs(spark, sf), a.monitors(spark, sf))
    parsed = classify.parse_responses(classify.classify_with(prompts, stub_model))
    return parsed.select("diff_id", "significance_level", "summary", "prompt_tokens", "total_cost_usd")


@query
def classify_from_ledger(spark, sf):
    """Twice over one ledger: a third of the prompts, then all; the second run asks those that are left."""
    prompts = classify.classification_inputs(_stored_diffs(spark, sf), a.monitors(spark, sf))
    ledger = new_folder(spark, "ledger")
    wave = max(1, prompts.count() // 3)
    classify.classify_from_ledger(prompts.filter("diff_id % 3 = 0"), stub_model, ledger, wave)
    parsed = classify.parse_responses(classify.classify_from_ledger(prompts, stub_model, ledger, wave))
    return parsed.select("diff_id", "significance_level", "summary", "prompt_tokens", "total_cost_usd")


# ---- G. suppression -----------------------------------------------------------------------------


@query
def normalize_summary(spark, sf):
    rows = a.analyses(spark, sf)
    dated = F.concat("summary", F.lit("  up 12.5% since 2024-01-02, now $"), F.col("monitor_id").cast("string"))
    return rows.select("diff_id", suppress.normalize_summary(dated).alias("normalized"))


def _candidates(spark, sf) -> DataFrame:
    return classify.alert_candidates(a.analyses(spark, sf), "severity")


def _history(spark, sf) -> DataFrame:
    """The same alerts one hour later: a history that is given, not built by the rules."""
    return a.alerts(spark, sf).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))


@query
def same_summary_rule(spark, sf):
    return suppress.same_summary_rule(_candidates(spark, sf), _history(spark, sf))


@query
def severity_rule(spark, sf):
    return suppress.severity_rule(_candidates(spark, sf), _history(spark, sf))


@query
def oscillation_rule(spark, sf):
    return suppress.oscillation_flags(a.snapshots(spark, sf)).select("snapshot_id", "oscillates", "flips", "n_hashes")


@query
def suppress_alerts(spark, sf):
    return suppress.suppress_alerts(_candidates(spark, sf), a.snapshots(spark, sf)).select("diff_id", "outcome", "reason")


@query
def suppression_report(spark, sf):
    return suppress.suppression_report(suppress.suppress_alerts(_candidates(spark, sf), a.snapshots(spark, sf)))


# ---- H. clustering ---------------------------------------------------------------------------------


@query
def extract_keywords(spark, sf):
    docs = a.table(spark, sf, "documents").withColumn("words", cluster.extract_keywords(F.col("text")))
    return docs.select("doc_id", F.size("words").alias("n_words"), F.sha2(F.array_join("words", " "), 256).alias("words_hash"))


@query
def jaccard(spark, sf):
    docs = a.table(spark, sf, "documents")
    words = cluster.extract_keywords(F.col("text"))
    names = cluster.extract_keywords(F.concat_ws(" ", "lang", "source", F.lit("the and thereof with der")))
    return docs.select("doc_id", F.round(cluster.jaccard(words, names), 6).alias("score"))


@query
def alert_similarity(spark, sf):
    return cluster.consecutive_similarity(a.alerts(spark, sf)).select(
        "alert_id", "previous_id", r6("combined"), r6("temporal"), r6("category"), r6("keyword")
    )


def _given_clusters(spark, sf) -> DataFrame:
    return a.alerts(spark, sf).filter("severity = 'critical'").select(
        F.col("alert_id").alias("cluster_id"), "user_id", F.trim("competitor_name").alias("competitor_name"),
        "categories", cluster.extract_keywords(F.col("summary")).alias("keywords"),
        (F.col("alert_id") % 5 == 0).alias("is_resolved"), "created_at", F.col("created_at").alias("updated_at"),
    )


@query
def score_open_clusters(spark, sf):
    best = cluster.score_open_clusters(a.alerts(spark, sf), _given_clusters(spark, sf))
    return best.select("alert_id", "cluster_id", r6("score"), "merges")


@query
def assign_clusters(spark, sf):
    return cluster.assign_clusters(a.alerts(spark, sf)).select("alert_id", "cluster_id", r6("merge_score"))


def _daily_clusters(spark, sf) -> DataFrame:
    """Alerts with a cluster per user, competitor and day."""
    day = F.concat_ws("/", F.col("user_id").cast("string"), F.trim("competitor_name"), F.to_date("created_at").cast("string"))
    return a.alerts(spark, sf).withColumn("cluster_id", day)


@query
def cluster_rollup(spark, sf):
    return cluster.cluster_rollup(_daily_clusters(spark, sf)).select(
        "cluster_id", "severity", "alert_count", F.array_join("categories", ",").alias("categories"),
        F.array_join("keywords", ",").alias("keywords"), "created_at", "updated_at",
    )


@query
def cluster_title(spark, sf):
    return cluster.cluster_rollup(_daily_clusters(spark, sf)).select("cluster_id", "title")


# ---- I. notification ----------------------------------------------------------------------------------


def _routes(spark, sf) -> DataFrame:
    return notify.route_alerts(a.alerts(spark, sf), a.settings(spark, sf), a.users(spark, sf))


@query
def route_alerts(spark, sf):
    return _routes(spark, sf).select("alert_id", "channel", "route")


@query
def unroutable_users(spark, sf):
    """Alerts of every monitored user against the settings of customers with a positive balance."""
    alerts = a.alerts(spark, sf).withColumn("user_id", F.col("monitor_id"))
    some = a.settings(spark, sf).join(a.users(spark, sf).filter("is_active"), "user_id", "left_semi")
    return notify.unroutable_users(alerts, some)


@query
def digest_queue(spark, sf):
    ids = F.array_join(F.transform("alert_ids", lambda x: x.cast("string")), ",")
    return notify.digest_queue(_routes(spark, sf)).select("user_id", "channel", "digest_hour_utc", "part", ids.alias("alert_ids"))


@query
def build_digests(spark, sf):
    digests = notify.build_digests(_routes(spark, sf).select("alert_id", "monitor_id", "user_id", "channel", "severity", "summary", "created_at", "route", "digest_hour_utc"), a.monitors(spark, sf), 9)
    return digests.select("user_id", "channel", "part", "alerts", F.sha2("text", 256).alias("text_hash"))


def _rendered(spark, sf) -> DataFrame:
    pages = a.monitors(spark, sf).select("monitor_id", F.col("name").alias("monitor_name"), "page_type", "url")
    return notify.render_messages(_routes(spark, sf).join(pages, "monitor_id"), "https://dash.example.com")


@query
def render_messages(spark, sf):
    return _rendered(spark, sf).select("alert_id", "channel", "chat_text", "mail_subject", "mail_plain")


@query
def render_payloads(spark, sf):
    return _rendered(spark, sf).select("alert_id", "channel", "chat_payload", F.sha2("mail_html", 256).alias("html_hash"))


def _deliveries(spark, sf) -> DataFrame:
    """Fetch attempts read as a delivery log: two channels per alert id."""
    return a.attempts(spark, sf).selectExpr(
        "attempt_id DIV 2 AS alert_id", "CASE attempt_id % 2 WHEN 0 THEN 'slack' ELSE 'email' END AS channel", "ok", "error",
        "attempted_at AS at",
    )


@query
def fold_delivery(spark, sf):
    return notify.fold_delivery(_deliveries(spark, sf))


@query
def settings_view(spark, sf):
    return notify.settings_view(a.settings(spark, sf)).select("user_id", "channel", "webhook_url", "slack_configured")


@query
def reject_settings(spark, sf):
    changes = a.settings(spark, sf)
    stored = changes.filter("is_enabled AND user_id % 2 = 0")
    return notify.reject_settings(changes, stored).select("user_id", "channel", "problem")


# ---- J. reads and reports ---------------------------------------------------------------------------------


@query
def list_alerts(spark, sf):
    listed = reports.list_alerts(
        a.alerts(spark, sf), severity="high", is_acknowledged=False,
        since=F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"), until=F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"),
    )
    return listed.select("alert_id", "user_id", "created_at")


@query
def list_clusters(spark, sf):
    rolled = cluster.cluster_rollup(_daily_clusters(spark, sf))
    listed = reports.list_clusters(rolled, is_resolved=False, competitor_name="comp3")
    members = reports.cluster_members(listed, _daily_clusters(spark, sf))
    return members.select("cluster_id", "alert_id", "alert_count")


@query
def list_monitors(spark, sf):
    return reports.list_monitors(a.monitors(spark, sf), is_active=True, search="SITE1").select("monitor_id", "name")


@query
def list_diffs(spark, sf):
    diffs = noise.filter_diffs(patterned_lines(spark, sf), with_text=False, carry=("monitor_id",))
    return reports.list_diffs(diffs, has_changes=True).select("diff_id", "monitor_id", "original_lines")


@query
def list_snapshots(spark, sf):
    return reports.list_snapshots(a.versions(spark, sf)).select("snapshot_id", "monitor_id", "version", "created_at")


@query
def paginate(spark, sf):
    return reports.paginate(a.alerts(spark, sf), ["created_at desc", "alert_id"], page=3, per_page=50).select("alert_id", "created_at")


@query
def paginate_deep(spark, sf):
    """The last pages but one of all alerts, found by their places."""
    alerts = a.alerts(spark, sf)
    pages = reports.page_count(alerts.count(), 50)
    return reports.paginate(alerts, ["created_at desc", "alert_id"], page=max(1, pages - 1), per_page=50, near_rows=0).select("alert_id", "created_at")


@query
def page_totals(spark, sf):
    return reports.page_totals(a.alerts(spark, sf), ["user_id"])


@query
def owned_lookup(spark, sf):
    """Every snapshot that can be looked up through a live monitor."""
    return reports.owned(a.snapshots(spark, sf), a.monitors(spark, sf)).select("snapshot_id", "monitor_id")


@query
def system_stats(spark, sf):
    return reports.system_stats(
        a.users(spark, sf), a.monitors(spark, sf), a.alerts(spark, sf), a.snapshots(spark, sf),
        a.table(spark, sf, "documents"), a.analyses(spark, sf),
    )


@query
def duration_histogram(spark, sf):
    return reports.duration_histogram(a.request_log(spark, sf), ["method", "path", "status"]).select(
        "method", "path", "status", "le", "n", "count", r6("sum")
    )


@query
def labelled_counters(spark, sf):
    parsed = classify.parse_responses(a.responses(spark, sf))
    return reports.labelled_counters(a.attempts(spark, sf), parsed, a.alerts(spark, sf), _deliveries(spark, sf))


@query
def rate_limit_flags(spark, sf):
    return reports.rate_limit_flags(a.request_log(spark, sf).select("request_id", "ts", "client", "path"), limit=1).select("request_id", "nth", "rejected")


@query
def noise_share_report(spark, sf):
    diffs = noise.filter_diffs(patterned_lines(spark, sf), with_text=False)
    return reports.noise_share_report(diffs)


@query
def pipeline_report(spark, sf):
    diffs = noise.filter_diffs(patterned_lines(spark, sf), with_text=False)
    return reports.pipeline_report(a.monitors(spark, sf), a.versions(spark, sf), diffs, a.alerts(spark, sf))


# ---- K. lifecycle -------------------------------------------------------------------------------------------


@query
def apply_retention(spark, sf):
    rows = a.observations(spark, sf).withColumnRenamed("observed_at", "created_at")
    kept = lifecycle.apply_retention({"snapshots": rows, "diffs": rows, "analyses": rows}, F.expr(RETAINED_AT))
    tagged = [df.select(F.lit(name).alias("table_name"), "diff_id") for name, df in kept.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query
def retention_counts(spark, sf):
    rows = a.observations(spark, sf).withColumnRenamed("observed_at", "created_at")
    return lifecycle.retention_counts({"snapshots": rows, "diffs": rows, "analyses": rows}, F.expr(RETAINED_AT))


@query
def purge_deleted(spark, sf):
    kept, children = lifecycle.purge_deleted(
        a.monitors(spark, sf), {"snapshots": a.snapshots(spark, sf)}, F.expr(DUE_AT)
    )
    return children["snapshots"].select(F.lit("snapshots").alias("table_name"), F.col("snapshot_id").alias("id")).unionByName(
        kept.select(F.lit("monitors").alias("table_name"), F.col("monitor_id").alias("id"))
    )


@query
def purge_counts(spark, sf):
    return lifecycle.purge_counts(
        a.monitors(spark, sf), {"snapshots": a.snapshots(spark, sf), "alerts": a.alerts(spark, sf)}, F.expr(DUE_AT)
    )


@query
def fold_deletions(spark, sf):
    actions = a.table(spark, sf, "events").filter("event_type IN ('error', 'signup')").selectExpr(
        "user_id AS monitor_id", "CASE event_type WHEN 'error' THEN 'delete' ELSE 'restore' END AS action", "ts AS at"
    )
    folded = lifecycle.fold_deletions(a.monitors(spark, sf), actions)
    return folded.select("monitor_id", "is_active", "deleted_at", "next_check_at")


@query
def acknowledge_alerts(spark, sf):
    actions = a.table(spark, sf, "events").filter("event_type = 'click'").select(
        (F.col("event_id") + F.col("user_id")).alias("alert_id"), F.col("ts").alias("at")
    )
    done = lifecycle.acknowledge(a.alerts(spark, sf), actions)
    return done.select("alert_id", "is_acknowledged", "acknowledged_at")


@query
def resolve_clusters(spark, sf):
    """A cluster is resolved when the first of its alerts that is acknowledged came in."""
    alerts = _daily_clusters(spark, sf)
    actions = alerts.filter("is_acknowledged").select("cluster_id", F.col("created_at").alias("at"))
    return lifecycle.resolve(cluster.cluster_rollup(alerts), actions).select("cluster_id", "is_resolved", "resolved_at")


@query
def dedupe_signups(spark, sf):
    """Customers sign up under addresses that differ in case and blanks."""
    signups = a.table(spark, sf, "customer").selectExpr(
        "c_custkey AS signup_id",
        "concat(' ', CASE c_custkey % 2 WHEN 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END, '+', c_nationkey, '@Example.com ') AS email",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(c_custkey * 7919 % 100000 AS INT)) AS created_at",
    )
    return lifecycle.dedupe_signups(signups, ["created_at", "signup_id"]).select("email_normalized", "signup_id", "requests")


# ---- L. streaming: the table is read as a stream of files, what comes out is stored and read back ------------------


def _streamed(spark, made, name: str, at_once: bool = True) -> DataFrame:
    """Run `made(folder of closing marks)` over what is there, close it, and read what came out.

    `at_once`: all rows that are there make one micro-batch, and the mark comes with them.
    Rows of later batches would be late then, so such a stream is run first and closed after.
    """
    folder = new_folder(spark, name)
    stages.closing_folder(spark, f"{folder}/end")
    stream = made(f"{folder}/end")
    if not at_once:
        stages.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    stages.close_stream(spark, f"{folder}/end")
    stages.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def stream_pairs(spark, sf):
    pairs = _streamed(spark, lambda end: stages.stream_pairs(a.snapshots(spark, sf, a.stream_table), closing=end), "pairs")
    return stages.on_time(pairs).select("snapshot_id", "before_id", "before_hash")


@query
def stream_diffs(spark, sf):
    """Diff lines of versions that come in out of order: a file a day, some of them two days late, within the watermark."""
    folder = new_folder(spark, "arrivals")
    texts = a.versions(spark, sf)
    snaps = ingest.fingerprint_text(texts).select("snapshot_id", "monitor_id", "text_hash", "created_at")
    arrival = F.to_date("created_at") + (F.col("monitor_id") % 3 * (F.col("snapshot_id") % 2)).cast("int")
    snaps.withColumn("day", arrival).repartition("day").write.partitionBy("day").parquet(f"{folder}/in")
    arrivals = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    stages.closing_folder(spark, f"{folder}/end")
    diffs = lambda: stages.diff_stream(arrivals, texts, f"{folder}/diffs", f"{folder}/checkpoint", "30 days", f"{folder}/end")
    diffs()
    stages.close_stream(spark, f"{folder}/end")
    return diffs().select("diff_id", "seq", "hunk_no", "op", F.sha2("text", 256).alias("text_hash"))


@query
def stream_patterns(spark, sf):
    """Learning as a stream: observations come in a file a month, a third of them a month late, within the watermark."""
    folder = new_folder(spark, "learning")
    obs = a.observations(spark, sf)
    arrival = F.trunc(F.col("observed_at").cast("date") + F.when(F.col("diff_id") % 3 == 0, 30).otherwise(0), "month")
    obs.withColumn("arrived", arrival).repartition("arrived").write.partitionBy("arrived").parquet(f"{folder}/in")
    rows = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    stages.closing_folder(spark, f"{folder}/end")
    learn = lambda: stages.learn_stream(rows, f"{folder}/store", f"{folder}/checkpoint", "400 days", f"{folder}/end")
    learn()
    stages.close_stream(spark, f"{folder}/end")
    learn()
    states = monitoring.learned_states(spark, f"{folder}/store")
    return states.select("monitor_id", "pattern", "diff_id", "support_count", r6("avg_similarity"), "confidence", "is_active", "promoted", "promoted_at", "superseded_at")


@query
def stream_suppress(spark, sf):
    def made(end):
        snaps = a.snapshots(spark, sf, a.stream_table)
        asked = classify.alert_candidates(a.analyses(spark, sf, a.stream_table), "severity")
        return stages.stream_suppress(stages.suppression_input(snaps, asked), closing=end)

    decided = stages.on_time(_streamed(spark, made, "suppressed"))
    return decided.select("diff_id", suppress.outcome_name(F.col("outcome")).alias("outcome"))


@query
def stream_clusters(spark, sf):
    placed = _streamed(spark, lambda end: stages.stream_clusters(a.alerts(spark, sf, a.stream_table), closing=end), "clusters")
    return stages.on_time(placed).select("alert_id", "cluster_id", r6("merge_score"))


@query
def stream_rate_limit(spark, sf):
    counted = _streamed(spark, lambda end: stages.stream_rate_limit(a.request_log(spark, sf, a.stream_table), limit=1, closing=end), "limits")
    return stages.on_time(counted).select("client", F.col("minute").cast("timestamp_ntz").alias("minute"), "requests", "rejected")


@query
def stream_dedupe(spark, sf):
    rows = a.snapshots(spark, sf, a.stream_table)
    return _streamed(spark, lambda end: stages.stream_dedupe(rows.union(rows), ["snapshot_id"], "created_at"), "deduped")


@query
def stream_digest(spark, sf):
    folder = new_folder(spark, "digests")
    alerts = a.alerts(spark, sf, a.stream_table)
    stages.queue_digests(alerts, a.settings(spark, sf), f"{folder}/queue", f"{folder}/checkpoint").awaitTermination()
    monitors = a.monitors(spark, sf)
    # The hour is run twice: what the first run sent is consumed, so the second has nothing to send.
    for _ in range(2):
        stages.send_digests(spark, f"{folder}/queue", f"{folder}/sent", f"{folder}/digests", monitors, 9)
    digests = spark.read.parquet(f"{folder}/digests")
    return digests.select("user_id", "channel", "part", "alerts", F.sha2("text", 256).alias("text_hash"))


# ---- the whole chain, and the flagship: from versions of pages to meaningful changes per monitor -------------------------------------


@query
def watched_changes(spark, sf):
    """Every stage from page texts to clustered alerts, with the stand-in model."""
    docs = a.table(spark, sf, "documents").select(F.col("doc_id").alias("monitor_id"), "lang", "source")
    monitors = docs.selectExpr(
        "monitor_id", "monitor_id % 40 AS user_id", "concat('comp', monitor_id % 40) AS competitor_name", "lang AS page_type",
        "concat('https://example.com/', monitor_id) AS url", "CAST(array() AS ARRAY<STRING>) AS noise_patterns",
    )
    stages_out = monitoring.watch(a.versions(spark, sf), monitors, stub_model)
    return stages_out["alerts"].select("alert_id", "monitor_id", "severity", "cluster_id")


@query
def meaningful_changes(spark, sf):
    hunks = change.diff_hunks(version_pairs(spark, sf))
    diffs = noise.filter_diffs(hunks, with_text=False, carry=("monitor_id",))
    return reports.noise_share_report(diffs, ["monitor_id"])
