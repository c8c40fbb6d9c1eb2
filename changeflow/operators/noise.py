"""Noise filtering of changed lines: global patterns, per-monitor patterns, learned patterns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.functions import constants as k
from changeflow.functions import scans
from changeflow.functions.pattern_index import Index, Patterns
from changeflow.functions.text import days, matches, remove_all, trim_ws
from changeflow.operators import change
from changeflow.operators.change import FILE_HEADER, _hunk_header, _range_text
from changeflow.operators.ingest import compiles

# How long a pattern stays in force after it was last seen.
DECAY_MICROS = int(days(k.DECAY_HALF_LIFE_DAYS * math.log2(1 / k.MIN_DECAY)))


#: Without any of these a pattern cannot fail to compile.
_MAY_FAIL = r"[\\\[(){}*+?]"


def valid_patterns(patterns: DataFrame) -> DataFrame:
    """Add `is_valid` to (source, pattern) rows. Only patterns with a sign that can be wrong are compiled,
    those that recur close together once; the rows stay where they are."""
    plain = ~F.col("pattern").rlike(_MAY_FAIL)
    verdict = F.when(plain, F.lit(True)).otherwise(compiles(F.when(~plain, F.col("pattern"))))
    return patterns.withColumn("is_valid", F.when(F.col("pattern").isNotNull(), verdict))


def strip_global(c: Column) -> Column:
    """Remove every global pattern in turn. A line none of them matches is passed through after one test."""
    stripped = c
    for pattern in k.GLOBAL_NOISE_PATTERNS:
        stripped = remove_all(stripped, pattern)
    anywhere = "|".join(f"(?:{p})" for p in k.GLOBAL_NOISE_PATTERNS)
    return F.when(matches(c, anywhere), stripped).otherwise(c)


#: The operator of a row that carries the patterns of a diff ahead of its lines.
HEADER = "#"

_STRIPPED = "residual string, hits array<string>"


class _Indexes:
    """Pattern indexes of a worker, kept while lists recur."""

    def __init__(self) -> None:
        self.compiled, self.built = Patterns(), {}

    def of(self, own, learned) -> Index:
        own, learned = tuple(own if own is not None else ()), tuple(learned if learned is not None else ())
        if (own, learned) not in self.built:
            if len(self.built) >= 64:
                self.built.clear()
            self.built[own, learned] = Index([*own, *learned], len(own), self.compiled)
        return self.built[own, learned]


def _strippers():
    """A pandas UDF over rows sorted by (diff, header first): it keeps the patterns of the diff it is in."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        indexes = _Indexes()
        here, index = None, None
        for diffs, texts, monitor_lists, learned_lists in batches:
            out_text, out_hits = [], []
            for diff, text, own, learned in zip(diffs, texts, monitor_lists, learned_lists, strict=True):
                if own is not None or learned is not None:
                    here, index = diff, indexes.of(own, learned)
                elif diff != here:
                    here, index = diff, None
                text, hits = index.strip(text) if index is not None and text is not None else (text, [])
                out_text.append(text)
                out_hits.append(hits)
            yield pd.DataFrame({"residual": pd.Series(out_text, dtype=object), "hits": pd.Series(out_hits, dtype=object)})

    # Not deterministic to the optimizer: the rows must come as they are sorted, all of them.
    return F.pandas_udf(run, _STRIPPED, F.PandasUDFType.SCALAR_ITER).asNondeterministic()


def attach_patterns(lines: DataFrame, monitors: DataFrame | None = None, learned: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Diff lines, and one header row (op `#`) ahead of each diff that has patterns.

    The header carries `monitor_patterns` (of the diff's monitor) and `learned_patterns` (of the
    diff); the lines carry none, so a pattern travels once per diff however many lines it has.
    `heads` (diff_id, monitor_id) saves reading the lines for them.
    """
    kind = "array<string>"
    parts = []
    if monitors is not None:
        heads = lines.select("diff_id", "monitor_id").distinct() if heads is None else heads.select("diff_id", "monitor_id")
        own = monitors.filter(F.size("noise_patterns") > 0).select("monitor_id", F.col("noise_patterns").alias("monitor_patterns"))
        parts.append(heads.join(own, "monitor_id").select("diff_id", "monitor_patterns", F.lit(None).cast(kind).alias("learned_patterns")))
    if learned is not None:
        parts.append(learned.filter(F.size("learned_patterns") > 0).select("diff_id", F.lit(None).cast(kind).alias("monitor_patterns"), "learned_patterns"))
    if not parts:
        return lines
    listed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    listed = listed.groupBy("diff_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("monitor_patterns", "learned_patterns")])
    headers = listed.withColumns({"op": F.lit(HEADER), "seq": F.lit(-1)})
    return lines.unionByName(headers, allowMissingColumns=True)


_STRIPPED_LINES = pa.list_(pa.struct([("residual", pa.string()), ("hits", pa.list_(pa.string()))]))


def _strip_lists(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Per diff (residuals of its lines, monitor's patterns, learned patterns): residual and hits of each line, null where no pattern bit."""
    indexes = _Indexes()
    for diffs, monitor_lists, learned_lists in batches:
        ends, texts, hit_ends, hits, unknown = [0], [], [0], [], []
        for lines, own, learned in zip(diffs.to_pylist(), monitor_lists.to_pylist(), learned_lists.to_pylist(), strict=True):
            unknown.append(lines is None)
            index = None if lines is None else indexes.of(own, learned)
            for line in lines or ():
                left, found = index.strip(line) if line is not None else (line, ())
                texts.append(None if left == line else left)
                hits += found
                hit_ends.append(len(hits))
            ends.append(len(texts))
        lists = pa.ListArray.from_arrays(pa.array(hit_ends, pa.int32()), pa.array(hits, pa.string()))
        rows = pa.StructArray.from_arrays([pa.array(texts, pa.string()), lists], fields=list(_STRIPPED_LINES.value_type))
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, _STRIPPED_LINES, mask=pa.array(unknown, pa.bool_()))


def list_patterns(changed: DataFrame, monitors: DataFrame, learned: DataFrame) -> DataFrame:
    """Add `monitor_patterns` and `learned_patterns`, null where there are none, to a row per diff (diff_id, monitor_id).

    What `attach_patterns` puts ahead of lines, for diffs in hunks: asked of narrow rows before they are diffed,
    so that neither hunks nor lines have to move to their patterns.
    """
    own = monitors.filter(F.size("noise_patterns") > 0).groupBy("monitor_id").agg(F.first("noise_patterns").alias("monitor_patterns"))
    known = learned.filter(F.size("learned_patterns") > 0).groupBy("diff_id").agg(F.first("learned_patterns").alias("learned_patterns"))
    return changed.join(own, "monitor_id", "left").join(known, "diff_id", "left")


def strip_noise(lines: DataFrame) -> DataFrame:
    """Add `residual` and `hit_patterns`: what is left of a line after all patterns, and the learned ones that bit.

    Context lines are passed through untouched. Header rows from `attach_patterns` are used
    and dropped; without them no Python runs. Global patterns are built-in expressions; the
    others are found by an index (`functions/pattern_index.py`), so a line is tried against
    those that can match it, and a pattern is compiled once.

    With headers the lines are placed by diff, in the only shuffle that moves lines; the
    groupings of `filter_diffs` then move a row per hunk and a row per diff.
    """
    changed = F.col("op").isin("+", "-")
    out = lines.withColumn("residual", F.when(changed, strip_global(F.col("text"))))
    if "learned_patterns" in lines.columns:
        placed = out.repartition("diff_id").sortWithinPartitions("diff_id", "seq")
        stripped = _strippers()(F.xxhash64("diff_id"), F.col("residual"), F.col("monitor_patterns"), F.col("learned_patterns"))
        out = placed.withColumn("_s", stripped).withColumns({"residual": F.col("_s.residual"), "hit_patterns": F.col("_s.hits")})
        out = out.filter(F.col("op") != HEADER).drop("_s", "monitor_patterns", "learned_patterns")
    else:
        out = out.withColumn("hit_patterns", F.array().cast("array<string>"))
    return out.withColumn("residual", trim_ws(F.col("residual")))


def classify_noise_lines(lines: DataFrame, min_residual: int = k.MIN_RESIDUAL_CHARS) -> DataFrame:
    """Add `is_noise`: a changed line of which patterns left fewer than `min_residual` characters.

    A short line that no pattern touched is not noise; a blank line is.
    """
    bare = trim_ws(F.col("text"))
    touched = (F.col("residual") != bare) | (bare == "")
    marked = strip_noise(lines).withColumn(
        "is_noise", F.col("op").isin("+", "-") & (F.length("residual") < min_residual) & touched
    )
    # A learned pattern counts as a hit only where the line ended up noise.
    hits = F.when(F.col("is_noise"), F.col("hit_patterns")).otherwise(F.array().cast("array<string>"))
    return marked.withColumn("hit_patterns", hits)


def learned_hits(marked: DataFrame) -> DataFrame:
    """(diff_id, pattern, count): noise lines each learned pattern helped to remove."""
    return (
        marked.filter(F.size("hit_patterns") > 0)
        .select("diff_id", F.explode("hit_patterns").alias("pattern"))
        .groupBy("diff_id", "pattern")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def drop_empty_hunks(marked: DataFrame) -> DataFrame:
    """Keep the lines that are not noise, of hunks that still hold a change. A hunk is part of one document."""
    kept = marked.filter(~F.col("is_noise"))
    alive = F.max(F.col("op").isin("+", "-")).over(Window.partitionBy("diff_id", "hunk_no"))
    return kept.withColumn("_alive", alive).filter("_alive").drop("_alive")


def _falls_short(op: Column, text: Column, residual: Column, min_residual: int) -> Column:
    """What `classify_noise_lines` says of a line. What is asked first is cheap, and most lines end there."""
    bare = trim_ws(text)
    left = F.transform(F.array(trim_ws(residual)), lambda r: (F.length(r) < min_residual) & ((r != bare) | (bare == "")))[0]
    return op.isin("+", "-") & left


def _is_noise(op: Column, text: Column, min_residual: int) -> Column:
    """The same of a line that only global patterns touch."""
    return _falls_short(op, text, strip_global(text), min_residual)


def _marked_lines(diffs: DataFrame, min_residual: int, carry: tuple[str, ...]) -> DataFrame:
    """Diffs in hunks with `_marks`: for every line of a diff whether it is noise, and the learned patterns that made it so."""
    texts = lambda: change.all_lines(F.col("hunks"))
    left = F.transform(texts(), lambda s: F.when(s["op"].isin("+", "-"), strip_global(s["text"])))
    strip = F.arrow_udf(_strip_lists, "array<struct<residual:string,hits:array<string>>>", F.ArrowUDFType.SCALAR_ITER)
    listed = F.col("monitor_patterns").isNotNull() | F.col("learned_patterns").isNotNull()
    stripped = diffs.withColumn("_left", left).withColumn("_stripped", strip(F.when(listed, F.col("_left")), F.col("monitor_patterns"), F.col("learned_patterns")))

    def mark(line: Column, found: Column) -> Column:
        return F.struct(_falls_short(line["op"], line["text"], found["residual"], min_residual).alias("noise"), found["hits"].alias("hits"))

    bitten = F.coalesce("_stripped", F.array().cast("array<struct<residual:string,hits:array<string>>>"))
    found = F.zip_with("_left", bitten, lambda r, s: F.struct(F.coalesce(s["residual"], r).alias("residual"), s["hits"].alias("hits")))
    return stripped.select("diff_id", *carry, "hunks", F.zip_with(texts(), found, mark).alias("_marks"))


def _filter_hunks(diffs: DataFrame, min_residual: int, with_text: bool, carry: tuple[str, ...]) -> DataFrame:
    listed = "learned_patterns" in diffs.columns
    if listed:
        diffs = _marked_lines(diffs, min_residual, carry)

    def marked(h: Column) -> Column:
        noise = lambda s: F.col("_marks")[s["seq"]]["noise"] if listed else _is_noise(s["op"], s["text"], min_residual)
        lines = F.transform(
            h["lines"], lambda s: F.struct(s["op"].alias("op"), *([F.concat(s["op"], s["text"]).alias("line")] if with_text else []), noise(s).alias("noise"))
        )
        return F.struct(h["before_start"].alias("before_start"), h["after_start"].alias("after_start"), lines.alias("lines"))

    hits, learned = F.array().cast("array<string>"), F.lit(0)
    if listed:
        # A learned pattern counts as a hit only where the line ended up noise.
        hit = F.filter("_marks", lambda m: m["noise"] & (F.size(m["hits"]) > 0))
        hits, learned = F.flatten(F.transform(hit, lambda m: m["hits"])), F.size(hit)
    hunks = diffs.select(
        "diff_id", *carry, F.transform("hunks", marked).alias("hunks"), hits.alias("_hits"),
        learned.cast("long").alias("learned_noise_lines_removed"),
    )
    count = lambda h, keep: F.size(F.filter(h["lines"], keep))
    counted = F.transform(
        "hunks",
        lambda h: F.struct(
            h.alias("hunk"),
            count(h, lambda s: s["op"].isin("+", "-")).cast("long").alias("changed"),
            count(h, lambda s: s["noise"]).cast("long").alias("noise"),
        ),
    )
    total = lambda name: F.aggregate("_h", F.lit(0).cast("long"), lambda n, h: n + h[name])
    original, noisy = F.col("original_lines"), F.col("noise_lines_removed")
    out = (
        hunks.withColumn("_h", counted)
        .withColumns({"original_lines": total("changed"), "noise_lines_removed": total("noise")})
        .withColumn("is_empty_after_filter", original == noisy)
    )
    text = []
    if with_text:
        left = F.filter("_h", lambda h: h["changed"] > h["noise"])
        body = lambda h: F.concat_ws(
            "\n", _hunk_header(h["hunk"], h["hunk"]["lines"]), F.transform(F.filter(h["hunk"]["lines"], lambda s: ~s["noise"]), lambda s: s["line"])
        )
        whole = F.concat_ws("\n", F.lit("\n".join(FILE_HEADER)), F.transform(left, body))
        text = [F.when(original > noisy, whole).alias("filtered_diff")]
    return out.select(
        "diff_id", "original_lines", "noise_lines_removed", "learned_noise_lines_removed", "is_empty_after_filter", *carry, *text,
        _tally("_hits").alias("learned_hits"),
    )


def _tally(hits: str) -> Column:
    """How often each pattern is in a list of hits."""
    return F.map_from_entries(
        F.transform(
            F.array_sort(F.array_distinct(hits)),
            lambda p: F.struct(p, F.size(F.filter(hits, lambda x: x == p))),
        )
    )


def filter_diffs(lines: DataFrame, min_residual: int = k.MIN_RESIDUAL_CHARS, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per diff: counts, hit map, emptiness and (optionally) the filtered text, null when empty.

    One shuffle: rows are placed by diff, and both groupings below use that placement. Diffs in
    hunks (`diff_hunks`) are filtered inside their row, with the patterns they carry (`list_patterns`) if any.
    """
    if "hunks" in lines.columns:
        return _filter_hunks(lines, min_residual, with_text, carry)
    placed = lines if "learned_patterns" in lines.columns else lines.repartition("diff_id")
    marked = classify_noise_lines(placed, min_residual)
    changed = F.col("op").isin("+", "-")
    kept_change = changed & ~F.col("is_noise")
    per_hunk = [
        F.count_if(changed).alias("changed"),
        F.count_if(F.col("is_noise")).alias("noise"),
        F.count_if(F.size("hit_patterns") > 0).alias("learned_noise"),
        F.count_if(kept_change).alias("left_over"),
        F.flatten(F.collect_list("hit_patterns")).alias("hits"),
        *[F.first(c).alias(c) for c in carry],
    ]
    if with_text:
        per_hunk += [
            F.first("before_start").alias("before_start"),
            F.first("after_start").alias("after_start"),
            F.count_if(F.col("op") != "+").alias("n_before"),
            F.count_if(F.col("op") != "-").alias("n_after"),
            F.array_sort(
                F.collect_list(F.when(~F.col("is_noise"), F.struct("seq", F.concat("op", "text").alias("line"))))
            ).alias("kept"),
        ]
    hunks = marked.groupBy("diff_id", "hunk_no").agg(*per_hunk)

    all_hits = F.flatten(F.collect_list("hits"))
    per_diff = [
        F.sum("changed").alias("original_lines"),
        F.sum("noise").alias("noise_lines_removed"),
        F.sum("learned_noise").alias("learned_noise_lines_removed"),
        (F.sum("left_over") == 0).alias("is_empty_after_filter"),
        all_hits.alias("hits"),
        *[F.first(c).alias(c) for c in carry],
    ]
    if with_text:
        header = F.concat(
            F.lit("@@ -"), _range_text(F.col("before_start"), F.col("n_before")),
            F.lit(" +"), _range_text(F.col("after_start"), F.col("n_after")), F.lit(" @@"),
        )
        body = F.concat_ws("\n", header, F.transform("kept", lambda s: s["line"]))
        hunks = hunks.withColumn("body", F.when(F.col("left_over") > 0, body))
        bodies = F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("hunk_no", "body"))))
        per_diff.append(
            F.when(
                F.sum("left_over") > 0,
                F.concat_ws("\n", F.lit("\n".join(FILE_HEADER)), F.transform(bodies, lambda s: s["body"])),
            ).alias("filtered_diff")
        )
    diffs = hunks.groupBy("diff_id").agg(*per_diff)
    return diffs.withColumn("learned_hits", _tally("hits")).drop("hits")


def active_spells(state: DataFrame) -> DataFrame:
    """(monitor_id, pattern, spell_from, spell_to): stretches in which a pattern was in force without a break.

    A state holds from just after its observation until the next one, at most until it
    decays. Observations of one promotion follow each other without a break, so they
    are merged: what is left per pattern is one row per promotion, however often the
    pattern was seen.
    """
    columns = ["monitor_id", "pattern", "observed_at", "is_active", "promoted_at"]
    if "superseded_at" in state.columns:
        seen = state.select(*columns, "superseded_at")
    else:
        seen = scans.scan(
            state.select(*columns), ["monitor_id", "pattern"], ["observed_at"], [scans.by_time("observed_at")],
            superseded_at=scans.following(F.col("observed_at")),
        )
    gone = F.col("observed_at") + F.expr(f"INTERVAL {DECAY_MICROS // 1_000_000} SECONDS {DECAY_MICROS % 1_000_000} MICROSECONDS")
    return seen.filter("is_active").groupBy("monitor_id", "pattern", "promoted_at").agg(
        F.min("observed_at").alias("spell_from"), F.max(F.least(F.col("superseded_at"), gone)).alias("spell_to")
    ).drop("promoted_at")


def patterns_as_of(diffs: DataFrame, state: DataFrame) -> DataFrame:
    """(diff_id, monitor_id, pattern): learned patterns in force for each diff, from states strictly before it.

    `state` is a pattern history (monitor_id, pattern, observed_at, is_active, promoted_at).
    A spell is laid out by day and meets the diffs by (monitor, day), never monitor by
    monitor; apart from the first and last day of a spell every pair that meets is a
    result, so the join makes no more rows than it returns.
    """
    laid_out = active_spells(state).withColumn("day", F.explode(F.sequence(F.to_date("spell_from"), F.to_date("spell_to"))))
    dated = diffs.select("diff_id", "monitor_id", F.col("created_at").alias("_t"), F.to_date("created_at").alias("day"))
    return (
        dated.join(laid_out, ["monitor_id", "day"])
        .filter((F.col("spell_from") < F.col("_t")) & (F.col("_t") <= F.col("spell_to")))
        .select("diff_id", "monitor_id", "pattern")
    )


def pattern_lists(in_force: DataFrame) -> DataFrame:
    """(diff_id, learned_patterns): sorted, so the order of application is reproducible."""
    return in_force.groupBy("diff_id").agg(F.array_sort(F.collect_set("pattern")).alias("learned_patterns"))
