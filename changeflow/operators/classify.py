"""Classification rows: prompts out, responses in. The model call is a function the user brings."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions import constants as k
from changeflow.functions.text import PY_FLAGS_NOCASE, is_blank, severity_rank, string_array, trim_ws
from changeflow.plans.storage import cut_lineage, new_folder
from changeflow.sources.tables import append_once


def truncate_diffs(df: DataFrame, text_col: str = "filtered_diff", limit: int = k.MAX_DIFF_CHARS) -> DataFrame:
    """Cut long texts after the last whole line that fits; add `diff_text` and `was_truncated`.

    The cut is found in the leading `limit` characters: a line fits when its characters
    and its end lie within the limit, so the cut is the last line end there. The whole
    text decides whether to cut at all.
    """
    text = F.col(text_col)
    head = F.substring(text, 1, limit)
    # Everything up to the last line end inside the head; nothing when the first line is too long.
    lines_kept = F.when(head.contains("\n"), F.regexp_replace(head, r"(?s)\n[^\n]*\z", "")).otherwise("")
    too_long = F.length(text) > limit
    return df.withColumns(
        {
            "diff_text": F.when(too_long, F.concat(lines_kept, F.lit(k.TRUNCATION_MARK))).otherwise(text),
            "was_truncated": too_long,
        }
    )


def build_prompts(df: DataFrame) -> DataFrame:
    """Add `prompt` from competitor_name, page_type, url, diff_text and was_truncated."""
    competitor = F.when(F.length("competitor_name") > 0, F.col("competitor_name")).otherwise("Unknown")
    return df.withColumn(
        "prompt",
        F.concat_ws(
            "\n",
            F.concat(F.lit("**Competitor**: "), competitor),
            F.concat(F.lit("**Page Type**: "), F.col("page_type")),
            F.concat(F.lit("**URL**: "), F.col("url")),
            F.when(F.col("was_truncated"), F.lit(k.TRUNCATION_NOTE)),
            F.concat(F.lit("\n**Changes Detected**:\n```diff\n"), F.col("diff_text"), F.lit("\n```")),
        ),
    )


def classify_with(prompts: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], retries: int = 2) -> DataFrame:
    """Run `model` on Arrow batches of (diff_id, prompt); it returns diff_id, body, is_structured and token counts.

    The rows of a batch that keeps failing are asked one by one. Those that still fail
    become error rows, which `parse_responses` turns into the default analysis; the job goes on.
    """
    columns = ["diff_id", "body", "is_structured", "prompt_tokens", "completion_tokens", "error"]
    id_type = prompts.schema["diff_id"].dataType.simpleString()

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        failure = None
        for _ in range(retries + 1):
            try:
                return model(rows).copy()
            except Exception as problem:
                failure = problem
        if len(rows) > 1:
            return pd.concat([ask(rows.iloc[i : i + 1]) for i in range(len(rows))], ignore_index=True)
        return pd.DataFrame({"diff_id": rows["diff_id"]}).assign(
            body=None, is_structured=False, prompt_tokens=0, completion_tokens=0, error=str(failure)
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answer = ask(batch).reindex(columns=columns)
            # Plain objects, whatever string type the model's frame uses; no token count is none used.
            for text in ("diff_id", "body", "error") if id_type == "string" else ("body", "error"):
                answer[text] = answer[text].astype(object).where(answer[text].notna(), None)
            answer["is_structured"] = answer["is_structured"].fillna(False).astype(bool)
            yield answer.fillna({"prompt_tokens": 0, "completion_tokens": 0})

    schema = (
        f"diff_id {id_type}, body string, is_structured boolean, prompt_tokens int, completion_tokens int, error string"
    )
    return prompts.select("diff_id", "prompt").mapInPandas(run, schema)


def classify_from_ledger(
    prompts: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], ledger: str, wave: int = 1000, per_minute: int | None = None, retries: int = 2
) -> DataFrame:
    """`classify_with`, wave by wave, with every answer kept in the folder `ledger`.

    Prompts whose answer is in the ledger are not asked again: neither in a later run nor when
    a run goes on after a failure, which costs the wave it happened in. A wave holds about
    `wave` prompts; with `per_minute`, waves are started no faster than that allows. Error
    rows are not kept, so what failed is asked in the next run.
    """
    spark = prompts.sparkSession
    id_type = prompts.schema["diff_id"].dataType.simpleString()
    schema = f"diff_id {id_type}, body string, is_structured boolean, prompt_tokens int, completion_tokens int, error string"

    def answered() -> DataFrame | None:
        try:
            return spark.read.schema(schema).parquet(ledger)
        except AnalysisException:  # nothing asked yet
            return None

    known = answered()
    todo = prompts if known is None else prompts.join(known.select("diff_id"), "diff_id", "left_anti")
    folder = new_folder(spark, "prompts")
    waves = max(1, math.ceil(todo.count() / wave))
    todo.withColumn("wave", F.pmod(F.xxhash64("diff_id"), F.lit(waves))).repartition("wave").write.partitionBy("wave").parquet(folder)
    asked = spark.read.schema(T.StructType([*prompts.schema.fields, T.StructField("wave", T.LongType())])).parquet(folder)
    failed = None
    for number in range(waves):
        started = time.monotonic()
        answers = cut_lineage(classify_with(asked.filter(F.col("wave") == number).drop("wave"), model, retries), "answers")
        answers.filter(F.col("error").isNull()).write.mode("append").parquet(ledger)
        lost = answers.filter(F.col("error").isNotNull())
        failed = lost if failed is None else failed.unionByName(lost)
        if per_minute and number + 1 < waves:
            time.sleep(max(0.0, 60.0 * wave / per_minute - (time.monotonic() - started)))
    return answered().join(prompts.select("diff_id"), "diff_id", "left_semi").unionByName(failed)



def _first_level(text: Column) -> Column:
    level = None
    for name in k.SEVERITIES:
        test = text.rlike(PY_FLAGS_NOCASE + rf"\b{name}\b")
        level = F.when(test, F.lit(name)) if level is None else level.when(test, F.lit(name))
    return level.otherwise("medium")


def _cut(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def fallback_parse(text: Column, max_summary: int | None = None) -> Column:
    """struct(level, summary, categories) from a free-text answer: words are searched for."""
    lower = F.lower(text)
    named = F.filter(
        string_array(k.CATEGORIES),
        lambda c: F.contains(lower, c) | F.contains(lower, F.replace(c, F.lit("_"), F.lit(" "))),
    )
    categories = F.when(F.size(named) > 0, named).otherwise(string_array(["other"]))
    found = F.struct(
        _first_level(text).alias("level"),
        trim_ws(_cut(text, max_summary)).alias("summary"),
        categories.alias("categories"),
    )
    return F.when(F.length(text) > 0, found).otherwise(_default())


def _default(summary: Column | None = None) -> Column:
    return F.struct(
        F.lit("medium").alias("level"),
        (F.lit(k.FAILED_SUMMARY) if summary is None else summary).alias("summary"),
        string_array(["other"]).alias("categories"),
    )


def parse_structured(body: Column, max_summary: int | None = None) -> Column:
    """struct(level, summary, categories, is_exact) from a JSON answer, repaired field by field.

    With `max_summary` a longer summary is cut, and the answer does not count as exact.
    """
    raw = F.from_json(body, "significance_level string, summary string, categories array<string>")
    known = string_array(k.CATEGORIES)
    listed = F.filter(raw["categories"], lambda c: F.array_contains(known, c))
    exact = (
        raw["significance_level"].isin(k.SEVERITIES)
        & raw["summary"].isNotNull()
        & (F.lit(True) if max_summary is None else F.length(raw["summary"]) <= max_summary)
        & (F.size(raw["categories"]) > 0)
        & (F.size(listed) == F.size(raw["categories"]))
    )
    return F.struct(
        F.when(raw["significance_level"].isin(k.SEVERITIES), raw["significance_level"]).otherwise("medium").alias("level"),
        _cut(F.coalesce(raw["summary"], F.lit(k.UNCERTAIN_SUMMARY)), max_summary).alias("summary"),
        F.when(F.size(listed) > 0, listed).otherwise(string_array(["other"])).alias("categories"),
        F.coalesce(exact, F.lit(False)).alias("is_exact"),
    )


def parse_responses(responses: DataFrame, max_summary: int | None = None) -> DataFrame:
    """Level, summary, categories, needs_review, cost and error for every response row.

    Structured answers are validated and repaired, free text is searched, a row with an
    error (or no body) becomes the default analysis at no cost.
    """
    structured = F.col("is_structured") if "is_structured" in responses.columns else F.lit(True)
    failed = F.col("error").isNotNull() | F.col("body").isNull()
    both = responses.withColumns({"_s": parse_structured(F.col("body"), max_summary), "_t": fallback_parse(F.col("body"), max_summary)})
    result = (
        F.when(failed, _default())
        .when(structured, F.struct(F.col("_s.level").alias("level"), F.col("_s.summary").alias("summary"), F.col("_s.categories").alias("categories")))
        .otherwise(F.col("_t"))
    )
    tokens = {
        c: F.when(failed, F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0))) for c in ("prompt_tokens", "completion_tokens")
    }
    return (
        both.withColumn("_r", result)
        .withColumns(
            {
                "significance_level": F.col("_r.level"),
                "summary": F.col("_r.summary"),
                "categories": F.col("_r.categories"),
                "needs_review": failed | ~structured | ~F.col("_s.is_exact"),
                "error": F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("body").isNull(), "no response"),
                **tokens,
            }
        )
        .withColumn("total_cost_usd", classification_cost(F.col("prompt_tokens"), F.col("completion_tokens")))
        .drop("_s", "_t", "_r", "body", "is_structured")
    )


def classification_cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    cost = prompt_tokens * k.COST_PER_PROMPT_TOKEN + completion_tokens * k.COST_PER_COMPLETION_TOKEN
    return F.round(cost, 6)


def cost_totals(analyses: DataFrame, by: list[str]) -> DataFrame:
    return analyses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.sum("total_cost_usd"), 6).alias("total_cost_usd"),
    )


_CONTEXT = ["competitor_name", "page_type", "url"]


def page_contexts(monitors: DataFrame) -> DataFrame:
    """(monitor_id, contexts): what a prompt says of a monitor, for narrow rows that become diffs later."""
    return monitors.groupBy("monitor_id").agg(F.collect_list(F.struct(*_CONTEXT)).alias("contexts"))


def classification_inputs(diffs: DataFrame, monitors: DataFrame, limit: int | None = None) -> DataFrame:
    """Text and context per diff to classify: the filtered diff, or the raw one when that is empty.

    The whole text goes into the prompt, unless a `limit` in characters is given. Diffs that carry the
    `contexts` of their monitor (`page_contexts`) stay where they are.
    """
    raw = F.col("unified_diff") if "unified_diff" in diffs.columns else F.lit("")
    text = F.when(is_blank(F.col("filtered_diff")), raw).otherwise(F.col("filtered_diff"))
    if "contexts" in diffs.columns:
        rows = diffs.select("diff_id", "monitor_id", text.alias("filtered_diff"), F.inline("contexts"))
    else:
        context = monitors.select("monitor_id", *_CONTEXT)
        rows = diffs.select("diff_id", "monitor_id", text.alias("filtered_diff")).join(context, "monitor_id")
    whole = rows.withColumns({"diff_text": F.col("filtered_diff"), "was_truncated": F.lit(False)})
    return build_prompts(whole if limit is None else truncate_diffs(rows, limit=limit))


def build_analyses(
    diffs: DataFrame, monitors: DataFrame, responses: DataFrame, requested: DataFrame | None = None, existing: DataFrame | None = None
) -> DataFrame:
    """One analysis per diff from its response, or an error row.

    `requested` names diffs that were asked for (default: those with changes); one that
    is not stored, or whose monitor is gone, gives an error row without a level. A diff
    without a response gets the default analysis. `existing` analyses are not repeated.
    """
    known = diffs.select("diff_id", "monitor_id", "created_at")
    wanted = diffs.filter(~F.col("is_empty_after_filter")).select("diff_id") if requested is None else requested.select("diff_id")
    live = monitors.select("monitor_id", F.lit(True).alias("_has_monitor"))
    answered = responses.select("diff_id", "body", "error", "prompt_tokens", "completion_tokens", *(
        ["is_structured"] if "is_structured" in responses.columns else []
    ))
    parsed = parse_responses(wanted.join(known, "diff_id", "left").join(live, "monitor_id", "left").join(answered, "diff_id", "left"))
    missing = F.when(F.col("created_at").isNull(), "diff_not_found").when(F.col("_has_monitor").isNull(), "monitor_not_found")
    fields = ["significance_level", "summary", "categories", "prompt_tokens", "completion_tokens", "total_cost_usd", "needs_review"]
    out = parsed.withColumn("_missing", missing).select(
        "diff_id",
        "monitor_id",
        *[F.when(F.col("_missing").isNull(), F.col(c)).alias(c) for c in fields],
        F.coalesce("_missing", "error").alias("error"),
        "created_at",
    )
    # Of several responses to one diff the least by these columns counts, whatever their order.
    return append_once(existing, out, ["diff_id"], ["created_at", "error", *[c for c in fields if c != "categories"], "categories"])


def alert_candidates(analyses: DataFrame, level_col: str = "significance_level") -> DataFrame:
    """Analyses worth an alert: medium and above."""
    return analyses.filter(severity_rank(F.col(level_col)) >= k.SEVERITY_ORDER["medium"])
