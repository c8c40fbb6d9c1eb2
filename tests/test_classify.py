import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from changeflow.functions import constants as k
from changeflow.operators import classify


def truncate(text, limit):
    if len(text) <= limit:
        return text
    kept, size = [], 0
    for line in text.split("\n"):
        if size + len(line) + 1 > limit:
            break
        kept.append(line)
        size += len(line) + 1
    return "\n".join(kept) + k.TRUNCATION_MARK


def test_truncation(spark):
    texts = ["x" * 10, "x" * 11, "a\nb\nc\nd\ne\nf", "123456789\nab", "1234567890\nab", "\n" * 20, "é" * 9 + "\nzz", "ab\n" * 4, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, filtered_diff string")
    got = [r.diff_text for r in classify.truncate_diffs(df, limit=10).orderBy("i").collect()]
    assert got == [truncate(t, 10) for t in texts]


def test_prompt(spark):
    df = spark.createDataFrame([(None, "pricing", "https://e.com", "+ x", True), ("Acme", "blog", "u", "- y", False)], "competitor_name string, page_type string, url string, diff_text string, was_truncated boolean")
    a, b = (r.prompt for r in classify.build_prompts(df).collect())
    assert a.startswith("**Competitor**: Unknown\n**Page Type**: pricing\n**URL**: https://e.com\n\n⚠️ Note") and a.endswith("```diff\n+ x\n```")
    assert b == "**Competitor**: Acme\n**Page Type**: blog\n**URL**: u\n\n**Changes Detected**:\n```diff\n- y\n```"


SCHEMA = "diff_id int, body string, is_structured boolean, prompt_tokens int, completion_tokens int, error string"


def parse(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return classify.parse_responses(df).orderBy("diff_id").collect()


def body(level="high", summary="s", categories=("pricing_change",), **more):
    return json.dumps({"significance_level": level, "summary": summary, "categories": list(categories), **more})


def test_structured_responses(spark):
    ok, level, cats, empty, long, missing, broken, error, absent = parse(
        spark,
        (body("critical", categories=["pricing_change", "other"]), True, 450, 120, None),
        (body("urgent"), True, 10, 10, None),
        (body(categories=["zzz", "partnership"]), True, 10, 10, None),
        (body(categories=[]), True, 10, 10, None),
        (body(summary="y" * 1200), True, 10, 10, None),
        ('{"significance_level": "low", "categories": ["other"]}', True, 10, 10, None),
        ("{not json", True, 10, 10, None),
        (None, True, 10, 10, "timeout"),
        (None, True, None, None, None),
    )
    assert (ok.significance_level, ok.categories, ok.needs_review, ok.total_cost_usd) == ("critical", ["pricing_change", "other"], False, 0.00315)
    assert (level.significance_level, level.needs_review) == ("medium", True)
    assert (cats.categories, cats.needs_review) == (["partnership"], True)
    assert (empty.categories, empty.needs_review) == (["other"], True)
    assert (len(long.summary), long.needs_review) == (1200, False)
    assert (missing.summary, missing.significance_level, missing.needs_review) == (k.UNCERTAIN_SUMMARY, "low", True)
    assert (broken.significance_level, broken.categories) == ("medium", ["other"])
    assert (error.significance_level, error.summary, error.total_cost_usd, error.error) == ("medium", k.FAILED_SUMMARY, 0.0, "timeout")
    assert absent.error == "no response" and absent.needs_review


def test_free_text(spark):
    a, b, c, d, e = parse(
        spark,
        ("This is CRITICAL. A pricing change and feature_launch.", False, 1, 1, None),
        ("criticality is low here", False, 1, 1, None),
        ("nothing said", False, 1, 1, None),
        ("see another page", False, 1, 1, None),
        ("", False, 1, 1, None),
    )
    assert (a.significance_level, a.categories, a.needs_review) == ("critical", ["pricing_change", "feature_launch"], True)
    assert (b.significance_level, b.categories) == ("low", ["other"])
    assert c.significance_level == "medium"
    assert d.categories == ["other"]  # by substring: "another"
    assert e.summary == k.FAILED_SUMMARY


def test_model_failures_become_default_rows(spark):
    def model(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["prompt"] == "boom").any():
            raise RuntimeError("overloaded")
        return pd.DataFrame({"diff_id": batch["diff_id"], "body": "{}", "is_structured": True, "prompt_tokens": 1, "completion_tokens": 1})

    good = spark.createDataFrame([(1, "fine")], "diff_id int, prompt string")
    bad = spark.createDataFrame([(2, "boom")], "diff_id int, prompt string")
    got = {r.diff_id: r for r in classify.parse_responses(classify.classify_with(good.union(bad), model)).collect()}
    assert got[1].error is None and got[2].error == "overloaded" and got[2].significance_level == "medium"


def test_build_analyses(spark, at):
    diffs = spark.createDataFrame(
        [(1, "m", at(0), False, "x"), (2, "gone", at(0), False, "x"), (3, "m", at(0), True, None), (4, "m", at(0), False, "x")],
        "diff_id int, monitor_id string, created_at timestamp, is_empty_after_filter boolean, filtered_diff string",
    )
    monitors = spark.createDataFrame([("m",)], "monitor_id string")
    answers = spark.createDataFrame([(1, body(), True, 1, 1, None), (2, body(), True, 1, 1, None)], SCHEMA)
    got = {r.diff_id: r for r in classify.build_analyses(diffs, monitors, answers).collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1].significance_level, got[1].error) == ("high", None)
    assert (got[2].significance_level, got[2].error) == (None, "monitor_not_found")
    assert (got[4].significance_level, got[4].error) == ("medium", "no response")
    asked = spark.createDataFrame([(1,), (77,)], "diff_id int")
    stored = classify.build_analyses(diffs, monitors, answers).filter("diff_id = 1")
    again = classify.build_analyses(diffs, monitors, answers, asked, stored).collect()
    assert [(r.diff_id, r.error) for r in again] == [(77, "diff_not_found")]


def test_candidates(spark):
    df = spark.createDataFrame([(s,) for s in [*k.SEVERITIES, "odd", None]], "significance_level string")
    assert {r[0] for r in classify.alert_candidates(df).collect()} == {"critical", "high", "medium"}
    assert classify.cost_totals(
        spark.createDataFrame([("m", 1, 2, 0.1), ("m", 3, 4, 0.2)], "monitor_id string, prompt_tokens int, completion_tokens int, total_cost_usd double"), ["monitor_id"]
    ).select("prompt_tokens", F.col("total_cost_usd")).first() == (4, 0.3)


def test_summary_limit_is_the_callers(spark):
    rows = spark.createDataFrame([(json.dumps({"significance_level": "low", "summary": "y" * 1200, "categories": ["other"]}), True, 1, 1, None)], "body string, is_structured boolean, prompt_tokens int, completion_tokens int, error string")
    cut = classify.parse_responses(rows, max_summary=1000).first()
    assert (len(cut.summary), cut.needs_review) == (1000, True)


def test_long_diffs_reach_the_prompt_whole(spark):
    text = "\n".join(f"+ line {i}" for i in range(3000))
    diffs = spark.createDataFrame([(1, "m", text)], "diff_id int, monitor_id string, filtered_diff string")
    monitors = spark.createDataFrame([("m", "Acme", "pricing", "https://e.com")], "monitor_id string, competitor_name string, page_type string, url string")
    assert text in classify.classification_inputs(diffs, monitors).first().prompt
    assert len(classify.classification_inputs(diffs, monitors, limit=14_000).first().prompt) < 15_000


def test_one_bad_prompt_costs_only_itself(spark):
    def model(batch):
        if batch["prompt"].str.contains("bad").any():
            raise ValueError("no")
        return batch[["diff_id"]].assign(body="low", is_structured=False, prompt_tokens=1, completion_tokens=1)

    prompts = spark.createDataFrame([(i, "bad" if i == 7 else "good") for i in range(20)], "diff_id int, prompt string").coalesce(1)
    got = {r.diff_id: r.error for r in classify.classify_with(prompts, model).collect()}
    assert got == {i: "no" if i == 7 else None for i in range(20)}


def make_counting_model(log, broken):
    """A model that notes what it is asked; it dies on ids in `broken`, and gives an error for one id."""

    def model(batch):
        with open(log, "a") as out:
            out.write("".join(f"{i}\n" for i in batch["diff_id"]))
        if set(batch["diff_id"]) & set(broken):
            raise SystemExit("lost")
        return pd.DataFrame({"diff_id": batch["diff_id"], "body": "{}", "is_structured": True, "prompt_tokens": 1, "completion_tokens": 1, "error": None})

    return model


def test_no_answer_is_asked_for_twice(spark, tmp_path):
    from collections import Counter

    log, ledger = str(tmp_path / "log"), str(tmp_path / "ledger")
    prompts = spark.range(200).selectExpr("id AS diff_id", "concat('p', id) AS prompt")
    with pytest.raises(Exception):
        classify.classify_from_ledger(prompts, make_counting_model(log, [77]), ledger, wave=20)
    before = Counter(open(log).read().split())
    kept = {r.diff_id for r in spark.read.parquet(ledger).collect()} if (tmp_path / "ledger").exists() else set()
    open(log, "w").close()
    got = classify.classify_from_ledger(prompts, make_counting_model(log, []), ledger, wave=20)
    assert sorted(r.diff_id for r in got.collect()) == list(range(200))
    asked = Counter(open(log).read().split())
    assert {int(i) for i in asked} == set(range(200)) - kept and max(asked.values()) == 1 and before
    open(log, "w").close()
    assert classify.classify_from_ledger(prompts, make_counting_model(log, []), ledger, wave=20).count() == 200
    assert open(log).read() == ""


def test_waves_keep_to_a_budget(spark, tmp_path):
    import time

    prompts = spark.range(40).selectExpr("id AS diff_id", "concat('p', id) AS prompt")
    started = time.monotonic()
    classify.classify_from_ledger(prompts, make_counting_model(str(tmp_path / "log"), []), str(tmp_path / "ledger"), wave=10, per_minute=300)
    assert time.monotonic() - started >= 6
