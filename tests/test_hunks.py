"""Diffs as rows of hunks: the same results as from rows of lines, and no line is moved."""

import re

import pytest
from pyspark.sql import functions as F

from changeflow.operators import change, ingest, learning, noise
from changeflow.plans.queries import QUERIES, version_pairs
from tests.conftest import SF
from tests.test_change import random_pairs


@pytest.fixture(scope="module")
def pairs(spark):
    noisy = [("Visited: 3\nUpdated 2024-03-01 10:00\n\nkept line", "Visited: 4\nUpdated 2024-03-02 10:00\nkept line\n \nnew")]
    rows = [(i, i % 3, i, b, a) for i, (b, a) in enumerate([*random_pairs(), *noisy])]
    rows.append((999, 0, 0, "same", "same"))
    return spark.createDataFrame(rows, "diff_id int, monitor_id int, created_at int, text_before string, text_after string").cache()


def moves(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_statistics_and_text_are_those_of_the_lines(pairs):
    hunks, lines = change.diff_hunks(pairs), change.diff_snapshots(pairs)
    assert rows_of(change.diff_stats(hunks)) == rows_of(change.diff_stats(lines))
    assert rows_of(change.render_unified(hunks)) == rows_of(change.render_unified(lines))
    assert hunks.filter("diff_id = 999").isEmpty()
    assert not moves(change.diff_stats(hunks)) and not moves(change.render_unified(hunks))


@pytest.mark.parametrize("with_text", [True, False])
def test_filtering_is_that_of_the_lines(pairs, with_text):
    hunks, lines = change.diff_hunks(pairs), change.diff_snapshots(pairs)
    of_hunks = noise.filter_diffs(hunks, with_text=with_text, carry=("monitor_id",))
    of_lines = noise.filter_diffs(lines, with_text=with_text, carry=("monitor_id",))
    assert rows_of(of_hunks.select(sorted(of_hunks.columns))) == rows_of(of_lines.select(sorted(of_lines.columns)))
    assert of_hunks.filter("is_empty_after_filter = false AND noise_lines_removed > 0").count() > 0
    assert not moves(of_hunks)


def test_replaced_lines_are_those_of_the_lines(pairs):
    hunks, lines = change.diff_hunks(pairs), change.diff_snapshots(pairs)
    got = learning.replacement_pairs(hunks)
    assert rows_of(got) == rows_of(learning.replacement_pairs(lines)) and got.count() > 50
    assert not moves(got)


def version_snapshots(spark, at):
    rows = [(m * 100 + v, m, f"page {m}\n" + "long line " * 50 + f"\nversion {v // 2} é" if v != 3 else None, at(v)) for m in range(6) for v in range(2 + 3 * m)]
    return ingest.fingerprint_text(spark.createDataFrame(rows, "snapshot_id bigint, monitor_id int, extracted_text string, created_at timestamp"))


def test_texts_meet_alike_by_monitor_and_by_id(spark, at):
    snaps = version_snapshots(spark, at)
    texts = {r.snapshot_id: r.extracted_text for r in snaps.collect()}
    packed = change.changed_pairs(snaps)
    assert rows_of(packed) == rows_of(change.changed_pairs(snaps, gathered=1)) == rows_of(change.changed_pairs(snaps, gathered=8))
    got = {r.diff_id: (r.text_before, r.text_after) for r in packed.collect()}
    want = {i: (texts[i - 1], texts[i]) for i in texts if i - 1 in texts and texts[i - 1] != texts[i]}
    assert got == want and any(b is None for b, _ in got.values())


def test_an_earlier_run_gives_texts_without_times(spark, at):
    snaps = version_snapshots(spark, at)
    early, late = snaps.filter(F.col("created_at") < F.lit(at(4))), snaps.filter(F.col("created_at") >= F.lit(at(4)))
    found = change.pair_snapshots(late, carry=change.pair_carry(early))
    got = change.changed_pairs(snaps.select("monitor_id", "snapshot_id", "extracted_text"), found)
    want = change.changed_pairs(snaps).filter(F.col("created_at") >= F.lit(at(4)))
    assert rows_of(got) == rows_of(want)


def test_versions_of_a_page_move_as_one_pack(spark):
    """Texts used to cross three exchanges, one row a version and whole each time."""
    plan = version_pairs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [before_id" not in plan and plan.count("MapInArrow") == 2
    packs = change._packs(spark_batches(spark))
    raw, kept = map(sum, zip(*((sum(b.column(3).to_pylist()), sum(map(len, b.column(4).to_pylist()))) for b in packs)))
    assert kept < raw / 5


def spark_batches(spark):
    from changeflow.sources import adapters as a

    return iter(a.versions(spark, SF).select("monitor_id", "snapshot_id", "extracted_text").toArrow().to_batches())


@pytest.mark.parametrize("name", ["render_unified", "filtered_text", "meaningful_changes", "diff_roundtrip", "diff_stats", "diff_line_balance", "diff_repeated_lines"])
def test_no_query_moves_lines(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    rows = re.split(r"MapInArrow", plan)[0]
    assert rows.count("Exchange hashpartitioning(diff_id") == 0


def test_patterns_are_observed_in_hunks_as_in_lines(spark):
    """The chain stored a row per line and moved all of them to the gate and to their pairs."""
    from changeflow.sources import adapters as a

    snaps = ingest.fingerprint_text(a.versions(spark, SF))
    hunks = change.diff_hunks(change.changed_pairs(snaps)).cache()
    heads = hunks.select("diff_id", "monitor_id", "created_at")
    got = learning.observe_patterns(hunks, heads, snaps)
    want = learning.observe_patterns(change.hunk_lines(hunks), heads, snaps)
    assert rows_of(got) == rows_of(want) and got.count() > 100


PATTERNS = "monitor_id int, noise_patterns array<string>"


@pytest.mark.parametrize("with_text", [True, False])
def test_filtering_with_patterns_is_that_of_the_lines(spark, pairs, with_text):
    """Diffs with patterns were laid out in lines, and every line moved twice."""
    monitors = spark.createDataFrame([(0, [r"VISITED: \d+", "[broken"]), (1, [])], PATTERNS)
    learned = spark.createDataFrame([(i, ["line", r"^a.*?$", r"^Visited:\s+.+?$"][: i % 4]) for i in range(0, 400, 2)], "diff_id int, learned_patterns array<string>")
    heads = pairs.select("diff_id", "monitor_id")
    listed = noise.list_patterns(heads, monitors, learned)
    carry = ("monitor_id", "monitor_patterns", "learned_patterns")
    of_hunks = noise.filter_diffs(change.diff_hunks(pairs.join(listed.drop("monitor_id"), "diff_id"), carry=carry), with_text=with_text, carry=("monitor_id",))
    of_lines = noise.filter_diffs(noise.attach_patterns(change.diff_snapshots(pairs), monitors, learned, heads), with_text=with_text, carry=("monitor_id",))
    assert rows_of(of_hunks.select(sorted(of_hunks.columns))) == rows_of(of_lines.select(sorted(of_lines.columns)))
    assert of_hunks.filter("learned_noise_lines_removed > 0").count() > 5 and of_hunks.filter("size(learned_hits) > 0").count() > 5
    above = of_hunks._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above


@pytest.mark.parametrize("gathered", [1000, 8, 1])
def test_texts_are_diffed_where_they_meet(spark, at, gathered):
    snaps = version_snapshots(spark, at)
    changed = change.named_changes(change.pair_snapshots(snaps)).withColumn("note", F.array(F.col("diff_id").cast("string")))
    got = change.changed_hunks(snaps, changed, carry=("monitor_id", "note"), gathered=gathered)
    want = change.diff_hunks(change.changed_pairs(snaps)).withColumn("note", F.array(F.col("diff_id").cast("string")))
    columns = ["diff_id", "monitor_id", "note", "hunks"]
    assert rows_of(got.select(columns)) == rows_of(want.select(columns)) and got.count() > 20
    if gathered == 1000:
        assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2


def test_replaced_lines_are_kept_with_their_diff(pairs):
    hunks = change.diff_hunks(pairs)
    pairs_of = lambda df: learning.candidate_patterns(learning.replacement_pairs(df))
    kept = learning.replaced_lines(hunks)
    assert rows_of(pairs_of(kept)) == rows_of(pairs_of(hunks)) and kept.count() == hunks.count()
    assert learning.replaced_lines(hunks, learns=F.col("diff_id") < 0).filter("size(replaced) > 0").isEmpty()
