"""The stages put together: from snapshots of pages to clustered, routed alerts.

`watch` runs over a whole history. `watch_next` runs over the snapshots of one batch and goes
on from what the batches before it left behind: what it reads is the batch and the store, never
the history. A batch is later than all batches before it; its results are those of one run
over everything, row by row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions.text import micros
from changeflow.operators import change, classify, cluster, ingest, learning, noise, notify, suppress
from changeflow.plans.storage import CarryStore, cut_lineage
from changeflow.sources.tables import upsert_state

Model = Callable[[pd.DataFrame], pd.DataFrame]


def _run(snapshots: DataFrame, monitors: DataFrame, model: Model, before: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The stages from `before` on: results, and what only a following run needs besides them.

    Learning reads unfiltered diffs only, so the whole pattern history comes first and is
    then joined to the diffs as of their time; no stage waits for its own output except
    suppression and clustering, which replay narrow rows per key.

    Steps that more than one later stage reads (replaced lines, filtered diffs, model answers,
    decisions) are stored once, so a branch or a lost executor never makes them run again.

    Texts are diffed twice: for learning, and to be filtered with the patterns learned by then. The
    patterns and the monitor's context go with the narrow pairs, and everything that is asked of a
    diff happens where its texts meet: neither hunks nor lines are stored or moved.
    """
    patterns_before = {k: before[k] for k in ("history", "promoted", "recent", "open") if k in before}
    printed = ingest.fingerprint_text(snapshots)
    snaps = cut_lineage(printed.select("monitor_id", "snapshot_id", "text_hash", "created_at"), "snapshots")
    # First, while little else is stored: hashes are the widest of what is scanned.
    flags = cut_lineage(suppress.oscillation_flags(snaps, carry=before.get("hashes")).drop("text_hash"), "oscillation_flags")
    pairs = change.pair_snapshots(snaps, carry=before.get("pairs"))
    every = snapshots.select("monitor_id", "snapshot_id", "extracted_text")
    if "texts" in before:
        every = every.unionByName(before["texts"])
    changed = _changed_pairs(pairs, snaps, before.get("seen"))
    replaced = learning.replaced_lines(change.changed_hunks(every, changed, carry=("monitor_id", "created_at", "learns")), learns=F.col("learns"))
    replaced = cut_lineage(replaced, "replaced_lines")
    heads = replaced.select("diff_id", "monitor_id", "created_at")

    observations = cut_lineage(learning.observe_patterns(replaced, heads, snaps, monitors, before.get("seen")), "observations")
    state = cut_lineage(learning.pattern_state(observations, heads, patterns_before), "pattern_state")
    superseded = learning.superseded_states(before["open"], state) if "open" in before else None
    known = state if superseded is None else state.unionByName(superseded)
    in_force = cut_lineage(noise.pattern_lists(noise.patterns_as_of(heads, known)), "patterns_in_force")

    noted = cut_lineage(_filtered_diffs(every, changed, heads, monitors, in_force).withColumn("snapshot_after_id", F.col("diff_id")), "diffs")
    diffs = noted.drop("contexts")

    meaningful = noted.filter(~F.col("is_empty_after_filter"))
    prompts = classify.classification_inputs(meaningful, monitors)
    responses = cut_lineage(classify.classify_with(prompts, model), "responses")
    analyses = cut_lineage(classify.build_analyses(diffs, monitors, responses), "analyses")

    owners = monitors.select("monitor_id", "user_id", "competitor_name")
    candidates = classify.alert_candidates(analyses).withColumnRenamed("significance_level", "severity").join(owners, "monitor_id")
    decisions, suppressed = suppress.decide_alerts(candidates, flags, start=before.get("suppression"), before=before)
    decided = cut_lineage(decisions, "decisions")
    created = suppress.created_alerts(decided).withColumn("alert_id", F.col("diff_id")).withColumn(
        "notified_at", F.lit(None).cast("timestamp")
    )
    placed, clustered = cluster.place_alerts(created, start=before.get("clustering"))
    alerts = cut_lineage(placed, "alerts")
    cells = cluster.cluster_cells(alerts)
    if "cells" in before:
        touched = alerts.select("cluster_id").distinct()
        cells = cluster.merge_cells(cells.unionByName(before["cells"].join(touched, "cluster_id", "left_semi")))

    out = {
        "snapshots": change.snapshot_status(pairs, diffs, analyses),
        "diffs": diffs,
        "observations": observations,
        "patterns": state,
        "filter_events": learning.record_usage(diffs),
        "analyses": analyses,
        "decisions": decided,
        "alerts": alerts,
        "clusters": cluster.rollup_cells(cells),
    }
    if superseded is not None:
        out["superseded_patterns"] = _corrections(before["open"], state)
    behind = {"snaps": snaps, "every": every, "heads": heads, "suppression": suppressed.states, "clustering": clustered.states, "cells": cells}
    return out, behind


def _changed_pairs(pairs: DataFrame, snaps: DataFrame, seen: DataFrame | None) -> DataFrame:
    """The changed pairs, stored: `learns` where a diff can be learned from, `repeated` where its id comes more than once."""
    changed = change.named_changes(pairs)
    ready = learning.learning_gate(changed, snaps, carry=seen).filter(F.col("skip_reason").isNull())
    ready = ready.select("diff_id").distinct().withColumn("learns", F.lit(True))
    copies = changed.groupBy("diff_id").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return cut_lineage(changed.join(ready, "diff_id", "left").join(copies, "diff_id", "left"), "changed_pairs")


def _filtered_diffs(every: DataFrame, changed: DataFrame, heads: DataFrame, monitors: DataFrame, in_force: DataFrame) -> DataFrame:
    """Diffs filtered with all patterns, and the `contexts` of their monitor. Rows of one id are one diff."""
    carry, contexts = ("monitor_id", "created_at"), classify.page_contexts(monitors)
    single = noise.list_patterns(changed.filter(~F.col("repeated")), monitors, in_force).join(contexts, "monitor_id", "left")
    hunks = change.changed_hunks(every, single, carry=(*carry, "monitor_patterns", "learned_patterns", "contexts"))
    diffs = noise.filter_diffs(hunks, carry=(*carry, "contexts"))
    several = changed.filter("repeated")
    if several.isEmpty():
        return diffs
    lines = change.hunk_lines(change.changed_hunks(every, several, carry=carry))
    merged = noise.filter_diffs(noise.attach_patterns(lines, monitors, in_force, heads), carry=carry)
    return diffs.unionByName(merged.join(contexts, "monitor_id", "left"))


def watch(snapshots: DataFrame, monitors: DataFrame, model: Model, settings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run all stages over a history of snapshots (snapshot_id, monitor_id, extracted_text, created_at)."""
    out, _ = _run(snapshots, monitors, model, {})
    if settings is not None:
        out["routes"] = notify.route_alerts(out["alerts"], settings)
    return out


def watch_next(path: str, run: str, snapshots: DataFrame, monitors: DataFrame, model: Model, settings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run all stages over the next batch of snapshots; the store in `path` says where to go on.

    Results are those of `watch` for the batch, and two tables correct stored ones:
    `superseded_patterns` gives rows of earlier `patterns` their successor's time (upsert by
    monitor, pattern and diff), `clusters` replaces rows of earlier clusters that grew.

    The store keeps, per monitor: the last snapshot and its text, the number of snapshots, the
    newest hashes, diffs of 60 days; per pattern: running sums and the last state; per key: the
    alerts and clusters that can still matter, and the words of those clusters. `run` names the
    batch; one that was committed before is refused. Results are stored with the run and
    committed together with the carries, so a failed run can be repeated as it was.
    """
    store = CarryStore(snapshots.sparkSession, path)
    if run in store.known:
        raise ValueError(f"run {run} is committed already")
    before = store.tables()
    out, behind = _run(snapshots, monitors, model, before)
    if settings is not None:
        out["routes"] = notify.route_alerts(out["alerts"], settings)
    stored = {name: store.result(name, df) for name, df in out.items()}

    snaps = behind["snaps"]
    pairs = store.carry("pairs", change.pair_carry(snaps, before.get("pairs")))
    last = pairs.select(F.element_at("_total_prev", -1)["snapshot_id"].alias("snapshot_id"))
    store.carry("texts", behind["every"].select("monitor_id", "snapshot_id", "extracted_text").join(last, "snapshot_id", "left_semi"))
    store.carry("seen", learning.gate_carry(snaps, before.get("seen")))
    store.carry("suppression", behind["suppression"])
    store.carry("clustering", behind["clustering"])
    for name, df in {**learning.pattern_carry(stored["patterns"], behind["heads"], before), **suppress.oscillation_carry(snaps, before)}.items():
        store.carry(name, df)
    # A cluster that is silent for longer than the window takes no more alerts.
    cells = behind["cells"]
    if "cells" in before:
        cells = cells.unionByName(before["cells"].join(cells.select("cluster_id").distinct(), "cluster_id", "left_anti"))
    newest = snaps.agg(F.max(micros(F.col("created_at")))).first()[0]
    live = cells.filter("tag = ''").filter(micros(F.col("last_at")) >= F.lit(newest or 0) - cluster.WINDOW).select("cluster_id")
    store.carry("cells", cells.join(live, "cluster_id", "left_semi"))
    store.commit(run)
    return stored


def learn_next(path: str, run: str, observations: DataFrame) -> DataFrame:
    """Take the observations of one batch into the pattern states kept in `path`; the states after each of them."""
    store = CarryStore(observations.sparkSession, path)
    if run in store.known:
        raise ValueError(f"run {run} is committed already")
    before = store.tables()
    heads = observations.select("monitor_id", "diff_id", F.col("observed_at").alias("created_at")).distinct()
    state = store.result("patterns", learning.pattern_state(observations, heads, before))
    if "open" in before:
        store.result("superseded_patterns", _corrections(before["open"], state))
    for name, df in learning.pattern_carry(state, heads, before).items():
        store.carry(name, df)
    store.commit(run)
    return state


def _corrections(open_states: DataFrame, state: DataFrame) -> DataFrame:
    touched = state.select("monitor_id", "pattern").distinct()
    return learning.superseded_states(open_states, state).join(touched, ["monitor_id", "pattern"], "left_semi")


def learned_states(spark: SparkSession, path: str) -> DataFrame | None:
    """The pattern states of all committed runs, with the successors that later runs found."""
    store = CarryStore(spark, path)
    states, corrections = store.history("patterns"), store.history("superseded_patterns")
    if states is None or corrections is None:
        return states
    return upsert_state(states, corrections, ["monitor_id", "pattern", "diff_id"], [F.col("superseded_at").isNotNull(), "superseded_at"])
