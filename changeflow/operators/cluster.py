"""Alert clustering: similarity of an alert to a cluster, online assignment, roll-ups."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions import constants as k
from changeflow.functions import replay, scans
from changeflow.functions.text import hours, micros, severity_name, severity_rank, string_array, title_words, trim_ws

WINDOW = hours(k.CLUSTER_WINDOW_HOURS)
DECAY_PER_HOUR = math.log(2) / k.TEMPORAL_HALF_LIFE_HOURS


def extract_keywords(c: Column) -> Column:
    """Distinct lower-case ASCII words of three letters or more that carry meaning, sorted."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z]+"), F.lit(0))
    return F.array_sort(F.array_except(F.filter(words, lambda w: F.length(w) > 2), string_array(k.STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def temporal_similarity(a: Column, b: Column) -> Column:
    apart = F.abs(micros(a) - micros(b)) / 3_600_000_000
    return F.exp(-apart * DECAY_PER_HOUR)


def alert_similarity(categories: Column, keywords: Column, at: Column, other_categories: Column, other_keywords: Column, other_at: Column) -> Column:
    """struct(combined, temporal, category, keyword)."""
    temporal = temporal_similarity(at, other_at)
    category = jaccard(categories, other_categories)
    keyword = jaccard(keywords, other_keywords)
    combined = k.WEIGHT_TEMPORAL * temporal + k.WEIGHT_CATEGORY * category + k.WEIGHT_KEYWORD * keyword
    return F.struct(
        combined.alias("combined"), temporal.alias("temporal"), category.alias("category"), keyword.alias("keyword")
    )


def consecutive_similarity(alerts: DataFrame) -> DataFrame:
    """Similarity of each alert to the one before it of the same user and competitor."""
    featured = alerts.withColumn("keywords", extract_keywords(F.col("summary")))
    seen = scans.scan(
        featured,
        ["user_id", "competitor_name"],
        ["created_at", "alert_id"],
        [scans.by_time("created_at")],
        prev=scans.before(F.struct("alert_id", "categories", "keywords", "created_at")),
    ).withColumn("p", F.try_element_at("prev", F.lit(-1)))
    score = alert_similarity(
        F.col("categories"), F.col("keywords"), F.col("created_at"), F.col("p.categories"), F.col("p.keywords"), F.col("p.created_at")
    )
    return seen.filter(F.col("p").isNotNull()).withColumn("s", score).select(
        "alert_id", F.col("p.alert_id").alias("previous_id"), "s.combined", "s.temporal", "s.category", "s.keyword"
    )


def score_open_clusters(alerts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Best open cluster for each new alert, clusters given: (alert_id, cluster_id, score, merges).

    Clusters of one (user, competitor) with the same categories and keywords differ for an alert
    only by their time, and the latest of them scores best. So an alert meets each such likeness
    that can be reached from its two-day cell once, and a scan along time finds the latest
    cluster of it: the rows follow the alerts and the likenesses, not the clusters.
    """
    cell = lambda c: F.floor(micros(c) / WINDOW)
    likeness = ["user_id", "competitor_name", "_like"]
    named = alerts.withColumn("competitor_name", trim_ws(F.col("competitor_name"))).filter(F.length("competitor_name") > 0)
    new = named.select(
        "alert_id", "user_id", "competitor_name", "categories", extract_keywords(F.col("summary")).alias("keywords"),
        F.col("created_at").alias("at"), cell(F.col("created_at")).alias("cell"),
    )
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    unresolved = (
        clusters.filter(~F.col("is_resolved"))
        .withColumn("_like", F.to_json(F.struct(as_set("categories").alias("c"), as_set("keywords").alias("k"))))
        .groupBy(*likeness, F.col("updated_at").alias("at"))
        .agg(
            F.min_by(F.struct("cluster_id", "created_at"), F.struct("created_at", "cluster_id")).alias("_first"),
            F.first("categories").alias("c_categories"),
            F.first("keywords").alias("c_keywords"),
        )
    )
    reach = F.explode(F.sequence(cell(F.col("at")), cell(F.col("at")) + 1)).alias("cell")
    reached = unresolved.select(*likeness, reach).distinct()
    asking = new.join(reached, ["user_id", "competitor_name", "cell"]).select(
        *likeness, "at", F.lit(1).alias("_side"), F.struct("alert_id", "categories", "keywords").alias("_alert")
    )
    given = unresolved.select(
        *likeness, "at", F.lit(0).alias("_side"),
        F.struct(F.col("at"), F.col("_first.cluster_id"), F.col("_first.created_at").alias("opened"), "c_categories", "c_keywords").alias("_cluster"),
    )
    # A cluster comes before the alerts of its instant. Alerts of one instant all see the same clusters.
    seen = scans.scan(
        given.unionByName(asking, allowMissingColumns=True), likeness, ["at", "_side"], [scans.by_time("at")], c=scans.latest(F.col("_cluster"))
    )
    met = seen.filter((F.col("_side") == 1) & (micros(F.col("c.at")) >= micros(F.col("at")) - WINDOW))
    scored = met.select(
        "_alert.alert_id", "c.cluster_id", "c.opened",
        alert_similarity(F.col("_alert.categories"), F.col("_alert.keywords"), F.col("at"), F.col("c.c_categories"), F.col("c.c_keywords"), F.col("c.at"))["combined"].alias("score"),
    )
    # Of equal scores the oldest cluster wins, of equally old ones the least id.
    best = F.min_by(F.struct("cluster_id", "score"), F.struct(-F.col("score"), F.col("opened"), F.col("cluster_id")))
    return scored.groupBy("alert_id").agg(best.alias("b")).select(
        "alert_id", "b.cluster_id", "b.score", (F.col("b.score") >= k.MERGE_THRESHOLD).alias("merges")
    )


# ---- online assignment ------------------------------------------------------------


def _overlap(a: frozenset, b: set) -> float:
    both = len(a & b)
    union = len(a) + len(b) - both
    return both / union if union else 0.0


def cluster_step(open_clusters: list[dict], alert_id, at: int, categories: frozenset, keywords: frozenset):
    """Place one alert: returns (cluster id, score of the merge or None) and updates the open clusters.

    Clusters are kept in order of opening, so the oldest wins a tie; those silent for
    more than 48 h are forgotten.
    """
    open_clusters[:] = [c for c in open_clusters if c["at"] >= at - WINDOW]
    best, best_score = None, 0.0
    for c in open_clusters:
        near = math.exp(-abs(at - c["at"]) / 3_600_000_000 * DECAY_PER_HOUR)
        score = (
            k.WEIGHT_TEMPORAL * near
            + k.WEIGHT_CATEGORY * _overlap(categories, c["categories"])
            + k.WEIGHT_KEYWORD * _overlap(keywords, c["keywords"])
        )
        if score > best_score:
            best, best_score = c, score
    if best is not None and best_score >= k.MERGE_THRESHOLD:
        best["categories"] |= categories
        best["keywords"] |= keywords
        best["at"] = at
        return best["id"], best_score
    open_clusters.append({"id": alert_id, "at": at, "categories": set(categories), "keywords": set(keywords)})
    return alert_id, None


class ClusterFold:
    """Assignment as a fold: the state is the open clusters in order of opening."""

    columns = ["categories", "keywords"]

    def __init__(self, id_type: str) -> None:
        self.outputs = f"cluster_id {id_type}, merge_score double"

    def fresh(self) -> list[dict]:
        return []

    def run(self, times: list[int], ids: list, columns: dict[str, list], state: list[dict]) -> list[list]:
        placed = [cluster_step(state, i, t, frozenset(c), frozenset(w)) for i, t, c, w in zip(ids, times, columns["categories"], columns["keywords"], strict=True)]
        return [[p[0] for p in placed], [p[1] for p in placed]]

    def expire(self, state: list[dict], at: int) -> list[dict]:
        return [c for c in state if c["at"] >= at - WINDOW]

    def pack(self, state: list[dict]) -> str:
        return json.dumps([[c["id"], c["at"], sorted(c["categories"]), sorted(c["keywords"])] for c in state])

    def unpack(self, text: str) -> list[dict]:
        return [{"id": i, "at": at, "categories": set(c), "keywords": set(w)} for i, at, c, w in json.loads(text)]


def place_alerts(alerts: DataFrame, partitions: int | None = None, slice_rows: int | None = None, start: DataFrame | None = None) -> tuple[DataFrame, replay.Replayed]:
    """`assign_clusters`, and the replay behind it: how many rounds it took and the states it ended with."""
    named = alerts.withColumn("competitor_name", trim_ws(F.coalesce("competitor_name", F.lit("")))).filter(
        F.length("competitor_name") > 0
    )
    narrow = named.select(
        "user_id", "competitor_name", F.col("alert_id").alias("row_id"), micros(F.col("created_at")).alias("t"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        extract_keywords(F.col("summary")).alias("keywords"),
    )
    keys = ["user_id", "competitor_name"]
    fold = ClusterFold(alerts.schema["alert_id"].dataType.simpleString())
    replayed = replay.replay(narrow, keys, fold, narrow.select(*keys, "t"), start, slice_rows, partitions)
    assigned = replayed.rows.select(F.col("row_id").alias("alert_id"), "cluster_id", "merge_score")
    return alerts.join(assigned, "alert_id", "left"), replayed


def assign_clusters(alerts: DataFrame, partitions: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """Add `cluster_id` (the id of the alert that opened it) and `merge_score` to alerts.

    An alert without a competitor stays unclustered. A key with many alerts is cut into slices
    that are replayed side by side until their states agree (`functions/replay.py`).
    """
    return place_alerts(alerts, partitions, slice_rows)[0]


def cluster_title(competitor: Column, categories: Column, summary: Column) -> Column:
    """Competitor and first category, or the first six words of the summary."""
    words = F.filter(F.split(trim_ws(summary), r"(?U)\s+"), lambda w: F.length(w) > 0)
    short = F.array_join(F.slice(words, 1, 6), " ")
    subject = F.when(F.size(categories) > 0, title_words(F.try_element_at(categories, F.lit(1)))).otherwise(short)
    return F.concat(competitor, F.lit(" — "), subject)


def cluster_cells(alerts: DataFrame) -> DataFrame:
    """Alerts combined per (cluster, tag, word): tag "c" for categories, "k" for keywords, and one
    cell without a word for the cluster as a whole.

    The alerts are read once and combined before the shuffle, so a cluster of many alike
    alerts moves only its vocabulary. Cells of several runs combine by `merge_cells`.
    """
    tagged = lambda tag, values: F.transform(values, lambda w: F.struct(F.lit(tag).alias("tag"), w.alias("word")))
    cells = F.concat(
        F.array(F.struct(F.lit("").alias("tag"), F.lit("").alias("word"))),
        tagged("c", F.array_distinct(F.coalesce("categories", F.array().cast("array<string>")))),
        tagged("k", extract_keywords(F.col("summary"))),
    )
    whole = F.col("_cell.tag") == ""
    first = F.struct(F.struct("created_at", "alert_id").alias("at"), F.struct("user_id", "competitor_name", "categories", "summary").alias("head"))
    return merge_cells(
        alerts.filter(F.col("cluster_id").isNotNull())
        .withColumn("_cell", F.explode(cells))
        .select(
            "cluster_id", "_cell.tag", "_cell.word", F.when(whole, first).alias("first"), F.lit(1).cast("bigint").alias("n"),
            severity_rank(F.col("severity")).alias("rank"), F.col("created_at").alias("first_at"), F.col("created_at").alias("last_at"),
        )
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cluster_id", "tag", "word").agg(
        F.min_by("first", "first.at").alias("first"),
        F.sum("n").alias("n"),
        F.max("rank").alias("rank"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


def cluster_rollup(alerts: DataFrame) -> DataFrame:
    """One row per cluster: counts, severity, title and the unions of categories and keywords."""
    return rollup_cells(cluster_cells(alerts))


def rollup_cells(words: DataFrame) -> DataFrame:
    def of_alerts(value) -> Column:
        return F.max(F.when(F.col("tag") == "", value))

    def gathered(tag: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("tag") == tag, F.col("word"))))

    base = words.groupBy("cluster_id").agg(
        F.first("first.head", ignorenulls=True).alias("f"),
        of_alerts(F.col("n")).alias("alert_count"),
        severity_name(of_alerts(F.col("rank"))).alias("severity"),
        of_alerts(F.col("first_at")).alias("created_at"),
        of_alerts(F.col("last_at")).alias("updated_at"),
        gathered("c").alias("categories"),
        gathered("k").alias("keywords"),
    )
    name = trim_ws(F.col("f.competitor_name"))
    return base.select(
        "cluster_id",
        "f.user_id",
        name.alias("competitor_name"),
        cluster_title(name, F.col("f.categories"), F.col("f.summary")).alias("title"),
        "severity",
        "alert_count",
        "categories",
        "keywords",
        F.lit(False).alias("is_resolved"),
        "created_at",
        "updated_at",
    )
