"""Work and memory that must not grow faster than the rows."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from changeflow import configure
from changeflow.functions import constants as k
from changeflow.operators import cluster, noise


def best_by_hand(alerts, clusters):
    out = {}
    overlap = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    for a in alerts:
        met = []
        for c in clusters:
            near = a[6] - c[6]
            if c[5] or (a[1], a[2].strip()) != (c[1], c[2]) or not timedelta(0) <= near <= timedelta(hours=48):
                continue
            score = k.WEIGHT_TEMPORAL * 2 ** (-near.total_seconds() / 3600 / 4) + k.WEIGHT_CATEGORY * overlap(set(a[5]), set(c[3])) + k.WEIGHT_KEYWORD * overlap(set(a[4].split()), set(c[4]))
            met.append((-round(score, 12), c[7], c[0]))
        if met:
            out[a[0]] = min(met)[2]
    return out


def test_open_clusters_meet_alerts_by_likeness(spark):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    words, tags = ["pricing", "launch", "hiring"], ["a", "b"]
    minute = lambda: start + timedelta(minutes=rng.randrange(60 * 24 * 6))
    alerts = [(i, "u", rng.choice(["Acme", " Beacon "]), "high", " ".join(rng.sample(words, rng.randrange(0, 3))), rng.sample(tags, rng.randrange(0, 3)), minute()) for i in range(400)]
    clusters = []
    for i in range(500):
        at = minute()
        clusters.append((1000 - i, "u", rng.choice(["Acme", "Beacon"]), rng.sample(tags, rng.randrange(0, 3)), rng.sample(words, rng.randrange(0, 3)), i % 5 == 0, at, at - timedelta(hours=rng.randrange(3))))
    clusters += [(c[0] + 5000, *c[1:]) for c in clusters[:100]]  # alike in everything but the id
    new = spark.createDataFrame(alerts, "alert_id int, user_id string, competitor_name string, severity string, summary string, categories array<string>, created_at timestamp")
    given = spark.createDataFrame(clusters, "cluster_id int, user_id string, competitor_name string, categories array<string>, keywords array<string>, is_resolved boolean, updated_at timestamp, created_at timestamp")
    got = {r.alert_id: r.cluster_id for r in cluster.score_open_clusters(new, given).collect()}
    assert got == best_by_hand(alerts, clusters)


def test_alike_clusters_make_no_pairs(spark):
    """4,000 alerts and 4,000 alike clusters of one cell were 16 million pairs."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 3000)
    base = spark.range(4000).select(F.col("id").alias("alert_id"), F.lit(1).alias("user_id"), F.lit("Acme").alias("competitor_name"), F.lit("pricing launch").alias("summary"), F.array(F.lit("a")).alias("categories"), at.alias("created_at"))
    given = base.select(F.col("alert_id").alias("cluster_id"), "user_id", "competitor_name", "categories", F.array(F.lit("pricing")).alias("keywords"), F.lit(False).alias("is_resolved"), "created_at", F.col("created_at").alias("updated_at"))
    best = cluster.score_open_clusters(base, given)
    rows = {r.alert_id: r.cluster_id for r in best.collect()}
    assert len(rows) == 4000 and all(rows[i] == i % 3000 for i in rows)
    made, todo = [], [best._jdf.queryExecution().executedPlan()]
    while todo:  # the rows that every operator gave out
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        if hasattr(plan, "plan") and "QueryStage" in plan.nodeName():
            todo.append(plan.plan())
        if plan.metrics().contains("numOutputRows"):
            made.append(plan.metrics().apply("numOutputRows").value())
        kids = plan.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    assert made and max(made) <= 16_000


def test_patterns_are_tested_where_they_are(spark):
    odd = ["plain text, with. dots|bars^ $", "a(b", "a(b)", "[x", "[x]", "*a", "a*", "a{2,1}", "a{1,2}", "x\\", "\\d", "(?P<n>a)(?P<n>b)", "(?<=a+)b", "", ")", "]", "a++b", "{", "}"]
    df = spark.createDataFrame([(p,) for p in [*odd, None, "a(b"]], "pattern string")
    checked = noise.valid_patterns(df)

    def compiles(p):
        try:
            return bool(re.compile(p)) or True
        except re.error:
            return False

    got = {r.pattern: r.is_valid for r in checked.collect()}
    assert got == {**{p: compiles(p) for p in odd}, None: None} and checked.count() == len(odd) + 2
    assert "Exchange" not in checked._jdf.queryExecution().executedPlan().toString()


def test_a_batch_for_python_is_bounded_in_bytes(spark):
    configure(spark)
    pages = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("0123456789"), 10_000).alias("html"))  # 60 MB

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    assert max(r.n for r in pages.mapInArrow(sizes, "n bigint").collect()) < 10_000_000
