"""Canonical tables derived from the benchmark tables, so that every operator can be
run and checked on them. Each adapter is a plain projection with a SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.session import configure

VERSIONS = 12
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table. Texts that lie in fewer splits than there are cores are spread first.

    Work per text is heavy, so a small file must not end up in one task; a large table has
    more splits than cores and is read as it lies, without a shuffle.
    """
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df.rdd.getNumPartitions() < 2 * cores:
        return df.repartition(cores)
    return df


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque*")


def analyses(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS diff_id",
        "user_id AS monitor_id",
        "user_id % 10 AS user_id",
        "CASE WHEN user_id % 30 = 7 THEN '  ' ELSE concat('comp', user_id % 30) END AS competitor_name",
        """CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium'
           WHEN 'click' THEN 'low' ELSE 'noise' END AS severity""",
        "concat(event_type, ' ', props) AS summary",
        """CASE event_type WHEN 'error' THEN array('technical_change') WHEN 'purchase' THEN array('pricing_change', 'feature_launch')
           WHEN 'signup' THEN array('messaging_change') WHEN 'click' THEN array('hiring_signal') ELSE array('other') END AS categories""",
        "ts AS created_at",
    )


def alerts(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    return (
        analyses(spark, sf_dir, read)
        .filter(F.col("severity").isin("critical", "high", "medium"))
        .withColumnRenamed("diff_id", "alert_id")
        .withColumn("is_acknowledged", F.col("alert_id") % 3 == 0)
        .withColumn("notified_at", F.when(F.col("alert_id") % 4 == 0, F.col("created_at")))
    )


def snapshots(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS snapshot_id", "user_id AS monitor_id", "event_type AS text_hash", "ts AS created_at"
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = 1704067200000000  # 2024-01-01 in microseconds; time is stretched twelve times
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS monitor_id",
        "event_type AS pattern",
        "event_id AS diff_id",
        "0.58D + 0.42D * (event_id % 97) / 97 AS similarity",
        """CASE get_json_object(props, '$.k') WHEN '0' THEN 'price_or_percentage_signal'
           WHEN '1' THEN 'change_action_word' END AS blocked_reason""",
        f"""CAST(timestamp_micros({base} + 12 * (unix_micros(CAST(ts AS TIMESTAMP)) - {base})) AS TIMESTAMP_NTZ)
            AS observed_at""",
    )


def filter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS monitor_id", "event_type AS pattern", "event_id AS diff_id", "ts AS at",
        "CAST(1 + event_id % 5 AS INT) AS count",
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve dated versions of every document: numbered lines, some of them dropped, and a footer that counts up."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(": "), x))
    docs = table(spark, sf_dir, "documents").select("doc_id", numbered.alias("lines"))
    exploded = docs.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(VERSIONS - 1))))
    kept = F.filter("lines", lambda x, i: (i + 1) % (F.col("version") + 7) != 0)
    footer = F.concat(F.lit("Last updated: March "), F.col("version").cast("string"))
    return exploded.select(
        (F.col("doc_id") * 100 + F.col("version")).alias("snapshot_id"),
        F.col("doc_id").alias("monitor_id"),
        "version",
        F.concat(F.array_join(kept, "\n"), F.lit("\n"), footer).alias("extracted_text"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(version)").alias("created_at"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one diff in long form, with noise lines mixed in."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .selectExpr(
            "doc_id AS diff_id",
            "doc_id AS monitor_id",
            "pos AS seq",
            "CAST(pos DIV 8 AS INT) AS hunk_no",
            "CASE pos % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END AS op",
            """CASE pos % 7 WHEN 2 THEN concat('2024-03-1', pos % 10, ' 10:00') WHEN 4 THEN concat('utm_source=x', doc_id, ' ')
               WHEN 5 THEN concat(line, ' session_id=', doc_id) WHEN 6 THEN concat('Build v', pos, ' for site ', doc_id)
               WHEN 1 THEN concat('visits: ', pos) ELSE line END AS text""",
        )
    )


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS monitor_id",
        "CAST(s_nationkey AS BIGINT) AS user_id",
        "concat('https://site', s_suppkey % 4, '.example.com/p', s_suppkey % 3) AS url",
        "s_name AS name",
        "concat('comp', s_suppkey % 30) AS competitor_name",
        """element_at(array('pricing', 'changelog', 'homepage', 'jobs', 'blog', 'docs', 'other'), CAST(s_suppkey % 7 AS INT) + 1)
           AS page_type""",
        "s_suppkey % 5 <> 0 AS is_active",
        "6 AS check_interval_hours",
        "TIMESTAMP_NTZ '2024-01-15 00:00:00' + make_dt_interval(0, 0, CAST(s_suppkey * 7919 % 1000 AS INT) - 500) AS next_check_at",
        """CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP_NTZ '2024-01-15 00:00:00'
           - make_dt_interval(0, 0, CAST(s_suppkey * 31 % 90 AS INT)) END AS last_checked_at""",
        """CASE WHEN s_suppkey % 9 = 0 THEN TIMESTAMP_NTZ '2024-01-15 00:00:00'
           - make_dt_interval(CAST(s_suppkey % 60 AS INT)) END AS deleted_at""",
        "TIMESTAMP_NTZ '2023-01-01 00:00:00' + make_dt_interval(0, CAST(s_suppkey % 5000 AS INT)) AS created_at",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id", "concat(lower(c_name), '@example.com') AS email", "c_acctbal >= 0 AS is_active"
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels for every customer."""
    return (
        table(spark, sf_dir, "customer")
        .withColumn("ch", F.explode(F.array(F.lit(0), F.lit(1))))
        .selectExpr(
            "c_custkey AS user_id",
            "CASE ch WHEN 0 THEN 'slack' ELSE 'email' END AS channel",
            "(c_custkey + ch) % 5 <> 0 AS is_enabled",
            "CASE c_custkey % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'critical' END AS min_severity",
            "CASE WHEN ch = 0 AND c_custkey % 7 <> 0 THEN concat('https://hooks.example.com/', c_custkey) END AS webhook_url",
            "CASE WHEN ch = 1 THEN concat(lower(c_name), '@example.com') END AS email_address",
            "(c_custkey + ch) % 2 = 0 AS digest_mode",
            "CAST(CASE c_custkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 9 WHEN 3 THEN c_custkey % 24 END AS INT) AS digest_hour_utc",
        )
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS attempt_id",
        "user_id AS monitor_id",
        "ts AS attempted_at",
        "event_type NOT IN ('error', 'purchase') AS ok",
        "CASE WHEN event_type IN ('error', 'purchase') THEN concat(event_type, ': ', repeat(props, 60)) END AS error",
        "CASE WHEN event_type = 'click' THEN 'browser' ELSE 'http' END AS render_method",
        "user_id % 11 = 0 AS use_override",
        "user_id % 2 = 0 AS has_fallback",
        "event_type <> 'error' AS primary_ok",
        "event_type = 'view' AND value < 5 AS bot_page",
        "event_id % 3 <> 0 AS fallback_ok",
    )


def request_log(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id",
        "ts",
        "user_id AS client",
        "CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method",
        "CASE WHEN event_type = 'view' THEN '/api/v1/health' ELSE concat('/api/v1/', event_type) END AS path",
        "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status",
        "value / 100 AS seconds",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses in six shapes: valid, unknown level, unknown category, no category, no summary, none."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS diff_id",
        "user_id AS monitor_id",
        "ts AS created_at",
        """CASE event_id % 6
           WHEN 0 THEN concat('{"significance_level":"high","summary":"', event_type, ' moved","categories":["pricing_change","other"]}')
           WHEN 1 THEN concat('{"significance_level":"urgent","summary":"', event_type, '","categories":["hiring_signal"]}')
           WHEN 2 THEN concat('{"significance_level":"low","summary":"', repeat(event_type, 300), '","categories":["partnership","unheard_of"]}')
           WHEN 3 THEN concat('{"significance_level":"critical","summary":"', event_type, '","categories":[]}')
           WHEN 4 THEN '{"significance_level":"noise","categories":["feature_removal"]}' END AS body""",
        "CAST(100 + event_id % 900 AS INT) AS prompt_tokens",
        "CAST(20 + event_id % 200 AS INT) AS completion_tokens",
        "CASE WHEN event_id % 6 = 5 THEN 'timeout' END AS error",
    )


def free_text_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as unstructured answers, with level and category words mixed in."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        """concat(CASE (conv_id + turn) % 6 WHEN 0 THEN 'This is CRITICAL: a pricing change. ' WHEN 1 THEN 'Looks high, feature_launch. '
           WHEN 2 THEN 'Highly unusual noise. ' WHEN 3 THEN 'another Hiring Signal, low value. ' WHEN 4 THEN 'Partnership news. '
           ELSE '' END, text) AS text""",
    )
