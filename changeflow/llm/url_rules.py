"""URL filtering: explicit host and path rules first, then association rules mined from labels.

A url becomes a set of tokens: host labels, path segments (numbers as one token), an ending
and the names of its parameters. Labelled urls with their label as one more item go to
Spark's FP-growth. Rules with the label `block` as consequent stay if support and confidence
suffice and no rule on fewer of their tokens is as confident. Matching goes by an inverted
index: a rule hangs on its rarest token only, a url meets the rules of its tokens, and array
functions check the rest, so no url meets a rule that shares just a common token.

A url's label is the verdict of an explicit rule where one fits, else what `labels` says of
the row with the same id (block if toxic or of low quality). Everything is built-in.

Defined cases: a null url, and one without `://`, has empty host and path, no tokens, and is
allowed; repeated rows are judged one by one; without labels nothing is mined and what no
rule decides is allowed; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.plans.storage import cut_lineage

from .common import read

#: Fixed values: (host, path, verdict).
EXPLICIT = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: A rule's share of the labelled urls, the rows it needs at least, and its confidence.
SUPPORT, ROWS, CONFIDENCE = 0.002, 25, 0.85
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def explicit_rule(host: Column, path: Column, rules=EXPLICIT) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, outcome in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens, marked by where they stand."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), r"[0-9]+", "#")))
    ending = F.filter(F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)), lambda x: x != "")
    ending = F.transform(ending, lambda x: F.concat(F.lit("e:"), x))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(labels, segments, ending, names)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rows: int = ROWS) -> DataFrame:
    """Block rules (tokens, key, confidence, support) from rows of (tokens, label)."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "label"))).alias("items"))
    support = min(1.0, max(support, rows / max(1, items.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    frequent = model.freqItemsets.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), "freq")
    rules = model.associationRules.filter((F.get("consequent", F.lit(0)) == "=block") & ~F.exists("antecedent", lambda x: x.startswith("="))).select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    # The rarest token of each rule is its place in the index.
    keys = rules.select("tokens", F.explode("tokens").alias("token")).join(frequent, "token").groupBy("tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    rules = cut_lineage(rules.join(keys, "tokens"), "url-rules")
    # A rule that a rule on fewer of its tokens equals adds nothing.
    each = rules.select("tokens", "confidence", F.explode("tokens").alias("key"))
    shorter = rules.select(F.col("tokens").alias("fewer"), F.col("confidence").alias("other"), "key")
    idle = each.join(shorter, "key").filter((F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0) & (F.col("other") >= F.col("confidence"))).select("tokens").distinct()
    return rules.join(idle, "tokens", "left_anti")


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (row, tokens, ...) with `blocked`, whether a rule's tokens are all there."""
    at = urls.select("row", "tokens", F.explode("tokens").alias("key"))
    hits = at.join(rules.select("key", F.col("tokens").alias("needed")), "key").filter(F.size(F.array_except("needed", "tokens")) == 0).select("row").distinct()
    return urls.join(hits.withColumn("blocked", F.lit(True)), "row", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: id, host, path, the explicit rule if one fits, and the verdict."""
    host, path = host_and_path(F.col("url"))
    narrow = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.monotonically_increasing_id().alias("row")).withColumns({"host": host, "path": path})
    rule, verdict = explicit_rule(F.col("host"), F.col("path"))
    narrow = narrow.withColumns({"rule": rule, "given": verdict, "tokens": tokens_of(F.col("url"), F.col("host"), F.col("path"))}).drop("url")
    stored = cut_lineage(narrow, "url-tokens")
    labelled = stored.filter("given IS NOT NULL").select("tokens", F.col("given").alias("label"))
    if labels is not None:
        said = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
        known = stored.filter("given IS NULL").join(said.filter("bad IS NOT NULL"), "page_id").select("tokens", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("label"))
        labelled = labelled.union(known)
    mined = mine(labelled.filter(F.size("tokens") > 0), support, confidence)
    open_rows = judge(stored.filter("given IS NULL"), mined)
    decided = stored.filter("given IS NOT NULL").select("page_id", "host", "path", "rule", F.col("given").alias("verdict"))
    return decided.union(open_rows.select("page_id", "host", "path", "rule", F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict")))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
