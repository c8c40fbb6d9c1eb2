"""Quality rules as a ledger: each rule once, one bit each, policies applied to the bits.

`ledger` measures every text in one pass and stores the measurements and an integer of
failure bits. A policy is a named, versioned set of rules; applying another one, or asking
what a rule alone costs (`ablation`), reads the stored bits and never the texts again.

Everything is built-in column expressions. The only quadratic trap, words inside repeated
three-word windows, is solved inside the row: windows are hashed, and only rows in which a
hash comes twice sort their windows and measure the words they cover.

Defined cases: a null or empty text has all measurements 0 and fails `few_words`; repeated
rows are judged one by one; an empty table gives an empty ledger; columns of the input that
clash with the ledger's own are kept, and the ledger's get underscores before their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, fresh, let, read, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits; each fails on measurements alone, in whole numbers.
RULES = {
    "few_words": "{n_words} < 50",
    "repeated_windows": "100 * {n_repeat_words} > 50 * {n_words}",
    "symbols": "4 * {n_symbols} > {n_words}",
    "repeated_lines": "100 * {n_dup_lines} > 60 * {n_lines}",
    "shouting": "2 * {n_upper} > {word_chars}",
    "short_words": "{word_chars} < 2 * {n_words}",
    "long_words": "{word_chars} > 20 * {n_words}",
}


@dataclass(frozen=True)
class Policy:
    """A named and versioned set of rules; a text that fails one of them is rejected."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        order = list(RULES)
        return sum(1 << order.index(rule) for rule in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(RULES))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash comes twice or more, from the windows' hashes in order."""

    def positions(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
            after = F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
            return before | after

        return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["p"]))

    def length(starts: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            here = F.get(starts, i)
            return total + F.least(F.lit(3), F.coalesce(F.get(starts, i + 1), here + 3) - here)

        return F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0), step)

    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(let(keyed, positions), length)


def measured(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`df` with one column per measurement; also the names they got."""
    names = {m: fresh(df.columns, m) for m in MEASURES}
    own = [f"`{c}`" for c in df.columns]
    hold = {h: fresh(df.columns, h) for h in ("ledger_words", "ledger_lines", "ledger_windows")}
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words, lines, windows = (F.col(hold[h]) for h in hold)
    size = F.size(words)
    hashed = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    drop = lambda characters: F.length(F.translate(body, characters, ""))
    df = df.withColumns({hold["ledger_words"]: words_of(body), hold["ledger_lines"]: F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")})
    df = df.withColumn(hold["ledger_windows"], F.when(size >= 3, hashed).otherwise(F.array().cast("array<bigint>")))
    measures = {
        "n_words": size,
        "word_chars": drop(BLANKS),
        "n_symbols": F.length(body) - drop(SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_covered(windows)),
        "n_lines": F.size(lines),
        "n_upper": F.regexp_count(body, F.lit(r"\p{Lu}")),
    }
    # The measurements leave through a generator of one row. A filter on them is then not moved
    # below it, where the optimizer would write them out again, words inside loops over words.
    held = fresh(df.columns, "ledger_row")
    row = F.struct(*[value.cast("long").alias(name) for name, value in measures.items()])
    df = df.select(*own, F.explode(F.array(row)).alias(held))
    return df.select(*own, *[F.col(f"`{held}`.{m}").alias(c) for m, c in names.items()]), names


def ledger(df: DataFrame, text: str = "text", bits: str = "failed_bits") -> DataFrame:
    """Every row with its measurements and one integer of failure bits, in the order of RULES."""
    df, names = measured(df, text)
    each = [F.when(F.expr(rule.format(**{m: f"`{c}`" for m, c in names.items()})), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    total = each[0]
    for bit in each[1:]:
        total = total.bitwiseOR(bit)
    return df.withColumn(fresh(df.columns, bits), total)


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask)) == 0


def ablation(bits_of: DataFrame, policy: Policy, bits: str = "failed_bits") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it rejects, rows kept without it.

    Rows are first counted by their bits, so at most 2 ** len(RULES) rows meet. `bits_or`
    and `bits_and` say which rules came with this one at all, and always.
    """
    by = bits_of.groupBy(F.col(f"`{bits}`").bitwiseAND(F.lit(policy.mask)).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    order = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << order.index(r)).alias("bit")) for r in order if r in policy.rules])
    has = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return (
        by.select("mask", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            count(has).alias("failed"),
            count(F.col("mask") == F.col("r.bit")).alias("failed_alone"),
            count(F.col("mask").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"),
            F.coalesce(F.bit_or(F.when(has, F.col("mask"))), F.lit(0)).alias("bits_or"),
            F.coalesce(F.bit_and(F.when(has, F.col("mask"))), F.lit(0)).alias("bits_and"),
        )
        .select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "rule", "failed", "failed_alone", "kept_without", "bits_or", "bits_and")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measurements, its failure bits and the verdicts of both policies."""
    kept = ledger(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return kept.select(
        "doc_id",
        *MEASURES,
        "failed_bits",
        (~passes(F.col("failed_bits"), BASE)).alias("base_failed"),
        passes(F.col("failed_bits"), STANDARD).alias("kept"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the standard policy keeps."""
    bits = fresh([*docs.columns, *MEASURES], "failed_bits")
    return ledger(docs, bits=bits).filter(passes(F.col(bits), STANDARD)).select(*[f"`{c}`" for c in docs.columns])


ORACLE_OP10 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, doc_id, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
places AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM parts WHERE len(words) >= 3),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM places),
repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '\P{Lu}', '', 'g')) AS BIGINT) AS n_upper
  FROM parts LEFT JOIN repeats USING (r)),
b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (4 * n_symbols > n_words)::INT
         + 8 * (100 * n_dup_lines > 60 * n_lines)::INT + 16 * (2 * n_upper > word_chars)::INT
         + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 20 * n_words)::INT AS INTEGER) AS failed_bits
  FROM m)
SELECT *, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""
