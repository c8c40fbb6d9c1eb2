"""Column helpers for text and time. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeflow.functions.constants import SEVERITY_ORDER

# Java flags that give Python's meaning to a pattern: Unicode classes (U) and case
# folding (u), and only "\n" as a line terminator for ".", "^" and "$" (d).
PY_FLAGS = "(?duU)"
PY_FLAGS_NOCASE = "(?diuU)"
_BLANK = r"[\s\x1c-\x1f]"


def trim_ws(c: Column) -> Column:
    """Strip every kind of Unicode whitespace, not only spaces."""
    return F.regexp_replace(c, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def collapse_ws(c: Column) -> Column:
    """Strip, then turn each whitespace run into one space."""
    return F.regexp_replace(trim_ws(c), f"(?U){_BLANK}+", " ")


def is_blank(c: Column) -> Column:
    """Null, or whitespace only; a long text is read up to its first other character."""
    return F.coalesce(~c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(PY_FLAGS_NOCASE + pattern)


def remove_all(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, PY_FLAGS_NOCASE + pattern, "")


def micros(c: Column) -> Column:
    """Microseconds since the epoch; the session zone is UTC, so zoned and unzoned agree."""
    return F.unix_micros(c.cast("timestamp"))


def hours(n: float) -> int:
    return int(n * 3_600_000_000)


def days(n: float) -> int:
    return hours(24 * n)


def lookup(c: Column, mapping: dict, default) -> Column:
    """A literal map as a `when` chain: folds into codegen, no join."""
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(c: Column) -> Column:
    """critical 4 .. noise 0; anything unknown is 0."""
    return lookup(c, SEVERITY_ORDER, 0)


def severity_name(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in SEVERITY_ORDER.items()}, "noise")


def steady_round(c: Column, places: int) -> Column:
    """Round a result of float sums. Noise from the order of summation is cut off first, so a
    decimal tie falls the same way however the rows were partitioned."""
    return F.round(F.round(c, 10), places)


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def title_words(c: Column) -> Column:
    """Title case for names made of letters, digits and underscores."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def like_literal(text: str) -> str:
    """User text as a literal part of a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
