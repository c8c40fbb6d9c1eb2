"""Ordered scans that survive a hot key.

`Window.partitionBy(key)` puts every row of a key into one task. Here a key is cut
into slices of its own order (a day, an hour: an expression that never decreases
along the order). Rows are windowed inside (key, slice); one summary row per
(key, slice) is scanned along the key; the carry is joined back. A key that holds a
third of all rows is spread over as many tasks as it has slices, and the second
level sees at most one row per slice. Each slice is exact; nothing is capped.

Rows are shuffled once. The windows and the summaries read the same exchange: both are
made to need every column (a digest that is tested and dropped), so that column pruning
cannot tell them apart and Spark reuses it. Whatever came before a scan therefore runs
once, however many scans follow each other. Pass narrow rows in.

`slices` may list several columns (day, then id block, say); together they must be
non-decreasing along `order`. Keys and slices must not be null: a row without them
has no place on a time line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_day(c: str | Column) -> Column:
    return F.to_date(F.col(c) if isinstance(c, str) else c)


SLICE_CONF = "spark.changeflow.slice"


def by_time(c: str | Column) -> Column:
    """The slice the operators use: a day, or the unit the session names (hour, minute, second)
    where a key may hold very many rows of one day."""
    unit = SparkSession.active().conf.get(SLICE_CONF, "day")
    return by_day(c) if unit == "day" else F.date_trunc(unit, F.col(c) if isinstance(c, str) else c)


def by_hour(c: str | Column) -> Column:
    return F.date_trunc("hour", F.col(c) if isinstance(c, str) else c)


@dataclass
class Track:
    """One thing to follow along the key.

    Up to and including this row: count (of non-null values), sum, max, min, last (the
    latest non-null value). Around it: prev (array of up to `n` values before this row,
    oldest first), next (the value of the following row).
    """

    kind: str
    value: Column | None = None
    n: int = 1


def count(value: Column | None = None) -> Track:
    return Track("count", F.lit(1) if value is None else value)


def total(value: Column) -> Track:
    return Track("sum", value)


def highest(value: Column) -> Track:
    return Track("max", value)


def lowest(value: Column) -> Track:
    return Track("min", value)


def latest(value: Column) -> Track:
    return Track("last", value)


def before(value: Column, n: int = 1) -> Track:
    return Track("prev", value, n)


def following(value: Column) -> Track:
    return Track("next", value)


def _cut(df: DataFrame, keys: list[str], slices: list[Column]) -> tuple[DataFrame, list[str]]:
    """Slice columns added, rows placed by (key, slice)."""
    names = [f"_slice{i}" for i in range(len(slices))]
    cut = df.withColumns(dict(zip(names, slices)))
    for name in (*keys, *names):
        cut = cut.filter(F.col(name).isNotNull())
    return cut.repartition(*keys, *names), names


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return False
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return True


def _summary(cut: DataFrame, keys: list[str], names: list[str], order: list[str], tracks: dict[str, Track]) -> DataFrame:
    """One row per (key, slice): what each track passes on, in `_total_<name>`."""
    place = F.struct(*order)
    totals: list[Column] = []
    deepest = max((t.n for t in tracks.values() if t.kind == "prev" and t.n > 1), default=0)
    for name, track in tracks.items():
        value, sliced = track.value, f"_total_{name}"
        if track.kind in ("count", "sum", "max", "min"):
            fn = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}[track.kind]
            totals.append(fn(value).alias(sliced))
        elif track.kind == "last":
            totals.append(F.max_by(value, F.when(value.isNotNull(), place)).alias(sliced))
        elif track.kind == "next":
            totals.append(F.min_by(value, place).alias(sliced))
        elif track.kind == "prev" and track.n == 1:
            totals.append(F.array(F.max_by(value, place)).alias(sliced))
        elif track.kind == "prev":
            tail = F.collect_list(F.when(F.col("_from_end") <= track.n, F.struct((-F.col("_from_end")).alias("r"), value.alias("v"))))
            totals.append(F.transform(F.array_sort(tail), lambda s: s["v"]).alias(sliced))
        else:
            raise ValueError(f"unknown track: {track.kind}")
    summary = cut
    if deepest:
        summary = summary.withColumn("_from_end", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*[F.col(c).desc() for c in order])))
    summary = summary.groupBy(*keys, *names).agg(*totals, _digest(cut).alias("_digest"))
    return summary.filter(F.col("_digest").isNotNull()).drop("_digest")


def _digest(cut: DataFrame) -> Column:
    """Over every column, so that the two readers of the exchange are alike."""
    return F.bit_xor(F.xxhash64(*[f.name for f in cut.schema.fields if _hashable(f.dataType)]))


def _with_carry(summary: DataFrame, keys: list[str], names: list[str], carry: DataFrame | None) -> DataFrame:
    """The carry of an earlier run as one more slice of its key: without a slice value, so before all others."""
    if carry is None:
        return summary
    kinds = {f.name: f.dataType for f in summary.schema}
    before = carry.select(*[F.lit(None).cast(kinds[c]).alias(c) if c in names else F.col(c) for c in summary.columns])
    return summary.unionByName(before)


def scan(df: DataFrame, keys: list[str], order: list[str], slices: list[Column], carry: DataFrame | None = None, **tracks: Track) -> DataFrame:
    """Add one column per track. `order` must be unique within a key for a stable result.

    `carry` is what `carry_of` gave for earlier rows of the keys: the scan then goes on from
    there, and only new rows are read.
    """
    cut, names = _cut(df, keys, slices)
    ordered = Window.partitionBy(*keys, *names).orderBy(*order)
    here = ordered.rowsBetween(Window.unboundedPreceding, 0)
    along = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*names)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)

    local: dict[str, Column] = {}
    carries: list[Column] = []
    out: list[Column] = []
    for name, track in tracks.items():
        mine, sliced, carried = f"_local_{name}", f"_total_{name}", f"_carry_{name}"
        value, m, p = track.value, F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        if track.kind in ("count", "sum"):
            local[mine] = (F.count if track.kind == "count" else F.sum)(value).over(here)
            carries.append(F.sum(sliced).over(earlier).alias(carried))
            result = F.coalesce(m, F.lit(0)) + F.coalesce(p, F.lit(0))
        elif track.kind in ("max", "min"):
            fn, pick = (F.max, F.greatest) if track.kind == "max" else (F.min, F.least)
            local[mine] = fn(value).over(here)
            carries.append(fn(sliced).over(earlier).alias(carried))
            result = pick(m, p)
        elif track.kind == "last":
            local[mine] = F.last(value, ignorenulls=True).over(here)
            carries.append(F.last(sliced, ignorenulls=True).over(earlier).alias(carried))
            result = F.coalesce(m, p)
        elif track.kind == "next":
            local[mine] = F.lead(value).over(ordered)
            carries.append(F.lead(sliced).over(along).alias(carried))
            result = F.coalesce(m, p)
        elif track.kind == "prev":
            # Every slice has a row, so n slices back always hold the n rows needed.
            back = along.rowsBetween(-track.n, -1)
            local[mine] = F.collect_list(value).over(ordered.rowsBetween(-track.n, -1))
            carries.append(F.flatten(F.collect_list(sliced).over(back)).alias(carried))
            both = F.concat(F.coalesce(p, F.array()), m)
            result = F.when(F.size(both) > track.n, F.slice(both, -track.n, track.n)).otherwise(both)
        else:
            raise ValueError(f"unknown track: {track.kind}")
        out.append(result.alias(name))

    local["_mark"] = _digest(cut).over(here)
    summary = _with_carry(_summary(cut, keys, names, order, tracks), keys, names, carry)
    carried_in = summary.select(*keys, *names, *carries)
    scanned = cut.withColumns(local).filter(F.col("_mark").isNotNull())
    return scanned.join(carried_in, [*keys, *names]).select(*df.columns, *out)


def carry_of(df: DataFrame, keys: list[str], order: list[str], slices: list[Column], carry: DataFrame | None = None, **tracks: Track) -> DataFrame:
    """(keys, _total_..): what a later scan of the same tracks goes on from, one row per key.

    Store it with the results of the scan; keys without new rows keep what they had. A `next`
    track carries nothing: the last row of a key gets its successor when there is one.
    """
    cut, names = _cut(df, keys, slices)
    summary = _with_carry(_summary(cut, keys, names, order, tracks), keys, names, carry)
    place = F.struct(*names)
    merged = []
    for name, track in tracks.items():
        sliced = F.col(f"_total_{name}")
        if track.kind in ("count", "sum"):
            value = F.sum(sliced)
        elif track.kind in ("max", "min"):
            value = (F.max if track.kind == "max" else F.min)(sliced)
        elif track.kind == "last":
            value = F.max_by(sliced, F.when(sliced.isNotNull(), place))
        elif track.kind == "next":
            value = F.min(F.lit(None).cast(summary.schema[f"_total_{name}"].dataType))
        else:
            # The n newest slices hold the n newest rows.
            newest_first = F.when(F.col("_back") <= track.n, F.struct((-F.col("_back")).alias("r"), sliced.alias("v")))
            rows = F.flatten(F.transform(F.array_sort(F.collect_list(newest_first)), lambda s: s["v"]))
            value = F.when(F.size(rows) > track.n, F.slice(rows, -track.n, track.n)).otherwise(rows)
        merged.append(value.alias(f"_total_{name}"))
    if any(t.kind == "prev" for t in tracks.values()):
        summary = summary.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in names])))
    return summary.groupBy(*keys).agg(*merged)


def count_back(df: DataFrame, keys: list[str], ts: str, row_id: str, span_micros: int, slices_of, name: str) -> DataFrame:
    """How many rows of the key lie in [this row's time - span, this row], counting this row.

    Two points of one running count: the row itself and a probe placed `span` earlier,
    which sorts before the rows of its own instant (so the bound is inclusive). Probes
    travel without the other columns. `slices_of(column)` cuts the time.
    """
    rest = [c for c in df.columns if c not in (*keys, row_id)]
    shift = F.expr(f"INTERVAL {span_micros // 1_000_000} SECONDS")
    points = F.array(
        F.struct(F.lit(1).alias("hit"), F.col(ts).alias("at")),
        F.struct(F.lit(0).alias("hit"), (F.col(ts) - shift).alias("at")),
    )
    marked = df.withColumn("_p", F.explode(points)).select(
        *keys, row_id, F.col("_p.hit").alias("_hit"), F.col("_p.at").alias("_at"),
        F.when(F.col("_p.hit") == 1, F.struct(*rest)).alias("_row"),
    )
    counted = scan(marked, keys, ["_at", "_hit", row_id], [slices_of("_at")], _n=total(F.col("_hit")))
    size = F.sum(F.when(F.col("_hit") == 1, F.col("_n")).otherwise(-F.col("_n"))).cast("long")
    paired = counted.groupBy(*keys, row_id).agg(F.max_by("_row", "_hit").alias("_row"), size.alias(name))
    return paired.select(*keys, row_id, "_row.*", name).select(*df.columns, name)


def newest(df: DataFrame, keys: list[str], order: list[str], slices: list[Column], n: int, rank: str = "recency") -> DataFrame:
    """The `n` latest rows of each key, ranked from 1. Each slice first keeps its own `n` latest."""
    names = [f"_slice{i}" for i in range(len(slices))]
    cut = df.withColumns(dict(zip(names, slices)))
    backwards = [F.col(c).desc() for c in order]
    kept = cut.withColumn(
        rank, F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*backwards))
    ).filter(F.col(rank) <= n)
    final = kept.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*backwards)))
    return final.filter(F.col(rank) <= n).select(*df.columns, rank)
