"""Replay of keys whose rules feed back on their own result, with a hot key spread over tasks.

A fold takes the rows of a key in order and a small state. Here a key with many rows is cut
into slices of about equal numbers of rows (bounds from a mergeable quantile sketch of the
key's times), and every slice is folded on its own from a guess of the state it begins with:
none. Then the states left behind are compared with those that were guessed. Only slices
whose real beginning differs are folded again, from the real one, and so on until nothing
differs. What comes out is then the serial replay, whatever was guessed: the first slice of a
key begins rightly, and each round settles at least one more slice after it.

States that forget (everything here does after a day or two) agree again after a few slices,
so two or three rounds are usual. A key whose state depends on its whole past takes as many
rounds as it has slices, at most `MAX_SLICES`: then the replay is serial, slice by slice.
`Replayed.rounds` says how many there were.

States are compared as text after `expire` has dropped what no longer matters at the first
row of the slice, so a pause that outlives the state always settles in the first round.
A task holds an Arrow batch and one state. Rounds are stored tables: a lost executor repeats
part of one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from changeflow.functions.spread import python_tasks
from changeflow.plans.storage import cut_lineage

SLICE_ROWS = 200_000
MAX_SLICES = 256
ROUNDS_CONF = "spark.changeflow.replaySliceRows"


class Fold(Protocol):
    """What a replay needs to know. States travel as text; equal states must have equal texts."""

    columns: list[str]
    outputs: str

    def fresh(self) -> Any: ...
    def run(self, times: list[int], ids: list, columns: dict[str, list], state: Any) -> list[list]: ...
    def expire(self, state: Any, at: int) -> Any: ...
    def pack(self, state: Any) -> str: ...
    def unpack(self, text: str) -> Any: ...


@dataclass
class Replayed:
    """`rows`: keys, row_id and the fold's outputs. `states`: keys and the state each key ends with."""

    rows: DataFrame
    states: DataFrame
    rounds: int


def hot_keys(sizes: DataFrame, keys: list[str], slice_rows: int) -> DataFrame:
    """The keys with more than `slice_rows` rows, and how many they have."""
    return sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > slice_rows)


def depth_bounds(sizes: DataFrame, hot: DataFrame, keys: list[str], slice_rows: int) -> DataFrame:
    """(keys, bounds) of hot keys: times that cut them into parts of about equal numbers of rows.

    `sizes` holds the keys and `t` of every row. Rows of one instant are never parted.
    """
    grid = [i / MAX_SLICES for i in range(1, MAX_SLICES)]
    sketch = sizes.join(hot.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("t", grid, 20 * MAX_SLICES).alias("_grid"))
    wanted = F.least(F.ceil(F.col("_n") / slice_rows), F.lit(MAX_SLICES)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), wanted - 1), lambda i: F.element_at("_grid", F.floor(i * MAX_SLICES / wanted).cast("int")))
    return hot.join(sketch, keys).select(*keys, F.array_distinct(picked).alias("_bounds"))


def _folding(fold: Fold, n_keys: int, n_outputs: int, schema: pa.Schema):
    """Rows sorted by (keys, slice, header first, t, row_id) stream through; one state is held."""

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, schema, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, begun, first = None, None, "", 0

        def ended() -> list:
            return [*place, None, *[None] * n_outputs, True, first, begun, fold.pack(state)]

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            places = list(zip(*columns[: n_keys + 1], strict=True))
            times, ids, given = columns[n_keys + 1], columns[n_keys + 2], columns[n_keys + 3]
            rest = columns[n_keys + 4 :]
            cuts = [i for i in range(len(places)) if not i or places[i] != places[i - 1]] + [len(places)]
            out: list[list] = [[] for _ in schema]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if places[low] != place:
                    if place is not None:
                        for column, value in zip(out, ended(), strict=True):
                            column.append(value)
                    place, begun = places[low], None
                    state = fold.fresh()
                if begun is None:
                    if given[low] is not None:
                        state = fold.unpack(given[low])
                        low += 1
                        if low == high:  # the rows follow in the next batch
                            first = None
                            continue
                    first = times[low]
                    state = fold.expire(state, first)
                    begun = fold.pack(state)
                made = fold.run(times[low:high], ids[low:high], {c: v[low:high] for c, v in zip(fold.columns, rest, strict=True)}, state)
                n = high - low
                for k, value in enumerate(place):
                    out[k] += [value] * n
                out[n_keys + 1] += ids[low:high]
                for k, values in enumerate(made):
                    out[n_keys + 2 + k] += values
                for k, value in enumerate((False, None, None, None)):
                    out[n_keys + 2 + n_outputs + k] += [value] * n
            yield batch_of(out)
        if place is not None and begun is not None:
            yield batch_of([[value] for value in ended()])

    return run


def replay(rows: DataFrame, keys: list[str], fold: Fold, sizes: DataFrame | None = None, start: DataFrame | None = None, slice_rows: int | None = None, partitions: int | None = None) -> Replayed:
    """Fold `rows` (keys, t in microseconds, row_id, the fold's columns) in the order of (t, row_id) per key.

    `sizes` is a cheap table with the keys and t of the same rows, to find hot keys by. `start`
    (keys, state) is what an earlier replay ended with; keys without rows keep it. Rows with a
    null key are left out: they have no place in an order.
    """
    spark = rows.sparkSession
    slice_rows = slice_rows or int(spark.conf.get(ROUNDS_CONF, str(SLICE_ROWS)))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    outputs = T.StructType.fromDDL(fold.outputs).names
    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "_slice int", f"row_id {types['row_id']}", fold.outputs, "_is_state boolean, _first bigint, _begun string, _ended string"])
    run = _folding(fold, len(keys), len(outputs), to_arrow_schema(T.StructType.fromDDL(schema)))
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
        sizes = sizes.filter(F.col(key).isNotNull()) if sizes is not None else None
    rows = rows.select(*keys, "t", "row_id", *fold.columns)

    hot = hot_keys(rows if sizes is None else sizes, keys, slice_rows)
    spread = not hot.isEmpty()
    if spread:
        bounds = cut_lineage(depth_bounds(rows if sizes is None else sizes, hot, keys, slice_rows), "slice-bounds")
        past = F.size(F.filter("_bounds", lambda b: b <= F.col("t")))
        sliced = rows.join(bounds, keys, "left").withColumn("_slice", F.when(F.col("_bounds").isNotNull(), past).otherwise(0)).drop("_bounds")
        sliced = cut_lineage(sliced, "replay-rows")
    else:
        sliced = rows.withColumn("_slice", F.lit(0))

    def folded(some: DataFrame, headers: DataFrame | None) -> DataFrame:
        lined = some.withColumn("_given", F.lit(None).cast("string"))
        if headers is not None:
            heads = headers.select(*keys, F.col("_slice"), F.col("_given"))
            lined = lined.unionByName(heads, allowMissingColumns=True)
        placed = lined.repartition(partitions or python_tasks(rows), *keys, "_slice")
        order = [*keys, "_slice", F.col("_given").asc_nulls_last(), "t", "row_id"]
        return placed.sortWithinPartitions(*order).select(*keys, "_slice", "t", "row_id", "_given", *fold.columns).mapInArrow(run, schema)

    first = None
    if start is not None:
        least = sliced.groupBy(*keys).agg(F.min("_slice").alias("_slice"))
        first = start.join(least, keys).select(*keys, "_slice", F.col("state").alias("_given"))
    if not spread:
        done = folded(sliced, first)
        done = cut_lineage(done, "replayed") if start is not None else done
        ends = done.filter("_is_state").select(*keys, F.col("_ended").alias("state"))
        return Replayed(done.filter("NOT _is_state").select(*keys, "row_id", *outputs), _kept(ends, start, keys), 1)

    made = cut_lineage(folded(sliced, first), "replayed").withColumn("_round", F.lit(0))
    along = Window.partitionBy(*keys).orderBy("_slice")
    settled = _states(made, keys)
    rounds = 1
    while True:
        before = settled.withColumn("_real", F.lag("_ended").over(along)).filter("_real IS NOT NULL")
        wrong = cut_lineage(before.select(*keys, "_slice", "_first", "_begun", "_real").mapInArrow(_differing(fold, keys), ", ".join([*(f"{c} {types[c]}" for c in keys), "_slice int, _given string"])), "replay-wrong")
        if wrong.isEmpty():
            break
        again = sliced.join(wrong.select(*keys, "_slice"), [*keys, "_slice"], "left_semi")
        made_again = cut_lineage(folded(again, wrong), "replayed").withColumn("_round", F.lit(rounds))
        made = made.unionByName(made_again)
        settled = cut_lineage(settled.unionByName(_states(made_again, keys)).groupBy(*keys, "_slice").agg(F.max_by(F.struct("_first", "_begun", "_ended", "_round"), "_round").alias("_s")).select(*keys, "_slice", "_s.*"), "replay-states")
        rounds += 1
    last = settled.select(*keys, "_slice", "_round")
    final = made.filter("NOT _is_state").join(last, [*keys, "_slice", "_round"], "left_semi")
    ends = settled.groupBy(*keys).agg(F.max_by("_ended", "_slice").alias("state"))
    return Replayed(final.select(*keys, "row_id", *outputs), _kept(ends, start, keys), rounds)


def _states(made: DataFrame, keys: list[str]) -> DataFrame:
    return made.filter("_is_state").select(*keys, "_slice", "_first", "_begun", "_ended", "_round")


def _kept(ends: DataFrame, start: DataFrame | None, keys: list[str]) -> DataFrame:
    return ends if start is None else ends.unionByName(start.select(*keys, "state").join(ends.select(*keys), keys, "left_anti"))


def _differing(fold: Fold, keys: list[str]):
    """Slices that did not begin with what the slice before them leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, begun, left = (batch.column(len(keys) + 1 + i).to_pylist() for i in range(3))
            real = [fold.pack(fold.expire(fold.unpack(state), t)) for state, t in zip(left, at, strict=True)]
            wrong = pa.array([i for i, (a, b) in enumerate(zip(real, begun, strict=True)) if a != b], pa.int64())
            columns = [*batch.columns[: len(keys) + 1], pa.array(real, pa.string())]
            yield pa.RecordBatch.from_arrays([c.take(wrong) for c in columns], names=[*keys, "_slice", "_given"])

    return run
