"""Places in a global order without one task that sees all rows.

Rows are range-partitioned by the order and sorted inside their partitions, once, into a
stored table. A row's place is its place in the partition plus the rows of the partitions
before: prefix sums over one count per partition. Ties must be settled by the order itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.functions.spread import python_tasks
from changeflow.plans.storage import cut_lineage

#: monotonically_increasing_id() keeps the partition above these bits and the row's number in them.
_ROW_BITS = 33


def sort_columns(order: list[str]) -> list[Column]:
    """Columns from "column" and "column desc" entries."""
    return [F.col(o.removesuffix(" desc")).desc() if o.endswith(" desc") else F.col(o).asc() for o in order]


def ranked(df: DataFrame, order: list[str], name: str = "place", partitions: int | None = None) -> DataFrame:
    """Add the place (from 1) of every row in the order; the last entry of `order` must be unique."""
    by = sort_columns(order)
    placed = df.repartitionByRange(partitions or python_tasks(df), *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    numbered = placed.withColumn("_at", at).withColumns({"_part": F.shiftright("_at", _ROW_BITS), "_nth": F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})
    stored = cut_lineage(numbered.drop("_at"), "ranked")
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, not per row.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    return stored.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).select(*df.columns, name)
