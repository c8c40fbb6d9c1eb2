"""Typed reads and writes of the canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.schemas import SCHEMAS


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a canonical table with its declared schema; nothing is inferred.

    A table in date folders (`write_table`) has their `day` as a last column, to filter on.
    """
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(path)


def stream_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a stream of files as they land."""
    reader = spark.readStream.schema(SCHEMAS[name]).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def write_table(df: DataFrame, path: str, time_col: str | None = None, mode: str = "append") -> None:
    """Write Parquet; with `time_col`, in date folders so that retention and scans prune them."""
    writer = df
    if time_col:
        writer = df.withColumn("day", F.to_date(time_col)).write.partitionBy("day")
    else:
        writer = df.write
    writer.mode(mode).parquet(path)


def append_once(
    existing: DataFrame | None, incoming: DataFrame, key: list[str], version: list[str] | None = None
) -> DataFrame:
    """Rows of `incoming` to append: one per key, and none for a key already stored.

    Of several incoming rows with one key the first by `version` is kept. The pick is
    a grouped min, combined before the shuffle, so a key repeated many times is cheap.
    """
    version = version or [c for c in incoming.columns if c not in key]
    rest = [c for c in incoming.columns if c not in key]
    fresh = (
        incoming.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct(*version)).alias("_row"))
        .select(*key, "_row.*")
        .select(*incoming.columns)
    )
    return fresh if existing is None else fresh.join(existing.select(*key), key, "left_anti")


def append_stream(stream: DataFrame, path: str, key: list[str], checkpoint: str, version: list[str] | None = None, timeout: int | None = None) -> None:
    """`append_once` batch by batch: rows of keys that are stored already are left out.

    Each micro-batch has a folder of its own. A batch that is repeated after a failure does not
    see what its first attempt stored, and overwrites it, so a key is stored once whatever fails.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = None
        if batch_id:
            schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in batch.schema if f.name in key)}, batch bigint"
            stored = spark.read.schema(schema).parquet(path).filter(F.col("batch") < batch_id)
        append_once(stored, batch, key, version).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    running = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not running.awaitTermination(timeout) and timeout is not None:
        running.stop()
        raise TimeoutError(f"the stream was not done after {timeout} s; {path} holds part of its result")


def upsert_state(current: DataFrame, changes: DataFrame, key: list[str], version: list[str | Column]) -> DataFrame:
    """Last write wins per key over `current` and `changes`."""
    rest = [c for c in current.columns if c not in key]
    merged = current.unionByName(changes.select(*current.columns))
    return (
        merged.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
        .select(*key, "_row.*")
        .select(*current.columns)
    )
