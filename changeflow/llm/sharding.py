"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring; a document belongs to the first point at or after
the hash of its id. A shard takes at most its bound. Documents of its arcs beyond that go
on clockwise, arc by arc, to shards that still have room. All that depends on is how many
documents each arc has, so the flow is settled on one count per arc (shards x points,
bounded by parameters): every arc gets a few intervals of ranks, each with a shard and a
first slot. Documents find theirs by arc and rank; ranks are numbered in parallel.

With `slack` 0 the bounds add up to the number of documents, so every shard is filled
exactly: counts are at most one apart (the law `rows`). More slack moves fewer documents
when shards come or go.

Only built-in expressions are used. Documents with equal ids share an arc, whose ranks are
numbered in many buckets, so a repeated id does not gather in a task.

Defined cases: a null text has size 8 and checksum 0; a null id hashes as the empty text;
repeated rows are placed one by one; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.plans.storage import cut_lineage

from .common import read, small_table
from .packing import ranked

SHARDS, POINTS, SLACK = 24, 128, 0.0
CELLS = 4096  # equal parts of the ring, to find an arc by equality
_SPAN = 1 << 32


def ring(shards: int, points: int) -> list[tuple[int, int]]:
    """(position, shard) in clockwise order; a shard's points do not depend on the others."""
    return sorted((int(hashlib.md5(f"shard {s} point {p}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for p in range(points))


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """How many documents each shard may take; they add up to `total` at least."""
    if slack:
        return [-int(-(1 + slack) * total // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def flow(owners: list[int], counts: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot): own arcs first, then clockwise."""
    room, used, out, over = list(room), [0] * len(room), [], []

    def take(arc: int, first: int, last: int, shard: int) -> int:
        n = min(last - first, room[shard])
        if n:
            out.append((arc, first, first + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n
        return first + n

    for arc, (shard, n) in enumerate(zip(owners, counts, strict=True)):
        first = take(arc, 0, n, shard)
        if first < n:
            over.append((arc, first, n))
    for arc, first, last in over:
        at = arc
        while first < last:
            at = (at + 1) % len(owners)
            first = take(arc, first, last, owners[at])
    return out


def position(key: Column) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def arcs_of(df: DataFrame, at: str, points: list[tuple[int, int]]) -> DataFrame:
    """Adds `arc`, the index of the first point at or after the position; after the last, the first."""
    width = _SPAN // CELLS
    cells: list[list[tuple[int, int]]] = [[] for _ in range(CELLS)]
    for arc, (place, _) in enumerate(points):
        cells[place // width].append((place, arc))
    following, rows = 0, []
    for cell in range(CELLS - 1, -1, -1):
        rows.append((cell, [p for p, _ in cells[cell]], [a for _, a in cells[cell]], following))
        following = cells[cell][0][1] if cells[cell] else following
    table = small_table(df.sparkSession, rows, "cell int, places array<bigint>, arcs array<int>, following int")
    behind = F.size(F.filter("places", lambda p: p < F.col(at)))
    return (
        df.withColumn("cell", F.floor(F.col(at) / width).cast("int"))
        .join(F.broadcast(table), "cell")  # CELLS rows
        .withColumn("arc", F.coalesce(F.get("arcs", behind), F.col("following")))
        .drop("cell", "places", "arcs", "following")
    )


def shard_rows(df: DataFrame, shards: int = SHARDS, points: int = POINTS, slack: float = SLACK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, checksum, shard and slot."""
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = df.select(
        F.col(f"`{key}`").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        position(F.col(f"`{key}`")).alias("position"),
        F.monotonically_increasing_id().alias("salt"),
    )
    points_of = ring(shards, points)
    stored = cut_lineage(arcs_of(narrow, "position", points_of).drop("position"), "sharding-rows")
    found = {row["arc"]: row["count"] for row in stored.groupBy("arc").count().collect()}  # at most shards x points rows
    counts = [found.get(arc, 0) for arc in range(len(points_of))]
    intervals = flow([s for _, s in points_of], counts, bounds(sum(counts), shards, slack))
    table = small_table(spark, intervals, "arc int, first bigint, after bigint, shard int, slot bigint")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ranked(stored, "arc", ["salt"], width).alias("d").join(F.broadcast(table).alias("i"), F.expr("d.arc = i.arc AND d.rank >= i.first AND d.rank < i.after"))  # at most arcs + arcs x shards rows
    return placed.select("doc_id", "size", "text_crc32", F.col("i.shard").alias("shard"), (F.col("i.slot") + F.col("d.rank") - F.col("i.first")).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
