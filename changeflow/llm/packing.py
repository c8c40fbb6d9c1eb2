"""Packing token pieces into sequences: shortest pack first, over the histogram of lengths.

A document's ids (and the closing id) are cut into pieces of at most the sequence length.
Only the histogram of piece lengths, one count per length, reaches the driver. There the
lengths are placed longest first: always into the kind of pack that is fullest of room
(the shortest), as many at once as both counts allow, so a pattern of lengths carries a
count and no pack is ever named. Patterns then go back to the pieces by rank: the r-th piece
of a length takes the r-th place that the patterns have for that length. Ranks come from
counts per (length, bucket) and a row number inside the bucket, so a length that a third of
all pieces share is numbered by many tasks. A sequence that holds a power of two of ids
needs no padding.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed one by
one; an empty table has no pieces; columns of the input that clash are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeflow.plans.storage import cut_lineage

from .bpe import PATTERN, Encoder, Merges, tokenizer_path
from .common import read

CAPACITY = 1024
CLOSING = 0


def _ranks_path(json_path: str) -> str:
    """The file of the same vocabulary as ranks, beside the tokenizer's own."""
    return json_path.removesuffix(".json") + ".tiktoken"


def ids_of(json_path: str):
    """A function from a text to its ids; the same ids by a compiled library where it copes."""
    import base64

    import tiktoken

    merges = Merges(json_path)
    with open(_ranks_path(json_path), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=merges.special)
    own = Encoder(merges)
    special = set(merges.special)
    longest = 1 << 18  # longer texts go through the transducer, which needs no stack or heap of their size

    def ids(text: str) -> np.ndarray:
        if len(text) <= longest:
            return library.encode_to_numpy(text, allowed_special=special)
        return np.frombuffer(b"".join(own.stream(text)), dtype="<u4")

    return ids


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every row: where they start, how long they are, a checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path)
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                packed = np.append(encode(value.as_py() or ""), CLOSING).astype("<u4").tobytes()
                n = len(packed) >> 2
                for at in range(0, n, capacity):
                    part = packed[4 * at : 4 * (at + capacity)]
                    rows.append(i)
                    start.append(at)
                    length.append(len(part) >> 2)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(count, ((length, copies), ...)) for each pattern, from a count per length.

    Packs of one pattern are handled together. For each length, longest first, the pattern
    with most room takes as many copies as fit, or as there are; what is left starts new
    packs. At most capacity lengths and as many kinds of room: bounded by the parameter.
    """
    rooms: dict[int, list[tuple[int, tuple]]] = {}

    def put(room: int, count: int, pattern: tuple) -> None:
        if count:
            rooms.setdefault(room, []).append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in rooms.items() if packs and r >= length), default=None)
            if room is None:
                copies = capacity // length
                whole, rest = divmod(left, copies)
                put(capacity - copies * length, whole, ((length, copies),))
                if rest:
                    put(capacity - rest * length, 1, ((length, rest),))
                break
            count, pattern = rooms[room].pop()
            used = min(count, left)
            put(room, count - used, pattern)
            put(room - length, used, _with(pattern, length))
            left -= used
    return [pack for room in sorted(rooms) for pack in rooms[room]]


def _with(pattern: tuple, length: int) -> tuple:
    if pattern and pattern[-1][0] == length:
        return (*pattern[:-1], (length, pattern[-1][1] + 1))
    return (*pattern, (length, 1))


def places(patterns: list) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first ranks of the intervals, and for each its sequence, copies and offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            rows.setdefault(length, []).append((count * copies, sequence, copies, offset))
            offset += length * copies
        sequence += count
    return {length: (np.array([0, *accumulate(r[0] for r in rs)][:-1]), *[np.array([r[k] for r in rs]) for k in (1, 2, 3)]) for length, rs in rows.items()}


def ranked(df: DataFrame, key: str, order: list[str], width: int) -> DataFrame:
    """A gapless rank from 0 inside each key, numbered by many tasks; `df` must be stored."""
    df = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(width)))
    counts = df.groupBy(key, "bucket").count()
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(key, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(key, "bucket").orderBy(*order)
    return df.withColumn("at", F.row_number().over(within)).join(bases, [key, "bucket"]).withColumn("rank", F.col("base") + F.col("at") - 1).drop("bucket", "base", "at")


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = df.sparkSession
    cut = pieces(df, path, capacity, id_col, text).withColumn("salt", F.monotonically_increasing_id())
    stored = cut_lineage(cut, "packing-pieces")
    histogram = {row["length"]: row["count"] for row in stored.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(pack_patterns(histogram, capacity))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                here = lengths == length
                first, base, copies, at = table[int(length)]
                k = np.searchsorted(first, ranks[here], "right") - 1
                inside = ranks[here] - first[k]
                sequence[here] = base[k] + inside // copies[k]
                offset[here] = at[k] + (inside % copies[k]) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = ranked(stored, "length", ["salt", "doc_id", "start"], width).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return numbered.mapInArrow(assign, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the pieces of the documents kept so far and their places."""
    return pack(docs, tokenizer_path())
