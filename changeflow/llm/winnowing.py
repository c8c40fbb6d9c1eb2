"""Document fingerprints by winnowing.

Every window of `WINDOW` neighbouring k-gram hashes gives up its least hash, the rightmost
of equal ones; a hash that several windows give counts once, and its position is kept. So
two texts that share WINDOW + GRAM - 1 code points share a fingerprint, and its positions
say where. The likeness of two texts is the Jaccard similarity of their sets of hashes.

Texts are hashed in blocks of array operations; long texts go block by block with the
windows' overlap, so memory does not grow with a text.

A text is compared with the next one by descending doc_id. Rows are range-partitioned in
that order and stream through; each part passes its first and last row on, and the few rows
at the seams (two per part) are joined afterwards.

Defined cases: null and empty texts have no hashes, and two such are alike (1.0); a text
shorter than a k-gram is one gram; with one document alone, the next one is itself; equal
ids follow each other in the order of their text's hash, null ids come last; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.plans.storage import cut_lineage

from .common import read, small_table

GRAM, WINDOW, BLOCK = 8, 8, 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """Upper 32 bits of a mixed polynomial hash of each k-gram, by doubling."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    out, have, at = None, 0, 0
    size, power = 1, _BASE  # x holds hashes of `size` points; power is base ** size
    while True:
        if gram >> at & 1:
            out = x if out is None else out[: len(x) - have] * power + x[have:]
            have += size
        at += 1
        if gram >> at == 0:
            break
        x = x[:-size] * power + x[size:]
        size, power = size * 2, power * power
    out = out[: len(points) - gram + 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out >> np.uint64(32)


def winnow(text: str | None, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the chosen k-grams, by position."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    gram = min(gram, len(text))
    window = min(window, len(text) - gram + 1)
    found: list[np.ndarray] = []
    places: list[np.ndarray] = []
    starts = len(text) - gram - window + 2  # windows
    with np.errstate(over="ignore"):
        for low in range(0, starts, BLOCK):
            part = text[low : low + BLOCK + gram + window - 2]
            hashes = _gram_hashes(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), gram)
            # The least of (hash, -position) is the rightmost of equal least hashes.
            best = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
            left, size = window - 1, 1
            while left:
                step = min(size, left)
                best = np.minimum(best[:-step], best[step:])
                left -= step
                size += step
            best = best[np.concatenate([[True], best[1:] != best[:-1]])]
            found.append((best >> np.uint64(32)).astype(np.uint32))
            places.append((np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64) + low)
    hashes, at = np.concatenate(found), np.concatenate(places)
    fresh = np.concatenate([[True], at[1:] != at[:-1]])
    return hashes[fresh], at[fresh]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def fingerprints(df: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the chosen hashes and their positions in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t.as_py(), gram, window) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0].astype(np.int64) for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, f"doc_id {kind}, hashes array<bigint>, positions array<bigint>")


def digest(found: tuple[np.ndarray, np.ndarray]) -> str:
    """One string for a fingerprint: a digest of its hashes and positions."""
    return hashlib.md5(found[0].tobytes() + found[1].tobytes()).hexdigest()


class _Row:
    """A text with its fingerprint, ready to meet the next one."""

    def __init__(self, key, text: str | None):
        self.key, self.text = key, text or ""
        self.found = winnow(self.text)
        self.set = np.unique(self.found[0])

    def beside(self, following: _Row) -> tuple:
        n = len(self.text)
        cut = n // 3
        edited = self.text[: n - cut] + following.text[:cut]
        other = winnow(edited)
        return (self.key, n, hashlib.sha256(edited.encode()).hexdigest(), digest(self.found), digest(other), likeness(self.set, np.unique(other[0])), likeness(self.set, following.set))


_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("n_chars", pa.int64()), *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, out, schema = TaskContext.get().partitionId(), None, [], None
    for batch in batches:
        if schema is None:
            schema = _schema(batch.column(0).type).append(pa.field("part", pa.int32())).append(pa.field("edge", pa.string())).append(pa.field("text", pa.string()))
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            row = _Row(key.as_py(), text.as_py())
            if last is None:
                out.append((row.key, *[None] * 6, part, "first", row.text))
            else:
                out.append((*last.beside(row), part, None, None))
            last = row
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
    if last is not None:
        out.append((last.key, *[None] * 6, part, "last", last.text))
    if out:
        yield _batch(out, schema)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_Row(k.as_py(), a.as_py()).beside(_Row(None, b.as_py())) for k, a, b in zip(*batch.columns, strict=True)]
        if rows:
            yield _batch(rows, _schema(batch.column(0).type))


def compare_neighbours(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text with its fingerprint, that of its edited text, and both likenesses."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    names = ["by_text", "by_row"]
    keyed = rows.withColumns(dict(zip(names, order[1:], strict=True)))
    order = [F.col("doc_id").desc_nulls_last(), *names]
    parts = keyed.repartitionByRange(width, *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = cut_lineage(parts.mapInArrow(_stream, f"doc_id {kind}, {_FIELDS}, part int, edge string, text string"), "winnowing-parts")
    edges = done.filter("edge IS NOT NULL")
    found = sorted(row["part"] for row in edges.select("part").distinct().collect())  # at most one per part
    following = small_table(spark, list(zip(found, found[1:] + found[:1], strict=True)), "part int, next_part int")
    first = edges.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    seams = edges.filter("edge = 'last'").select("doc_id", "text", "part").join(following, "part").join(first, "next_part").select("doc_id", "text", "next_text")
    return done.filter("edge IS NULL").drop("part", "edge", "text").union(seams.mapInArrow(_seams, f"doc_id {kind}, {_FIELDS}"))


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(read(spark, sf_dir, "documents"))
