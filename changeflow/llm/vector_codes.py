"""Vector compression by a product code whose codebooks are fitted by member-resident Lloyd rounds.

Vectors become integers and are cut into parts; every part position has a codebook of its own.
The parts live with the entry that owns them: they are written once, partitioned by (position,
entry, salt), and each round looks at them where they are. A part that stays costs no shuffle;
one whose nearest entry has changed is written to that round's table, partitioned by its new
owner, and is from then on skipped where it lay (the few codebooks since it arrived say so).
Owners' sums change by what left and what arrived, so a round's update is a sum over the
parts that moved. The last assignment codes whole vectors in place, without a shuffle.

The driver holds codebooks, sums and counts: positions x entries x width integers each, bounded
by the parameters and the length of a vector. Equal parts of a batch travel as one with a weight,
and the salt (from the part's content) spreads an entry over all tasks.

Integers are exact: products are taken in doubles while every step stays below 2^53, in Python
integers beyond; components are held within +-2^62, and errors above 2^63-1 are given as that.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped;
vectors shorter than the longest, or not cut evenly, are filled up with zeros, so an empty vector
counts as zeros; fewer than `entries` rows give as many entries (and a table without rows gives
none); the first entries are taken by id, nulls last, then by vector; equal rows give equal rows;
null labels are one label; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.plans.storage import cut_lineage

from .common import read
from .vectors import finite_vectors

POSITIONS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_MOST = 1 << 62
_LONG = (1 << 63) - 1


def part_width(length: int, positions: int) -> int:
    return -(-length // positions)


def whole_numbers(matrix: np.ndarray, positions: int, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) by row, position and place, filled up with zeros."""
    out = np.zeros((len(matrix), positions * width), np.int64)
    with np.errstate(over="ignore"):
        out[:, : matrix.shape[1]] = np.clip(np.floor(matrix * scale), -_MOST, _MOST)
    return out.reshape(len(matrix), positions, width)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts (rows) to the entries of one codebook, exact."""
    most = max(int(abs(int(parts.min(initial=0)))), int(parts.max(initial=0)), *(abs(int(x)) for x in book.ravel()), 0)
    if 4 * most * most * max(1, parts.shape[1]) < 1 << 53:
        x, c = parts.astype(np.float64), book.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    gap = parts.astype(object)[:, None, :] - book.astype(object)[None, :, :]
    return (gap * gap).sum(axis=2)


def nearest(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin(distances(parts, book), axis=1)


def _lists(parts: np.ndarray) -> pa.Array:
    n, width = parts.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(parts.ravel()))


def _placed(position: np.ndarray, was: np.ndarray, entry: np.ndarray, parts: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(position.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(entry.astype(np.int32)), _lists(parts), pa.array(weight.astype(np.int64))],
        names=["position", "was", "entry", "part", "weight"],
    )


_RESIDENT = "position int, was int, entry int, part array<long>, weight long"


def _first_owners(books: np.ndarray, width: int):
    """Parts of vectors with their first owner; equal parts of a batch are one."""
    positions = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, matrix in finite_vectors(batch.column(0)) if batch.num_rows else ():
                numbers = whole_numbers(matrix, positions, width)
                for position in range(positions):
                    parts, weight = np.unique(numbers[:, position], axis=0, return_counts=True)
                    entry = nearest(parts, books[position])
                    yield _placed(np.full(len(parts), position), np.full(len(parts), -1), entry, parts, weight)

    return run


def _moving(since: list[np.ndarray], width: int):
    """Parts that are still with their owner and now have another nearest entry.

    `since` holds the codebooks of the rounds after the parts were placed; the last is the current.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, entry, weight = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("position", "entry", "weight"))
            parts = batch.column(batch.schema.get_field_index("part")).flatten().to_numpy().reshape(batch.num_rows, width)
            for p in np.unique(position):
                here = np.flatnonzero(position == p)
                for book in since[:-1]:
                    here = here[nearest(parts[here], book[p]) == entry[here]]
                to = nearest(parts[here], since[-1][p])
                moved = to != entry[here]
                if moved.any():
                    rows = here[moved]
                    yield _placed(position[rows], entry[rows], to[moved], parts[rows], weight[rows])

    return run


def _first_entries(kept: DataFrame, positions: int, entries: int, width: int) -> np.ndarray:
    """The smallest ids' parts as integers: positions x entries x width."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    made = [whole_numbers(np.array([r.embedding], np.float64), positions, width)[0] for r in rows]
    return np.array(made, np.int64).reshape(len(made), positions, width).transpose(1, 0, 2).astype(object)


def _changes(moved: DataFrame, width: int) -> list:
    """Weights and sums per (position, entry) of what arrived, and with minus what left: at most
    twice positions x entries rows."""
    both = moved.select("position", F.explode(F.array(F.struct(F.col("entry").alias("e"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("e"), F.lit(-1).alias("sign")))).alias("s"), "part", "weight")
    signed = both.filter("s.e >= 0").select("position", F.col("s.e").alias("entry"), (F.col("s.sign") * F.col("weight")).alias("weight"), "part")
    sums = [F.sum(F.col("part")[i].cast("decimal(38,0)") * F.col("weight").cast("decimal(19,0)")).cast("decimal(38,0)").alias(f"s{i}") for i in range(width)]
    return signed.groupBy("position", "entry").agg(F.sum("weight").alias("weight"), *sums).collect()


def fit_codebooks(df: DataFrame, positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Final codebooks: integers by position, entry and place within the part."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector}`").alias("embedding"))
    kept = rows.filter(_finite("embedding"))
    width = part_width(kept.agg(F.max(F.size("embedding"))).first()[0] or 0, positions)
    books = _first_entries(kept, positions, entries, width)
    n = books.shape[1]
    if not n or not width:
        return books
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def resident(parts: DataFrame, name: str) -> DataFrame:
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(spread)))
        return cut_lineage(salted.repartition(spread, "position", "entry", "salt").drop("salt"), name)

    sums = np.zeros((positions, n, width), object)
    weights = np.zeros((positions, n), object)
    placed: list[DataFrame] = []
    since: list[np.ndarray] = []  # since[r] is the codebook that round r assigned with
    for number in range(rounds):
        since.append(books)
        if not number:
            moved = kept.select("embedding").mapInArrow(_first_owners(books, width), _RESIDENT)
        else:
            moved = None
            for arrived, table in enumerate(placed):
                leaving = table.mapInArrow(_moving(since[arrived + 1 :], width), _RESIDENT)
                moved = leaving if moved is None else moved.unionByName(leaving)
        placed.append(resident(moved, f"residents-{number}"))
        changes = _changes(placed[-1], width)
        if not changes:
            break  # no part moves: every later round would find the same
        for row in changes:
            weights[row.position, row.entry] += row.weight
            for i in range(width):
                sums[row.position, row.entry, i] += int(row[f"s{i}"])
        books = books.copy()
        for p, e in zip(*np.nonzero(weights), strict=True):
            books[p, e] = [s // weights[p, e] for s in sums[p, e]]
    return books


def _finite(column: str):
    lost = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & ~lost


def _coded(books: np.ndarray, width: int, id_type: str, label_type: str):
    positions = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in finite_vectors(batch.column(2)) if batch.num_rows else ():
                numbers = whole_numbers(matrix, positions, width)
                code, error = np.zeros((len(rows), positions), np.uint8), np.zeros(len(rows), object)
                for position in range(positions) if width else ():
                    far = distances(numbers[:, position], books[position])
                    code[:, position] = np.argmin(far, axis=1)
                    error += far[np.arange(len(rows)), code[:, position]].astype(object)
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array([min(int(e), _LONG) for e in error], pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return run, f"vec_id {id_type}, label {label_type}, code string, error long"


def encode(df: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code and error of every vector that is kept."""
    kind = {c: df.schema[c].dataType.simpleString() for c in (id_col, label)}
    run, schema = _coded(books, books.shape[2], kind[id_col], kind[label])
    return df.select(*(F.col(f"`{c}`") for c in (id_col, label, vector))).mapInArrow(run, schema)


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    books = fit_codebooks(vectors)
    coded = cut_lineage(encode(vectors, books), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle(positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """One pair of common tables a round: the nearest entry of each part, then the entries' means."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding, len(embedding) // {positions} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS MATERIALIZED (
  SELECT r, (i - 1) // width AS p, (i - 1) % width AS d, CAST(floor(CAST(embedding[i] AS DOUBLE) * {scale}) AS BIGINT) AS v
  FROM (SELECT r, width, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, d, v FROM places WHERE r <= {entries})"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""far{k} AS MATERIALIZED (SELECT x.r, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) AS s FROM places x JOIN book{k} c ON c.p = x.p AND c.d = x.d GROUP BY x.r, x.p, c.e),
own{k} AS MATERIALIZED (SELECT r, p, min(s) AS s, arg_min(e, s * {entries} + e) AS e FROM far{k} GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.d, coalesce(m.v, b.v) AS v
  FROM book{k} b LEFT JOIN (SELECT x.p, o.e, x.d, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM places x JOIN own{k} o ON o.r = x.r AND o.p = x.p GROUP BY x.p, o.e, x.d) m
  ON m.p = b.p AND m.e = b.e AND m.d = b.d)""")
    steps.append(f"""coded AS (SELECT r, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM own{rounds} GROUP BY r)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, d)) FROM book{rounds}) AS codebooks_sha256
FROM kept k JOIN coded c USING (r)""")
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]


ORACLE_OP11 = _oracle()
