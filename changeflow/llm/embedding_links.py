"""Near-duplicate vectors within a label: randomly rotated binary codes decide what is computed exactly.

A vector of length one is rotated by a random orthogonal matrix (filled up with zeros to a
multiple of 64 coordinates) and kept as the signs of its coordinates, with a correction factor,
the inner product of the vector and its code. The rotated coordinates are also kept in four
bits each, rounded at random, so an estimate needs only what two members carry: the code of one
times the four bits of the other, divided by the factor, is an unbiased estimate of their cosine.
Its error for two vectors at the threshold has a known spread, so at `SIGMAS` spreads below the
threshold a pair can be dropped (two of ten million true pairs would be missed); every other pair
is computed exactly in double precision. No candidates are capped, and no pair is written out.

Vectors that are equal within a label are one member with a weight. The members of a label are
cut into slices of a bounded number of coordinates, and a task gets the codes of two slices: all
pairs of a label meet once, and only members with a candidate fetch their vectors. What leaves
a task is a number of links per member and the edges of a spanning forest; components are found
by star contractions over tables.

Work: half the square of a label's members in estimates (four to seven nanoseconds each at
64 coordinates), members times slices in moved codes. Vectors move only for members with candidates.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without a label, link with nothing and are kept; vectors of different lengths do not link; equal
rows link with each other; null ids are carried, never bring components together, and are kept
only where their component has no id; an empty table gives none; other columns are not read.
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
from .near_join import _runs, components
from .vectors import finite_vectors

THRESHOLD, SIGMAS, SEED = 0.93, 5.0, 20240531
#: Coordinates of a slice's members at most, on average: 32,768 members of 64. A task holds two slices.
SLICE_COORDINATES = 1 << 21
BLOCK = 1024


def code_bits(size: int) -> int:
    return max(64, -(-size // 64) * 64)


def rotation(size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The first `size` rows of a random orthogonal matrix, and the dither of the four-bit rounding."""
    bits = code_bits(size)
    rng = np.random.default_rng([seed, bits])
    q, r = np.linalg.qr(rng.standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:size], rng.random(bits)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def encode(unit: np.ndarray, turn: np.ndarray, dither: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sign bits, correction factors, least coordinate, step, and levels of four bits, two a byte."""
    turned = unit @ turn
    bits = turned.shape[1]
    factor = np.abs(turned).sum(axis=1) / np.sqrt(bits)
    low = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - low, 1e-12) / 15
    level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, 15).astype(np.uint8)
    return np.packbits(turned > 0, axis=1), factor, low, step, level[:, ::2] | level[:, 1::2] << 4


class Codes:
    """Members of one length, decoded for estimates."""

    def __init__(self, code: list[bytes], factor: np.ndarray, low: np.ndarray, step: np.ndarray, fine: list[bytes]) -> None:
        packed = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
        signs = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
        self.bits = signs.shape[1]
        self.factor = factor
        self.codes = (signs / (np.sqrt(self.bits) * factor[:, None])).astype(np.float32)
        two = np.frombuffer(b"".join(fine), np.uint8).reshape(len(fine), -1)
        level = np.empty(signs.shape, np.float32)
        level[:, ::2], level[:, 1::2] = two & 15, two >> 4
        self.near = (low[:, None] + step[:, None] * level).astype(np.float32)
        self.step = step

    def estimate(self, rows: slice, columns: slice) -> np.ndarray:
        return self.codes[rows] @ self.near[columns].T

    def candidates(self, rows: slice, columns: slice, threshold: float, sigmas: float) -> np.ndarray:
        """Pairs whose estimate is not below the threshold by more than so many spreads of its error.

        The spread is that of the widest step among the columns, so a row has one bound.
        """
        f = self.factor[rows]
        turned = np.sqrt((1 - threshold**2) * np.maximum(1 - f * f, 0) / (self.bits - 1)) / f
        rounded = self.step[columns].max(initial=0) / (2 * f)
        least = threshold - sigmas * np.sqrt(turned * turned + rounded * rounded) - 1e-6
        return self.estimate(rows, columns) >= least.astype(np.float32)[:, None]


def _coded(seed: int, id_type: str, label_type: str, vector_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            ids, labels, vectors = batch.columns
            n = batch.num_rows
            out: list[list] = [[None] * n for _ in range(7)]
            for rows, matrix in finite_vectors(vectors) if n else ():
                size = matrix.shape[1]
                named = [labels[int(r)].is_valid for r in rows]
                fine = np.array(named) & (np.abs(matrix).max(axis=1, initial=0) > 0)
                if not fine.any():
                    continue
                if size not in made:
                    made[size] = rotation(size, seed)
                rows, matrix = rows[fine], matrix[fine]
                code, factor, low, step, level = encode(unit_rows(matrix), *made[size])
                for k, r in enumerate(rows):
                    name = hashlib.blake2b(repr(labels[int(r)].as_py()).encode(), digest_size=16)
                    name.update(matrix[k].tobytes())
                    for column, value in zip(out, (size, name.digest(), code[k].tobytes(), factor[k], low[k], step[k], level[k].tobytes()), strict=True):
                        column[r] = value
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, labels, vectors, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["vec_id", "label", "embedding", "size", "member", "code", "factor", "low", "step", "fine"])

    return run, f"vec_id {id_type}, label {label_type}, embedding {vector_type}, size int, member binary, code binary, factor double, low double, step double, fine binary"


def _cell_of(table: pa.Table) -> tuple[Codes, np.ndarray, bool]:
    """Decoded members of a cell in the order of their slices, that order, and whether the cell is one slice."""
    slices = table["slice"].to_numpy()
    order = np.argsort(slices, kind="stable")
    table = table.take(pa.array(order))
    codes = Codes(table["code"].to_pylist(), *(table[c].to_numpy() for c in ("factor", "low", "step")), table["fine"].to_pylist())
    low, high = table["cell"][0].as_py().rsplit(":", 2)[1:]
    return codes, order, low == high


def _blocks(slices: np.ndarray, alone: bool) -> Iterator[tuple[slice, slice]]:
    """Rows against columns, so that each pair of a cell's two slices (or of its one) is met once."""
    n = len(slices)
    half = n if alone else int(np.searchsorted(slices, slices[-1]))
    for at in range(0, half, BLOCK):
        yield slice(at, min(at + BLOCK, half)), slice(at if alone else half, n)


def _upper(mask: np.ndarray, rows: slice, columns: slice) -> np.ndarray:
    return np.triu(mask, 1) if rows.start == columns.start else mask


def _with_candidates(threshold: float, sigmas: float):
    """Members of a cell that have a candidate there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            if table.num_rows < 2:
                continue
            codes, order, alone = _cell_of(table)
            used = np.zeros(table.num_rows, bool)
            for rows, columns in _blocks(table["slice"].to_numpy()[order], alone):
                mask = _upper(codes.candidates(rows, columns, threshold, sigmas), rows, columns)
                used[rows] |= mask.any(axis=1)
                used[columns] |= mask.any(axis=0)
            if used.any():
                yield from table.take(pa.array(np.sort(order[used]))).combine_chunks().to_batches()

    return run


class Forest:
    """Which members are connected: labels that are right where they differ, joined by a union of labels."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.label = np.arange(n)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def join(self, one: int, others: np.ndarray) -> None:
        seen = self.label[others]
        if (seen != self.label[one]).any():
            roots = {self.find(int(x)) for x in np.unique(seen)} | {self.find(int(self.label[one]))}
            least = min(roots)
            for root in roots:
                self.parent[root] = least
            self.label[others] = self.label[one] = least


def _verified(threshold: float, sigmas: float):
    """Exact cosines of the candidates: links per member, and edges that connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            codes, order, alone = _cell_of(table)
            table = table.take(pa.array(order))
            unit = unit_rows(table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1))
            copies, names = table["copies"].to_numpy(), table["member"].to_pylist()
            links, forest = np.zeros(len(names), np.int64), Forest(len(names))
            for rows, columns in _blocks(table["slice"].to_numpy(), alone):
                mask = _upper(codes.candidates(rows, columns, threshold, sigmas), rows, columns)
                down, across = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
                if not len(down):
                    continue
                exact = unit[rows][down] @ unit[columns][across].T
                linked = mask[np.ix_(down, across)] & (exact >= threshold)
                links[rows.start + down] += linked @ copies[columns][across]
                links[columns.start + across] += copies[rows][down] @ linked
                for k in np.flatnonzero(linked.any(axis=1)):
                    forest.join(rows.start + int(down[k]), columns.start + across[linked[k]])
            rows = np.flatnonzero(links)
            roots = [forest.find(int(r)) for r in rows]
            edges = [(names[r], names[root]) for r, root in zip(rows, roots, strict=True) if r != root]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[r] for r in rows] + [a for a, _ in edges], pa.binary()), pa.array([None] * len(rows) + [b for _, b in edges], pa.binary()), pa.array(links[rows].tolist() + [0] * len(edges), pa.int64())],
                names=["a", "b", "links"],
            )

    return run


def linked_vectors(df: DataFrame, threshold: float = THRESHOLD, sigmas: float = SIGMAS, seed: int = SEED, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", slice_coordinates: int = SLICE_COORDINATES) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    kind = {c: df.schema[c].dataType.simpleString() for c in (id_col, label, vector)}
    run, schema = _coded(seed, kind[id_col], kind[label], kind[vector])
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("embedding"))
    coded = cut_lineage(rows.mapInArrow(run, schema), "vector-codes")

    carried = ("code", "factor", "low", "step", "fine")
    there = coded.filter("member IS NOT NULL")
    members = cut_lineage(there.groupBy("label", "size", "member").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), *(F.min(c).alias(c) for c in carried)), "vector-members")
    bits = F.greatest(F.ceil(F.col("size") / 64), F.lit(1)) * 64
    groups = members.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label", "size", F.ceil(F.col("n") * bits / slice_coordinates).cast("int").alias("slices"))
    sliced = members.join(groups, ["label", "size"]).withColumn("slice", F.pmod(F.xxhash64("member"), "slices").cast("int"))
    celled = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cell = F.concat_ws(":", F.col("label").cast("string"), "size", F.least("slice", "other"), F.greatest("slice", "other")).alias("cell")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = celled.select(cell, "member", "slice", "copies", *carried)
    cell_schema = "cell string, member binary, slice int, copies long, code binary, factor double, low double, step double, fine binary"
    needed = cut_lineage(cells.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(_with_candidates(threshold, sigmas), cell_schema), "vector-cells")

    wanted = needed.select("member").distinct()
    vectors = there.select("member", "embedding").join(wanted, "member", "left_semi").groupBy("member").agg(F.first("embedding").alias("embedding"))
    filled = needed.join(vectors, "member").select("cell", "member", "slice", "copies", *carried, "embedding")
    verified = cut_lineage(filled.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(_verified(threshold, sigmas), "a binary, b binary, links long"), "vector-links")

    links = verified.filter("b IS NULL").groupBy(F.col("a").alias("member")).agg(F.sum("links").alias("links"))
    labels = components(verified.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "member")
    of_member = members.select("member", "copies", "first_id").join(labels, "member", "left").join(links, "member", "left").withColumn("root", F.coalesce("root", "member"))
    least = of_member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_member = of_member.join(least, "root").select("member", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = coded.select("vec_id", "member").join(of_member, "member", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(read(spark, sf_dir, "embeddings"))


ORACLE_OP13 = r"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings),
parts AS (
  SELECT r, label, len(embedding) AS size, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM rows WHERE label IS NOT NULL),
fine AS (
  SELECT r, label, size FROM parts GROUP BY r, label, size
  HAVING bool_and(embedding[i] IS NOT NULL AND isfinite(embedding[i])) AND max(abs(embedding[i])) > 0),
vectors AS (
  SELECT r, label, size, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
  FROM fine JOIN rows USING (r, label)),
links AS (
  SELECT x.r AS a, y.r AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.size = y.size AND x.r <> y.r
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.93),
reach(a, b) AS (SELECT r, r FROM rows UNION SELECT c.a, l.b FROM reach c JOIN links l ON l.a = c.b),
classes AS (SELECT c.a AS r, min(x.vec_id) AS component_id FROM reach c JOIN rows x ON x.r = c.b GROUP BY c.a),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT x.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, x.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM rows x JOIN classes c USING (r) LEFT JOIN counted k USING (r)
"""
