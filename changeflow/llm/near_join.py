"""Similarity join on word n-grams: an LSH forest of MinHash signatures, verified exactly.

A text is its set of five-word shingles (a shorter text is one shingle of all its words).
Texts with equal sets are handled once. Each of `TREES` tries holds a signature of MinHash
values; two texts meet in a trie when a prefix of their signatures is equal. The prefixes'
lengths are fixed beforehand, shortened from full depth until a pair exactly at the threshold
is met with the target recall; so the tries are bands, and only their hashes are kept.

A pair that meets in several tries belongs to the first of them, which both texts' prefix
keys tell without looking elsewhere; so no pair is ever written out or made distinct. Big
tries' nodes are cut into slices, and a task gets two slices: its members, then their
shingles, and counts the links of each member by exact intersections. What leaves a task is
a number of links per text and the edges of a spanning forest, never pairs. Components are
found by star contractions over tables.

Results: one row per document with `class_id`, the least doc_id of its component, `n_links`,
the number of different texts at or above the threshold, and `n_copies`, rows of its text.

Defined cases: a null text counts as empty; all texts without words share one class (their
sets are equal); equal rows share a class; null ids are carried, and neither they nor an id
of several texts bring components together (`class_key` tells them apart where `class_id`,
the least id, cannot); an empty table gives none;
other columns are not read (the pipeline's stage carries them unchanged).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.plans.storage import cut_lineage

from .common import fresh, read

WORDS, THRESHOLD, TREES, DEPTH, TARGET = 5, 0.8, 20, 6, 0.999999
#: Members of a slice at most, on average, and their shingles. A cell holds two slices.
SLICE, SLICE_SHINGLES = 1024, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def prefix_lengths(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, target: float = TARGET) -> list[int]:
    """Shorten one trie's prefix after the other until the recall at the threshold is reached."""
    lengths = [depth] * trees
    turn = 0
    while 1 - np.prod([1 - threshold**x for x in lengths]) < target and max(lengths) > 1:
        lengths[turn % trees] = max(1, lengths[turn % trees] - 1)
        turn += 1
    return lengths


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: dict, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams, ASCII letters in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    wide = min(n, len(words))
    total = np.zeros(len(words) - wide + 1, np.uint64)
    for k in range(wide):
        total = _mix((total + each[k : len(each) - wide + 1 + k]) * _STEP)
    return np.unique(total)


def _set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _signatures(lengths: list[int], id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240229)
        n = sum(lengths)
        times = rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        plus = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        hashes = _WordHashes()
        for batch in batches:
            text_keys, set_keys, sizes, least = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = shingles(text, hashes)
                text_keys.append(hashlib.md5(text.encode()).digest())
                set_keys.append(_set_key(found))
                sizes.append(len(found))
                if len(found):
                    low = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
                    best = np.full(n, 0xFFFFFFFF, np.uint32)
                    for at in range(0, len(low), 4096):
                        np.minimum(best, _scramble(low[at : at + 4096, None] * times + plus).min(axis=0), out=best)
                    least.append(best)
            keys = np.empty((len(least), len(lengths)), np.uint64)
            table = np.array(least, np.uint64).reshape(len(least), n)
            at = 0
            for tree, x in enumerate(lengths):
                key = np.full(len(least), tree + 1, np.uint64)
                for k in range(at, at + x):
                    key = _mix((key + table[:, k]) * _STEP)
                keys[:, tree] = key
                at += x
            filled = np.array(sizes, np.int64) > 0
            offsets = np.concatenate([[0], np.cumsum(filled) * len(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_keys, pa.binary()), pa.array(set_keys, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "text_key", "set_key", "n_shingles", "keys"])

    return run, f"doc_id {id_type}, text_key binary, set_key binary, n_shingles long, keys array<bigint>"


def _scramble(x: np.ndarray) -> np.ndarray:
    """Spread a 32-bit product, so that the order of its values says nothing about the input's."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    return x


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal first column, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0)
        values = cells.to_pylist()
        cuts = [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)]
        if held and held[-1].column(0)[0].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < len(values):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _first_here(cell: str, keys: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Which pairs of members belong to this cell: equal here first, and of its two slices."""
    tree, _, i, j = cell.split(":")
    pairs = np.triu(np.ones((len(keys), len(keys)), bool), 1)
    if i != j:
        pairs &= slices[:, None] != slices[None, :]
    for before in range(int(tree)):
        pairs &= keys[:, None, before] != keys[None, :, before]
    return pairs


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a cell that have a pair there."""
    for table in _runs(batches):
        if table.num_rows < 2:
            continue
        cell = table["cell"][0].as_py()
        pairs = _first_here(cell, _matrix(table, "keys"), table["slice"].to_numpy())
        used = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
        if len(used):
            yield from table.take(pa.array(used)).combine_chunks().to_batches()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of column blocks of the incidence matrix."""
    if len(sets) == 2:
        small, large = sorted(sets, key=len)
        at = np.searchsorted(large, small)
        both = np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small)
        return np.array([[0, both], [both, 0]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        out += block @ block.T
    return out


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            cell, n = table["cell"][0].as_py(), table.num_rows
            pairs = _first_here(cell, _matrix(table, "keys"), table["slice"].to_numpy())
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["shingles"]]
            size = np.array([len(s) for s in sets], np.float64)
            both = _overlaps(sets)
            linked = pairs & (both / (size[:, None] + size[None, :] - both) >= threshold)
            linked |= linked.T
            texts = table["n_texts"].to_numpy()
            links = linked @ texts
            names = table["set_key"].to_pylist()
            left, right = [], []
            seen = np.zeros(n, bool)
            for start in range(n):  # a spanning forest, breadth first
                if seen[start] or not links[start]:
                    continue
                seen[start], queue = True, [start]
                while queue:
                    at = queue.pop()
                    for other in np.flatnonzero(linked[at] & ~seen):
                        seen[other] = True
                        left.append(names[at])
                        right.append(names[other])
                        queue.append(int(other))
            rows = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in rows] + left, pa.binary()), pa.array([None] * len(rows) + right, pa.binary()), pa.array([*links[rows].tolist(), *[0] * len(left)], pa.int64())],
                names=["a", "b", "links"],
            )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b): large and small stars in turn.

    Each round is two grouped minima and two joins on tables; the edges shrink towards stars
    around the least node of each component. Stops when a round changes nothing.
    """
    edges = cut_lineage(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return row[0], row[1]

    before = state(edges)
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct()
        edges = cut_lineage(small, "component-edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_classes(df: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_key, class_key, class_id, n_links, n_copies.

    `class_key` names the component, whatever its ids; `class_id` is its least id, which is null
    without any, and which components share that share an id.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    run, schema = _signatures(prefix_lengths(trees, depth, threshold, target), id_type)
    signed = cut_lineage(docs.mapInArrow(run, schema), "near-signatures")
    texts = signed.groupBy("set_key", "text_key").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n_shingles"), F.min("keys").alias("keys"))
    sets = cut_lineage(texts.groupBy("set_key").agg(F.count(F.lit(1)).alias("n_texts"), F.min("first_id").alias("first_id"), F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "text_key")).alias("first"), F.min("n_shingles").alias("n_shingles"), F.min("keys").alias("keys")), "near-sets")

    paths = sets.select("set_key", "n_shingles", F.posexplode("keys").alias("tree", "key"))
    nodes = paths.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).filter("n > 1")
    nodes = nodes.select("tree", "key", F.greatest(F.ceil(F.col("n") / SLICE), F.ceil(F.col("weight") / SLICE_SHINGLES)).cast("int").alias("slices"))
    members = paths.drop("n_shingles").join(nodes, ["tree", "key"]).withColumn("slice", F.pmod(F.hash("set_key"), "slices"))
    celled = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        F.concat_ws(":", "tree", "key", F.least("slice", "other"), F.greatest("slice", "other")).alias("cell"), "set_key", "slice"
    )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with_keys = celled.join(sets.select("set_key", "keys", "n_texts"), "set_key").select("cell", "set_key", "slice", "keys", "n_texts")
    cell_schema = "cell string, set_key binary, slice int, keys array<bigint>, n_texts long"
    needed = cut_lineage(with_keys.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(_needed, cell_schema), "near-cells")

    wanted = needed.select("set_key").distinct().join(sets.select("set_key", F.col("first.first_id").alias("first_id"), F.col("first.text_key").alias("first_key")), "set_key")
    found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (_text_key("text") == F.col("first_key"))).select("text", "set_key").mapInArrow(_shingled, "set_key binary, shingles binary")
    found = found.groupBy("set_key").agg(F.min("shingles").alias("shingles"))
    filled = needed.join(found, "set_key").select("cell", "set_key", "slice", "keys", "n_texts", "shingles")
    verified = cut_lineage(filled.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(_verified(threshold), "a binary, b binary, links long"), "near-links")

    links = verified.filter("b IS NULL").groupBy(F.col("a").alias("set_key")).agg(F.sum("links").alias("links"))
    labels = components(verified.filter("b IS NOT NULL").select("a", "b"))
    of_set = sets.select("set_key", "n_texts", "first_id").join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").join(links, "set_key", "left")
    of_set = of_set.withColumn("root", F.coalesce("root", "set_key"))
    least = of_set.groupBy("root").agg(F.min("first_id").alias("class_id"))
    of_set = of_set.join(least, "root").select("set_key", F.col("root").alias("class_key"), "class_id", (F.col("n_texts") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    copies = texts.select("set_key", "text_key", "n_copies").join(of_set, "set_key")
    return signed.select("doc_id", "set_key", "text_key").join(copies.drop("set_key"), "text_key").select("doc_id", "text_key", "class_key", "class_id", "n_links", "n_copies")


def _text_key(text: str) -> Column:
    """What _signatures gives as text_key."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of wanted texts."""
    hashes = _WordHashes()
    for batch in batches:
        keys, out = [], []
        for text, key in zip(batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("set_key")), strict=True):
            found = shingles(text.as_py(), hashes)
            if _set_key(found) == key.as_py():
                keys.append(key.as_py())
                out.append(found.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.binary())], names=["set_key", "shingles"])


def op3_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents")).drop("text_key", "class_key")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the least id, null ids last, and of equal ids the least text digest."""
    classes = near_classes(docs)
    kept = classes.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("kept"))
    mark, key = fresh(docs.columns, "kept_id"), fresh(docs.columns, "kept_key")
    kept = kept.select(F.col("kept.doc_id").alias(mark), F.col("kept.text_key").alias(key))
    chosen = docs.join(kept, (docs["doc_id"].eqNullSafe(F.col(mark))) & (_text_key("text") == F.col(key)))
    return chosen.dropDuplicates([mark, key]).select(*[f"`{c}`" for c in docs.columns])


ORACLE_OP3 = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
texts AS (SELECT text, min(low) AS low, count(*) AS n_copies, min(doc_id) AS first_id, row_number() OVER (ORDER BY min(doc_id), text) AS t FROM docs GROUP BY text),
words AS (SELECT t, list_filter(string_split_regex(low, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
grams AS (
  SELECT DISTINCT t, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT t, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT t, count(*) AS n FROM grams GROUP BY t),
links AS (
  SELECT x.t AS a, y.t AS b FROM grams x JOIN grams y ON x.g = y.g AND x.t <> y.t
  JOIN sizes p ON p.t = x.t JOIN sizes q ON q.t = y.t
  GROUP BY x.t, y.t, p.n, q.n HAVING count(*)::DOUBLE / (p.n + q.n - count(*)) >= 0.8
  UNION SELECT x.t, y.t FROM words x JOIN words y ON len(x.w) = 0 AND len(y.w) = 0 AND x.t <> y.t),
reach(a, b) AS (SELECT t, t FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT r.a AS t, min(x.first_id) AS class_id FROM reach r JOIN texts x ON x.t = r.b GROUP BY r.a),
counted AS (SELECT a AS t, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, c.class_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, x.n_copies
FROM docs d JOIN texts x USING (text) JOIN classes c ON c.t = x.t LEFT JOIN counted k ON k.t = x.t
"""
