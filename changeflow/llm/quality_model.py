"""A quality classifier: regularised quadratic discriminant over document statistics.

Statistics of a text (word and character-class counts) become features by logarithms and
square roots, so rates near zero spread out. Per class, a task adds up counts, sums and
products; Spark sums them by position, and one mean and one covariance per class reach the
driver. Covariances are shrunk towards their pooled one and towards a multiple of the
identity, then factorised once (Cholesky); the factors go to the tasks. A score is the
logistic of the difference of log densities (Mahalanobis distance and log determinant), with
the classes' shares as prior.

Only text makes features. Rows held out teach nothing. All labelled rows are learned from.

Defined cases: null and empty texts have all features 0 and get a score like any other;
null labels teach nothing; with one class only, scores are its label, with none 0.5;
repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.plans.storage import cut_lineage

from .common import id_remainder, read

#: Shrinkage towards the pooled covariance and towards the identity.
POOLED, ROUND = 0.02, 0.02
LEAST = 0.7

_KINDS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~=+_\\{}[]",
    "bar": b"|",
    "shout": b"!?",
    "stop": b".,;:",
    "line": b"\n",
}
_OF_BYTE = np.full(256, len(_KINDS), np.int64)
for _i, _bytes in enumerate(_KINDS.values()):
    _OF_BYTE[list(_bytes)] = _i
FEATURES = ("words", "word_size", "upper", "digit", "symbol", "bar", "shout", "stop", "line", "distinct", "lines_again", "pairs_again")


def features(text: str | None) -> list[float]:
    """Transformed statistics of one text, in the order of FEATURES."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    # Many bytes at once: their kinds counted.
    counts = np.zeros(len(_KINDS) + 1, np.int64)
    for low in range(0, len(data), 1 << 20):
        counts += np.bincount(_OF_BYTE[np.frombuffer(data[low : low + (1 << 20)], np.uint8)], minlength=len(counts))
    of = dict(zip(_KINDS, counts.tolist(), strict=False))
    n = len(words)
    letters = of["upper"] + of["lower"] + 1
    lines = [line for line in data.split(b"\n") if line.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    root = lambda x: x**0.5
    return [
        float(np.log1p(n)),
        float(np.log1p((len(data) - len(lines)) / n)),
        root(of["upper"] / letters),
        root(of["digit"] / n),
        root(of["symbol"] / n),
        root(of["bar"] / n),
        root(of["shout"] / n),
        root(of["stop"] / n),
        root(of["line"] / n),
        float(np.log1p(n) - np.log1p(len(set(words)))),
        root(1 - len(set(lines)) / len(lines)),
        root(1 - (len(pairs) + 1) / n) if n > len(pairs) + 1 else 0.0,
    ]


def with_features(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], names=["doc_id", "features"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, f"doc_id {kind}, features array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: count, sums and products, laid out in one vector."""
    d = len(FEATURES)
    total = {}
    for batch in batches:
        labels = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(len(labels), d)
        for label in np.unique(labels):
            own = x[labels == label]
            total[int(label)] = total.get(int(label), 0) + np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    for label, vector in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(vector), pa.int32()), pa.array(range(len(vector)), pa.int32()), pa.array(vector)], names=["label", "place", "amount"])


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log shares of classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    shares: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.means) == 0:
            return np.full(len(x), np.exp(self.shares[1]) if np.isfinite(self.shares).any() else 0.5)
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(self.shares[k] - 0.5 * ((z * z).sum(axis=1) + self.logdets[k]))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(labelled: DataFrame, pooled: float = POOLED, roundness: float = ROUND) -> Discriminant:
    """From rows of (label, features); two vectors of fixed length reach the driver."""
    d = len(FEATURES)
    sums = labelled.filter("label IN (0, 1)").select(F.col("label").cast("int"), "features").mapInArrow(_moments, "label int, place int, amount double").groupBy("label", "place").agg(F.sum("amount").alias("amount")).collect()
    vectors = np.zeros((2, 1 + d + d * d))
    for row in sums:
        vectors[row["label"], row["place"]] = row["amount"]
    n = vectors[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        shares = np.log(n / n.sum())
    if not n.all():
        return Discriminant(np.empty((0, d)), np.empty(0), np.empty(0), shares)
    means = vectors[:, 1 : 1 + d] / n[:, None]
    scatter = [vectors[k, 1 + d :].reshape(d, d) - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    both = (scatter[0] + scatter[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
    factors, logdets = [], []
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / n[k] + pooled * both
        own = own / np.outer(scale, scale)
        own = (1 - roundness) * own + roundness * np.eye(d) * np.trace(own) / d + 1e-9 * np.eye(d)
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower) / scale[None, :])
        logdets.append(2 * np.log(np.diag(lower)).sum() + 2 * np.log(scale).sum())
    return Discriminant(means, np.array(factors), np.array(logdets), shares)


def apply(rows: DataFrame, model: Discriminant) -> DataFrame:
    """Rows of (doc_id, held_out, features) with their score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(x))], names=["doc_id", "held_out", "score"])

    return rows.select("doc_id", "held_out", "features").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")


def _held_out(column: Column) -> Column:
    return id_remainder(column, 4) == 2


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(with_features(read(spark, sf_dir, "documents")).withColumn("held_out", _held_out(F.col("doc_id"))), "quality-features")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(rows.filter(~F.col("held_out")).join(labels, "doc_id"))
    return apply(rows, model).withColumn("predicted", (F.col("score") >= LEAST).cast("int"))
