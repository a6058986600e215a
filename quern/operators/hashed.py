"""Texts as weighted hashed words, and two models fitted on all of them by passes over the data: an embedder and a linear guard.

A word's feature is its hash modulo a number of buckets, so a model has a size
that is a parameter, not that of the vocabulary. Each pass reads the stored
features, works in numpy within tasks, and sums by bucket before anything leaves
a task; the driver holds what a model holds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import small_batches

#: ASCII letters in lower case, digits and all bytes beyond ASCII; anything else stands between words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split into words at once.
_SLICE = 1 << 20
#: Rows that stand in a dense matrix at once.
_ROWS = 256


def word_counts(text: str | None) -> Counter:
    """How often each word stands in a text, as UTF-8; a long text a slice at a time."""
    data, at, found = (text or "").encode("utf-8").translate(_LETTERS), 0, Counter()
    while at < len(data):
        end = data.find(b" ", at + _SLICE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def hashed_words(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """The other columns of docs, and at array<int> (buckets, ascending), weight array<float> (1 + log of how often their words stand in the text). Null and wordless texts have empty arrays. What reads them holds small batches too."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text and c not in ("at", "weight")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, often, ends = [], [], [0]
            for t in batch.column(batch.num_columns - 1).to_pylist():
                own: dict[int, int] = {}
                for word, n in word_counts(t).items():
                    bucket = zlib.crc32(word) % buckets
                    own[bucket] = own.get(bucket, 0) + n
                held = sorted(own)
                at += held
                often += [own[b] for b in held]
                ends.append(len(at))
            weight, ends = 1 + np.log(np.array(often, np.float64)), pa.array(ends, pa.int32())
            new = [pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weight.astype(np.float32)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*kept, "at", "weight"])

    rows = docs.select(*kept, text)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, at array<int>, weight array<float>")


def inverse_frequencies(features: DataFrame, buckets: int) -> np.ndarray:
    """log((n + 1) / (documents that hold the bucket + 1)) for each bucket: at most as many rows as buckets."""
    n = features.count()
    found = features.select(F.explode("at").alias("b")).groupBy("b").agg(F.count("*").alias("n")).toPandas()
    held = np.zeros(buckets)
    held[found["b"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return np.log((n + 1) / (held + 1))


def _sparse(batch: pa.RecordBatch, at: int, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each entry; values are scaled by bucket, and rows have length one."""
    lists, weights = batch.column(at), batch.column(at + 1)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    bucket = lists.flatten().to_numpy(zero_copy_only=False)
    value = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale[bucket]
    row = np.repeat(np.arange(batch.num_rows), size)
    length = np.sqrt(np.bincount(row, value * value, batch.num_rows))
    return row, bucket, value / np.maximum(length, 1e-300)[row]


def _dense(entries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, buckets: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The sparse rows as matrices of some rows x buckets. The entries of a row stand together, a bucket once."""
    row, bucket, value = entries
    for a in range(0, rows, _ROWS):
        part = slice(*np.searchsorted(row, (a, a + _ROWS)))
        out = np.zeros((min(_ROWS, rows - a), buckets))
        out[row[part] - a, bucket[part]] = value[part]
        yield slice(a, a + len(out)), out


def _times(entries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, matrix: np.ndarray) -> np.ndarray:
    """The sparse rows times a matrix of buckets x columns, a bounded number of rows at a time."""
    out = np.zeros((rows, matrix.shape[1]))
    for part, dense in _dense(entries, rows, len(matrix)):
        out[part] = dense @ matrix
    return out


@dataclass
class Embedder:
    """Weights of buckets, and the subspace that texts are projected on."""

    scale: np.ndarray
    basis: np.ndarray  # buckets x dimensions


def _power(features: DataFrame, scale: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The transpose of the document matrix times the document matrix times basis."""
    shared = features.sparkSession.sparkContext.broadcast((scale, basis))
    rank = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, basis = shared.value
        total = np.zeros_like(basis)
        for batch in batches:
            entries = _sparse(batch, 0, scale)
            for _, dense in _dense(entries, batch.num_rows, len(basis)):
                total += dense.T @ (dense @ basis)
        held = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_pydict({"b": pa.array(held, pa.int32()), "v": pa.array(total[held].tolist(), pa.list_(pa.float64()))})

    parts = features.select("at", "weight").mapInArrow(run, "b int, v array<double>")
    summed = parts.groupBy("b").agg(*[F.sum(F.get("v", i)).alias(f"c{i}") for i in range(rank)]).toPandas()
    out = np.zeros_like(basis)
    out[summed["b"].to_numpy(dtype=np.int64)] = summed[[f"c{i}" for i in range(rank)]].to_numpy()
    shared.unpersist()
    return out


def fit_embedder(features: DataFrame, buckets: int, dimensions: int = 32, rounds: int = 6) -> Embedder:
    """The subspace of the largest singular values of the weighted document matrix, by subspace iteration: each round is a pass over all features.

    features: at and weight, stored. It begins with a fixed random matrix and ends
    with the directions in the order of their singular values. Fewer documents or
    buckets than dimensions give directions without weight.
    """
    scale = inverse_frequencies(features, buckets)
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(buckets, min(buckets, dimensions + 8))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_power(features, scale, basis))[0]
    # within the subspace: the eigenvectors of what the matrix does to it
    values, turn = np.linalg.eigh(basis.T @ _power(features, scale, basis))
    return Embedder(scale, basis @ turn[:, np.argsort(-values)[:dimensions]])


def embed(features: DataFrame, key: str, model: Embedder) -> DataFrame:
    """key and vector array<double>: each text in the subspace. A text without known words is a vector of zeros."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _times(_sparse(batch, 1, shared.value.scale), batch.num_rows, shared.value.basis)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.tolist(), pa.list_(pa.float64()))], [key, "vector"])

    kind = features.schema[key].dataType.simpleString()
    return features.select(key, "at", "weight").mapInArrow(run, f"{key} {kind}, vector array<double>")


@dataclass
class Guard:
    """A weight for each bucket and one for all."""

    scale: np.ndarray
    weights: np.ndarray
    constant: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _gradient(rows: DataFrame, model: Guard, positive: float) -> tuple[np.ndarray, float]:
    """Of the mean loss over rows (y, at, weight): by bucket, and by the constant. positive: how much a row with y = 1 counts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total, rest, n = np.zeros_like(model.weights), 0.0, 0.0
        for batch in batches:
            row, bucket, value = _sparse(batch, 1, model.scale)
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            counts = np.where(y > 0, positive, 1.0)
            off = counts * (_sigmoid(np.bincount(row, value * model.weights[bucket], batch.num_rows) + model.constant) - y)
            total += np.bincount(bucket, value * off[row], len(total))
            rest, n = rest + off.sum(), n + counts.sum()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"b": pa.array([-2, -1, *held.tolist()], pa.int32()), "g": pa.array([n, rest, *total[held].tolist()])})

    summed = rows.select("y", "at", "weight").mapInArrow(run, "b int, g double").groupBy("b").agg(F.sum("g").alias("g")).toPandas()
    sums = dict(zip(summed["b"].tolist(), summed["g"].tolist(), strict=True))
    n, rest = sums.pop(-2, 0.0) or 1.0, sums.pop(-1, 0.0)
    out = np.zeros_like(model.weights)
    out[list(sums)] = list(sums.values())
    shared.unpersist()
    return out / n, rest / n


def _tellingness(rows: DataFrame, buckets: int, ones: int, zeros: int) -> np.ndarray:
    """How differently rows of either label hold each bucket: at most as many rows as buckets."""
    found = rows.select("y", F.explode("at").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("y")).toPandas()
    out, b, y = np.zeros(buckets), found["b"].to_numpy(dtype=np.int64), found["y"].to_numpy(dtype=np.float64)
    out[b] = np.abs(np.log((y + 1) / (ones + 2)) - np.log((found["n"].to_numpy() - y + 1) / (zeros + 2)))
    return out


def fit_guard(rows: DataFrame, buckets: int, rounds: int = 40, ridge: float = 1e-4) -> Guard:
    """A logistic regression of y (0 or 1) on hashed words, by accelerated gradient descent: each round is a pass over all labelled rows.

    rows: y, at, weight, stored. Both labels count alike, however rare one is. A
    bucket is weighted by how differently the two labels hold it (the logarithm of
    the ratio of its shares), so that telling words do not drown in common ones.
    Rows have length one, which bounds the curvature, so the step is a constant
    and needs no search. Without rows of both labels the weights are zero.
    """
    ones = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    scale = _tellingness(rows, buckets, ones["y"], ones["n"] - ones["y"])
    now = Guard(scale, np.zeros(buckets), 0.0)
    if not 0 < ones["y"] < ones["n"]:
        return now
    positive = (ones["n"] - ones["y"]) / ones["y"]
    ahead, pace, step = now, 1.0, 1 / (0.25 * 2 + ridge)
    for _ in range(rounds):
        slope, rest = _gradient(rows, ahead, positive)
        new = Guard(scale, ahead.weights - step * (slope + ridge * ahead.weights), ahead.constant - step * rest)
        later = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / later
        ahead = Guard(scale, new.weights + push * (new.weights - now.weights), new.constant + push * (new.constant - now.constant))
        now, pace = new, later
    return now


def guarded(features: DataFrame, model: Guard, has_text: Column, threshold: float = 0.5) -> DataFrame:
    """features without at and weight, with score double and refused boolean. A row without a text has no score and is refused: the guard fails closed."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in features.columns if c not in ("at", "weight", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            row, bucket, value = _sparse(batch, len(kept), model.scale)
            score = _sigmoid(np.bincount(row, value * model.weights[bucket], batch.num_rows) + model.constant)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(score)], [*kept, "score"])

    schema = ", ".join(f"`{c}` {features.schema[c].dataType.simpleString()}" for c in kept)
    scored = features.select(*kept, "at", "weight").mapInArrow(run, f"{schema}, score double")
    score = F.when(F.coalesce(has_text, F.lit(False)), F.col("score"))
    return scored.withColumn("score", score).withColumn("refused", F.coalesce(F.col("score") >= threshold, F.lit(True)))
