"""Approximate search by product quantisation: vectors as a few bytes, table look-ups, exact re-ranking.

A vector is cut into parts; each part is replaced by the number of the nearest
of 256 codewords, so that a vector is one byte a part. Codebooks are fitted on a
bounded sample by hash of the id; every row is coded. A search adds, for each
code, the table entries of its bytes, keeps the best candidates of each query,
and works out the full distance for these alone. What a code hides of its vector
has a known length, so a search may also go on until no other row can be nearer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as arithmetic
from quern.operators.retrieval import FIT_ROWS, _scores, ranked

#: Codewords of a part: what a byte holds.
WORDS = 256
#: Codes and queries of a cell: one task adds the tables of a block of queries over a block of codes.
CODES, QUERIES = 1 << 18, 256
#: The same where the cells hold vectors too.
FULL_CODES, FULL_QUERIES = 1 << 14, 2048
#: Sums that a task holds at once.
_SUMS = 1 << 21


def _matrix(column: pa.Array, count: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(count, -1)


def _of_length_one(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; rows without one become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(1)[None, :] - 2 * x @ words.T).argmin(1)


def fit_codebooks(sample: np.ndarray, parts: int, rounds: int = 12) -> list[np.ndarray]:
    """For each part of the columns, up to WORDS codewords by k-means. Seeds are rows of the sample at even distances; a word that nothing is near to moves to the row that is served worst."""
    books = []
    for columns in np.array_split(np.arange(sample.shape[1]), parts):
        x = sample[:, columns]
        words = np.unique(x[np.linspace(0, len(x) - 1, min(WORDS, len(x))).astype(int)], axis=0)
        for _ in range(rounds):
            near = _nearest(x, words)
            count = np.bincount(near, minlength=len(words))
            total = np.zeros_like(words)
            np.add.at(total, near, x)
            words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
            idle = np.flatnonzero(count == 0)
            if len(idle):
                far = np.argsort(-((x - words[near]) ** 2).sum(1), kind="stable")[: len(idle)]
                words[idle[: len(far)]] = x[far]
        books.append(words)
    return books


def encode(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """One byte a part for each row."""
    at, out = 0, np.empty((len(x), len(books)), np.uint8)
    for m, words in enumerate(books):
        out[:, m] = _nearest(x[:, at : at + words.shape[1]], words)
        at += words.shape[1]
    return out


def tables(q: np.ndarray, books: list[np.ndarray], metric: str) -> np.ndarray:
    """queries x parts x WORDS: what each byte adds to a query's score. Higher is nearer: inner product, or minus the squared distance."""
    out, at = np.zeros((len(q), len(books), WORDS), np.float32), 0
    for m, words in enumerate(books):
        own = q[:, at : at + words.shape[1]]
        out[:, m, : len(words)] = own @ words.T if metric == "cosine" else -((own[:, None, :] - words[None, :, :]) ** 2).sum(2)
        at += words.shape[1]
    return out


def _decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The codewords that codes stand for."""
    return np.hstack([words[codes[:, m]] for m, words in enumerate(books)])


def _index(rows: DataFrame, books: Broadcast, metric: str, full: bool = False) -> DataFrame:
    """id, code of rows (id, vector), in full also hidden, the length of what the code leaves out, and vector; rows that have no direction (cosine) have no code."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), batch.num_rows)
                x = _of_length_one(x) if metric == "cosine" else x
                yes = np.isfinite(x).all(1)
                codes = encode(x[yes], books.value)
                out = {"id": batch.column(0).filter(pa.array(yes)), "code": pa.array([c.tobytes() for c in codes], pa.binary())}
                if full:
                    hidden = np.sqrt(((x[yes] - _decode(codes, books.value)) ** 2).sum(1))
                    out |= {"hidden": pa.array(hidden), "vector": batch.column(1).filter(pa.array(yes))}
                yield pa.RecordBatch.from_pydict(out)

    more = f", hidden double, vector {rows.schema['vector'].dataType.simpleString()}" if full else ""
    return rows.select("id", "vector").mapInArrow(run, f"id long, code binary{more}")


def _sums(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """queries x codes: the entries of each code's bytes, added."""
    sums = np.zeros((len(table), len(codes)), np.float32)
    for m in range(codes.shape[1]):
        sums += table[:, m, :][:, codes[:, m]]
    return sums


def _scan(batches, books: Broadcast, metric: str, keep: int):
    """Cells of queries and codes → the best codes of each query by the sum of its table's entries."""
    for batch in batches:
        for i in range(batch.num_rows):
            asked, held = batch.column(0)[i].values, batch.column(1)[i].values
            q_ids, q = asked.field("id").to_numpy(), _matrix(asked.field("vector"), len(asked))
            ids = held.field("id").to_numpy()
            codes = np.frombuffer(b"".join(held.field("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            table = tables(_of_length_one(q) if metric == "cosine" else q, books.value, metric)
            for at in range(0, len(q), step := max(1, _SUMS // max(1, len(ids)))):
                part = table[at : at + step]
                sums = _sums(part, codes)
                sums[(q_ids[at : at + step, None] == ids[None, :]) | ~np.isfinite(sums)] = -np.inf
                most = min(keep, len(ids))
                near = np.argpartition(-sums, most - 1, axis=1)[:, :most]
                score = np.take_along_axis(sums, near, 1).ravel()
                yes = np.isfinite(score)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(q_ids[at : at + step], most)[yes], pa.int64()), "id": pa.array(ids[near.ravel()][yes], pa.int64()), "score": pa.array(score[yes].astype(np.float64))})


def _most(sums: np.ndarray, table: np.ndarray, hidden: np.ndarray, metric: str) -> np.ndarray:
    """The highest score that each row can have with each query, by the length that its code hides. What rounding to 32 bits may have lost is allowed for."""
    lost = 1e-5 * np.abs(table).max(2).sum(1)[:, None]
    if metric == "cosine":
        return sums + lost + hidden[None, :]
    return -np.maximum(np.sqrt(np.maximum(-sums - lost, 0)) - hidden[None, :], 0)


def _scan_in_full(batches, books: Broadcast, metric: str, k: int):
    """Cells of queries and codes with their vectors → the k nearest of each query in the cell: first those that the codes rank highest, then all that can reach the k-th of these."""
    for batch in batches:
        for i in range(batch.num_rows):
            asked, held = batch.column(0)[i].values, batch.column(1)[i].values
            q_ids, q = asked.field("id").to_numpy(), _matrix(asked.field("vector"), len(asked))
            ids, v, hidden = held.field("id").to_numpy(), _matrix(held.field("vector"), len(held)), held.field("hidden").to_numpy()
            codes = np.frombuffer(b"".join(held.field("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            table = tables(_of_length_one(q) if metric == "cosine" else q, books.value, metric)
            for first in range(0, len(q), step := max(1, _SUMS // max(1, len(ids)))):
                part = slice(first, first + step)
                most = _most(_sums(table[part], codes), table[part], hidden, metric)
                most[(q_ids[part, None] == ids[None, :]) | ~np.isfinite(most)] = -np.inf
                some = min(max(64, 4 * k), len(ids))
                near = np.argpartition(-most, some - 1, axis=1)[:, :some]
                sure = _scores(q[part], v, np.repeat(np.arange(len(near)), some), near.ravel(), metric).reshape(near.shape)
                sure[~np.isfinite(np.take_along_axis(most, near, 1))] = -np.inf
                reach = np.partition(sure, -k, axis=1)[:, -k] if some >= k else np.full(len(near), -np.inf)
                at, to = np.nonzero((most >= reach[:, None] - 2e-6) & np.isfinite(most))
                score = _scores(q[part], v, at, to, metric)
                order = np.lexsort((ids[to], -score, at))
                at, to, score = at[order], to[order], score[order]
                yes = np.arange(len(at)) - np.searchsorted(at, at) < k
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[part][at[yes]], pa.int64()), "id": pa.array(ids[to[yes]], pa.int64()), "score": pa.array(score[yes])})


def _fitted(rows: DataFrame, parts: int, metric: str) -> Broadcast | None:
    """Codebooks on a bounded sample of rows (id, vector); none if no row has a code."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector").toPandas()["vector"]  # a bounded sample: only the codebooks depend on it
    x = np.array(sample.tolist(), np.float64)
    if metric == "cosine" and len(x):
        x = _of_length_one(x)
    x = x[np.isfinite(x).all(1)] if len(x) else x
    return rows.sparkSession.sparkContext.broadcast(fit_codebooks(x, min(parts, x.shape[1]))) if len(x) else None


def _cells(rows: DataFrame, index: DataFrame, codes: int, queries: int) -> DataFrame:
    """asked, held: every block of about so many queries with every chunk of about so many rows of an index."""
    counts = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    chunks, blocks = max(1, -(-counts["n"] // codes)), max(1, -(-counts["q"] // queries))
    dealt = lambda by, name: F.pmod(F.xxhash64("id"), F.lit(by)).cast("int").alias(name)
    held = index.groupBy(dealt(chunks, "chunk")).agg(F.collect_list(F.struct(*index.columns)).alias("held"))
    asked = rows.where("is_query").groupBy(dealt(blocks, "block")).agg(F.collect_list(F.struct("id", "vector")).alias("asked"))
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return asked.join(held, "chunk").repartition(min(chunks * blocks, 20_000), "chunk", "block").select("asked", "held")


def candidates(vectors: DataFrame, is_query: Column, parts: int, keep: int, metric: str) -> DataFrame:
    """query_id, id: the `keep` best of each query by its codes. vectors: id, vector, neither null."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vector", is_query.alias("is_query"))
    books = _fitted(rows, parts, metric)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long")
    cells = _cells(rows, _index(rows, books, metric), CODES, QUERIES)
    found = cells.mapInArrow(lambda b: _scan(b, books, metric, keep), "query_id long, id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("_r", best).where(F.col("_r") <= keep).select("query_id", "id")


def pq_top_k(vectors: DataFrame, is_query: Column, k: int = 5, parts: int = 16, share: float = 0.05, most: int = 400, metric: str = "cosine") -> DataFrame:
    """query_id, rank, id, score (six places) like retrieval.top_k, but full distances are worked out for a share of the rows alone.

    parts: bytes of a code. Candidates of a query: `share` of all rows, at least
    10 k and at most `most`, however many rows there are. Every row is indexed;
    what is approximate is which rows become candidates. Null ids and vectors
    take no part, and by cosine those without length; vectors have one length. A
    query's candidates meet its vector by a join on ids, and their distances are
    column expressions.
    """
    rows = vectors.where("id IS NOT NULL AND vector IS NOT NULL")
    keep = int(min(most, max(10 * k, share * rows.count())))
    found = candidates(rows, is_query, parts, keep, metric)
    stored = rows.select("id", "vector")
    asked = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    full = found.join(stored, "id").join(asked, "query_id")
    a, b = F.col("query"), F.col("vector")
    score = arithmetic.cosine(a, b) if metric == "cosine" else -arithmetic.l2(a, b)
    return ranked(full.select("query_id", "id", F.round(score, 6).alias("score")).where("score IS NOT NULL"), k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, parts: int = 16, metric: str = "cosine") -> DataFrame:
    """query_id, rank, id, score (six places): the rows of retrieval.top_k, with full distances only where the codes leave a doubt.

    A vector is its codewords and what they hide. The length of this is stored with
    the code and bounds how far the sum of table entries is from the score, so a row
    whose bound is below the k-th score that was worked out is no result. How many
    rows remain depends on the vectors. Takes what pq_top_k takes.
    """
    rows = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vector", is_query.alias("is_query"))
    books = _fitted(rows, parts, metric)
    if books is None:
        return ranked(vectors.sparkSession.createDataFrame([], "query_id long, id long, score double"), k)
    cells = _cells(rows, _index(rows, books, metric, full=True), FULL_CODES, FULL_QUERIES)
    return ranked(cells.mapInArrow(lambda b: _scan_in_full(b, books, metric, k), "query_id long, id long, score double"), k)
