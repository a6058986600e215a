"""Vector retrieval: exact top-k in blocks, an inverted-file index, and retrieval metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block: a task multiplies one block of queries with one of candidates.
BLOCK = 2048
#: Components of a block of top_k, at most: the larger the blocks are, the fewer copies of them meet.
COMPONENTS = 1 << 20
#: Products that a task holds at once, and pairs whose full scores it works out at once.
_PRODUCTS, _PAIRS = 1 << 22, 1 << 15
#: Vectors that the index's centroids are fitted on, by hash of the id.
FIT_ROWS = 20_000


def _blocked(vectors: DataFrame, block: str, count: int) -> DataFrame:
    """One row per block: ids and vectors as arrays. Blocks are dealt by hash of the id and hold about BLOCK rows."""
    dealt = vectors.withColumn(block, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return dealt.groupBy(block).agg(F.collect_list(F.struct("id", "vector")).alias(f"{block}_rows"))


def _matrix(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    structs = rows.values
    ids, vectors = structs.field("id").to_numpy(), structs.field("vector")
    return ids, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def similarity(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Higher is nearer: cosine (NaN where a vector has no length) or minus the Euclidean distance."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return (a @ b.T) / np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return -np.sqrt(np.maximum(square, 0))


def _scores(q: np.ndarray, v: np.ndarray, at: np.ndarray, to: np.ndarray, metric: str) -> np.ndarray:
    """The scores, to six places, of the pairs q[at], v[to]."""
    out, lengths = np.empty(len(at)), [np.sqrt((x * x).sum(1)) for x in (q, v)]
    for i in range(0, len(at), _PAIRS):
        a, b = at[i : i + _PAIRS], to[i : i + _PAIRS]
        out[i : i + _PAIRS] = np.einsum("ij,ij->i", q[a], v[b]) / (lengths[0][a] * lengths[1][b]) if metric == "cosine" else -np.sqrt(((q[a] - v[b]) ** 2).sum(1))
    return np.round(out, 6)


def _directed(ids: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and x by id, without rows that have no score; and what is multiplied: for the cosine x at length one in 32 bits, else x."""
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = x / np.sqrt((x * x).sum(1, keepdims=True)) if metric == "cosine" else x
    order = np.argsort(ids, kind="stable")
    order = order[np.isfinite(unit[order]).all(1)]
    return ids[order], x[order], unit[order].astype(np.float32 if metric == "cosine" else np.float64)


def _best(batches, left: str, right: str, k: int, metric: str):
    """The k best of each query of a cell; of those that tie with the k-th to six places the smaller ids.

    One product of matrices tells which rows can be among them, as far as its
    rounding goes; these alone get a full score.
    """
    for batch in batches:
        q_rows, v_rows = batch.column(batch.schema.get_field_index(left)), batch.column(batch.schema.get_field_index(right))
        for i in range(batch.num_rows):
            q_ids, q, a = _directed(*_matrix(q_rows[i]), metric)
            v_ids, v, b = _directed(*_matrix(v_rows[i]), metric)
            if not len(q_ids) or not len(v_ids):
                continue
            square = [(x * x).sum(1) for x in (q, v)]
            for first in range(0, len(q), step := max(1, _PRODUCTS // len(v))):
                part = slice(first, first + step)
                near = a[part] @ b.T
                if metric != "cosine":
                    near *= 2
                    near -= square[0][part, None]
                    near -= square[1][None, :]
                own = np.searchsorted(v_ids, q_ids[part]), np.searchsorted(v_ids, q_ids[part], "right")
                for row in np.flatnonzero(own[1] > own[0]):
                    near[row, own[0][row] : own[1][row]] = -np.inf
                kth = near.max(1) if k == 1 else np.partition(near, -min(k, len(v)), axis=1)[:, -min(k, len(v))]
                if metric == "cosine":
                    kth = kth - (2e-6 + 3e-7 * q.shape[1])
                else:
                    kth = -((np.sqrt(np.maximum(-kth, 0)) + 2e-6) ** 2) - 1e-12 * (square[0][part] + square[1].max())
                at, to = np.nonzero(near >= np.maximum(kth, np.finfo(near.dtype).min)[:, None].astype(near.dtype))
                score = _scores(q[part], v, at, to, metric)
                order = np.lexsort((v_ids[to], -score, at))
                at, to, score = at[order], to[order], score[order]
                yes = np.arange(len(at)) - np.searchsorted(at, at) < k
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[part][at[yes]], pa.int64()), "id": pa.array(v_ids[to[yes]], pa.int64()), "score": pa.array(score[yes])})


def ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, metric: str = "cosine") -> DataFrame:
    """query_id, rank, id, score (six places): each query's k nearest other vectors, ties to the smaller id.

    vectors: id long, vector array of one length. Null ids or vectors and vectors
    without length (cosine) take no part. Queries and rows are cut into blocks
    of a bounded number of components; each pair of blocks is one row of a join on
    block numbers, multiplied in a task. The work is queries times rows; what moves
    is rows times blocks of queries, and queries times blocks of rows.
    """
    rows = vectors.where("id IS NOT NULL AND vector IS NOT NULL")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("vector")).alias("d")).first()
    most, cores = max(1, COMPONENTS // max(1, counts["d"] or 1)), vectors.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-counts["n"] // most), min(-(-counts["n"] // BLOCK), 2 * cores))
    blocks = max(1, -(-counts["q"] // most))
    cells = min(2 * blocks * chunks, 20_000)
    queries = _blocked(rows.where(is_query), "block", blocks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    candidates = _blocked(rows, "chunk", chunks).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = candidates.repartition(cells, "block", "chunk").join(queries.repartition(cells, "block", "chunk"), ["block", "chunk"])
    found = met.mapInArrow(lambda b: _best(b, "block_rows", "chunk_rows", k, metric), "query_id long, id long, score double")
    return ranked(found, k)


def fit_centroids(vectors: DataFrame, lists: int, rounds: int = 10) -> np.ndarray:
    """k-means centroids of at most FIT_ROWS vectors, by hash of the id: a bounded sample, as only the partition depends on it."""
    sample = vectors.where("id IS NOT NULL AND vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector").toPandas()["vector"]
    x = np.array(sample.tolist(), np.float64)
    if not len(x):
        return np.zeros((1, 1))
    centers = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(rounds):
        near = similarity(x, centers, "l2").argmax(1)
        for c in range(len(centers)):
            if (near == c).any():
                centers[c] = x[near == c].mean(0)
    return centers


def ivf_top_k(vectors: DataFrame, is_query: Column, k: int = 5, lists: int | None = None, probed: float = 0.69, metric: str = "cosine") -> DataFrame:
    """Like top_k, but each query meets only the lists of its nearest centroids, a share `probed` of all. Every row is indexed.

    lists: by default as many as half the root of the rows, between 32 and a
    tenth of FIT_ROWS. A list and its queries are cut into blocks of about BLOCK
    rows by hash of the id, so a list that holds a third of all rows is many
    cells. What share has to be probed for a recall depends on the data: on
    near-uniform vectors most, on clustered ones few.
    """
    rows = vectors.where("id IS NOT NULL AND vector IS NOT NULL")
    if lists is None:
        lists = min(max(32, int(rows.count() ** 0.5 / 2)), FIT_ROWS // 10)
    probes = max(1, math.ceil(probed * lists))
    shared = vectors.sparkSession.sparkContext.broadcast(fit_centroids(rows, lists))

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, column = batch.column(0), batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            near = np.argsort(-similarity(x, shared.value, "l2"), axis=1)[:, :probes]
            yield pa.RecordBatch.from_pydict({"id": ids, "vector": column, "is_query": batch.column(2), "probe": pa.array(near.tolist(), pa.list_(pa.int32()))})

    kind = rows.schema["vector"].dataType.simpleString()
    placed = rows.select(F.col("id").cast("long").alias("id"), "vector", is_query.alias("is_query")).mapInArrow(assign, f"id long, vector {kind}, is_query boolean, probe array<int>")
    own = placed.select("id", "vector", F.get("probe", 0).alias("list"))
    sizes = own.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = own.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))  # a row per centroid
    stored = own.groupBy("list", "part").agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    asked = placed.where("is_query").select("id", "vector", F.explode("probe").alias("list"))
    wanted = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices"))
    asked = asked.join(F.broadcast(wanted), "list").withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), "slices").cast("int"))  # a row per centroid
    asked = asked.groupBy("list", "slice").agg(F.collect_list(F.struct("id", "vector")).alias("asked"))
    asked = asked.join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    cells = asked.join(stored, ["list", "part"]).repartition("list", "part", "slice")
    found = cells.mapInArrow(lambda b: _best(b, "asked", "rows", k, metric), "query_id long, id long, score double")
    return ranked(found, k)


def relevance_metrics(hits: DataFrame, ks: list[int]) -> DataFrame:
    """hits: query_id, rank, relevant → one row: queries, hit_at_k for each k, mrr. A query without a relevant row counts 0."""
    first = hits.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    rate = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return first.agg(F.count("*").alias("queries"), *[F.round(rate(k), 6).alias(f"hit_at_{k}") for k in ks], F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def gate(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """metric, value, least, passed: one row per threshold; a null metric fails."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("least")) for m, t in least.items()])
    return metrics.select(F.inline(rows)).withColumn("passed", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))
