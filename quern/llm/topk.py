"""Exact top-k search by pivot-table elimination.

A table of the distances from every vector to a few dozen pivots is computed
once. For a query q and a candidate v, the largest |d(q, p) - d(v, p)| over the
pivots is a lower bound of d(q, v), and so, with both norms, gives an upper
bound of their inner product. A query scores its candidates in the order of
their bounds, a step at a time, and stops at the first whose bound is below its
k-th best score: the result is exact, whatever the pivots.

The queries are a stated set, dealt in blocks; all rows are dealt in chunks of
bounded size. A cell is one block against one chunk: queries of a block meet a
chunk in one task, which returns k rows a query at most; ranking these gives
the answer. Memory of a task is that of one cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._spark import read, written

PIVOTS = 32
#: Rows of a chunk and of a block of queries, about.
CHUNK_ROWS = 8192
BLOCK_QUERIES = 1024
#: Candidates of a query's first step (each next one is half as long again), and queries whose bounds are worked out together.
STEP, TOGETHER = 32, 64
#: Sums below this are exact in float64; larger ones are made of Python's integers.
_EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as array<long>; null if the vector is null, empty or holds a null, NaN or infinity. A component beyond 64 bits fails."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    beyond = F.raise_error(F.lit("a component does not fit 64 bits")).cast("long")
    number = lambda x: F.when(F.abs(x.cast("double") * scale) < float(1 << 63), F.floor(x.cast("double") * scale)).otherwise(beyond)
    return F.when((F.size(vector) > 0) & whole, F.transform(vector, number))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sampled vector farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """To each pivot, in float64: the integers involved are exact, so only the root is rounded."""
    square = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * (vectors @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def search_cell(q_ids, q, q_table, v_ids, v, v_table, k: int, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one chunk for each query: query ids, vector ids, scores. A query never meets its own id. q, v: integers. scored: gets how many candidates each query scored."""
    dim, pivots = q.shape[1], v_table.shape[1]
    v_table = np.ascontiguousarray(v_table.T)
    high = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (q, v)]
    exact = high[0] * high[1] * dim < _EXACT
    q_sums, v_sums = ((x.astype(np.float64) ** 2).sum(1) for x in (q, v))
    q, v = (x.astype(np.float64 if exact else object) for x in (q, v))
    # distances are rounded, also their squares where integers are no longer exact: the bound never gets too low
    slack = 1e-9 if max(high) ** 2 * dim * 4 < _EXACT else 1e-6
    out = []
    for at in range(0, len(q), TOGETHER):
        own, ids = q[at : at + TOGETHER], q_ids[at : at + TOGETHER]
        m = len(own)
        lower, gap = np.zeros((m, len(v))), np.empty((m, len(v)))
        for p in range(pivots):
            np.subtract(v_table[p][None, :], q_table[at : at + m, p][:, None], out=gap)
            np.maximum(lower, np.abs(gap, out=gap), out=lower)
        size = q_sums[at : at + m, None] + v_sums[None, :]
        bound = (size - lower**2) / 2 + slack * (1 + size)
        bound[ids[:, None] == v_ids[None, :]] = -np.inf
        for i in range(m):
            found, score = _in_bound_order(own[i], v, v_ids, bound[i], k, exact, scored)
            out.append((np.full(len(found), ids[i]), found, score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, np.int64) for _ in range(3))


def _in_bound_order(query: np.ndarray, v: np.ndarray, v_ids: np.ndarray, bound: np.ndarray, k: int, exact: bool, scored: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of one query's k best."""
    found, score, least, step, done = np.empty(0, np.int64), np.empty(0, np.int64), -np.inf, max(STEP, 2 * k), 0
    # of a step's length, those of the highest bounds; all others wait, in order
    first = np.argpartition(-bound, step)[:step] if step < len(bound) else np.arange(len(bound))
    order, waiting = first[np.argsort(-bound[first], kind="stable")], None
    while True:
        near = order[:step][bound[order[:step]] >= least]
        near = near[np.isfinite(bound[near])]
        if len(near):
            found = np.concatenate([found, v_ids[near]])
            score = np.concatenate([score, (v[near] @ query).astype(np.int64)])
            best = np.lexsort((found, ~score))[:k]  # ~x falls as x rises, without overflow
            found, score, done = found[best], score[best], done + len(near)
            if len(found) == k:
                least = float(score[-1]) if exact else np.nextafter(float(score[-1]), -np.inf)
        if waiting is None:
            rest = np.ones(len(bound), bool)
            rest[first] = False
            rest = np.flatnonzero(rest & (bound >= least))
            waiting = rest[np.argsort(-bound[rest], kind="stable")]
            order = waiting
        else:
            order, step = order[step:], step * 3 // 2
        if not len(order) or not bound[order[0]] >= least or not np.isfinite(bound[order[0]]):
            break
    if scored is not None:
        scored.append(done)
    return found, score


def _packed(df: DataFrame, group: str, pivots_shared) -> DataFrame:
    """One row per group: ids, vectors and pivot distances as binary. A group has a bounded number of rows."""

    def pack(key, table):
        vectors = table["vector"].combine_chunks()
        matrix = vectors.flatten().to_numpy().reshape(table.num_rows, -1)
        narrow = not matrix.size or -(1 << 31) <= matrix.min() and matrix.max() < 1 << 31
        matrix = matrix.astype(np.int32 if narrow else np.int64)
        ids = table["id"].to_numpy().astype(np.int64)
        far = distances(matrix.astype(np.float64), pivots_shared.value[matrix.shape[1]])
        return pa.table({"dim": pa.array([matrix.shape[1]], pa.int32()), group: pa.array([key[1].as_py()], pa.int32()), f"{group}_ids": [ids.tobytes()], f"{group}_v": [matrix.tobytes()], f"{group}_far": [far.tobytes()]})

    schema = f"dim int, {group} int, {group}_ids binary, {group}_v binary, {group}_far binary"
    return df.groupBy("dim", group).applyInArrow(pack, schema)


def exact_top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller id.

    vectors: arrays of integers in vector_col; rows with a null id or vector take no
    part. Scores are exact; one beyond 64 bits fails. Vectors of another length than a query's never meet it. Repeated ids
    are repeated candidates, and no candidate of a query with that id. Fewer
    than k candidates give fewer rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("vector"), is_query.alias("is_query")).where("id IS NOT NULL AND vector IS NOT NULL").withColumn("dim", F.size("vector"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()}  # one row per vector length
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = {}
    for dim in counts:  # 1,024 vectors a length, by hash of the id: enough to spread pivots, never more
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(1024).select("vector").toPandas()["vector"]
        chosen[dim] = choose_pivots(np.array(sample.tolist(), np.float64).reshape(len(sample), dim), pivots)
    shared = spark.sparkContext.broadcast(chosen)

    def parts(of: int, most: int) -> Column:
        number = F.create_map(*[F.lit(x) for dim, n in counts.items() for x in (dim, max(1, -(-n[of] // most)))])
        return number[F.col("dim")]

    chunks = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), parts(0, CHUNK_ROWS)).cast("int"))
    blocks = rows.where("is_query").withColumn("block", F.pmod(F.xxhash64("row"), parts(1, BLOCK_QUERIES)).cast("int"))
    chunks, blocks = written(_packed(chunks, "chunk", shared), "chunks"), written(_packed(blocks, "block", shared), "blocks")
    # each chunk goes once to each block of queries of its length
    cells = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), (parts(1, BLOCK_QUERIES) - 1).cast("int")))).join(blocks, ["dim", "block"])

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ints = lambda name, n: np.frombuffer(r[name], np.int32 if len(r[name]) == 4 * n * r["dim"] else np.int64).reshape(n, -1)  # noqa: E731, B023
                q_ids, v_ids = np.frombuffer(r["block_ids"], np.int64), np.frombuffer(r["chunk_ids"], np.int64)
                table = lambda name, n: np.frombuffer(r[name], np.float64).reshape(n, -1)  # noqa: E731, B023
                q, v, s = search_cell(q_ids, ints("block_v", len(q_ids)), table("block_far", len(q_ids)), v_ids, ints("chunk_v", len(v_ids)), table("chunk_far", len(v_ids)), k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    n_cells = sum(-(-n // CHUNK_ROWS) * max(1, -(-q // BLOCK_QUERIES)) for n, q in counts.values())
    spread = cells.repartition(max(1, min(n_cells, 20_000)), "chunk", "block")
    found = spread.mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    return exact_top_k(rows, "vec_id", "vector", F.col("vec_id") % 50 == 0)


OP2_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
               FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
         r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
