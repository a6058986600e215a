"""Connected components and sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._spark import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """edges a, b (long) → node, root: the smallest node of its component, for every node of an edge between two nodes.

    Alternating stars: each node's larger neighbours are joined to its smallest
    one, then its smaller ones, until nothing changes; the rounds grow with the
    logarithm of the longest path. A hub's minimum is combined before the
    shuffle and written; the hub's edges meet it in a join of two tables, which
    Spark can split. Each round is a written table, so nothing is computed twice
    and lost executors cost one round at most; tables of earlier rounds are
    deleted.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return written(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        top = least(both)
        large = written(both.join(top, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        down = least(large)
        # below a node: its smaller neighbours and itself go to the smallest of them
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        last, now = now, written(small.where("u <> v").distinct(), "edges")
        for table in (last, top, large, down):
            dropped(table)
        mark = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), 1 << 40))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by keys (not null, integers) → tables of whole groups, and where each group begins and the last ends."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table]).combine_chunks()
        n = table.num_rows
        if not n:
            continue
        fresh = np.zeros(n, bool)
        fresh[0] = True
        for k in keys:
            values = table[k].to_numpy()
            fresh[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(fresh)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), starts
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])
