"""Labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, about. All labelled rows are used where there are fewer.
SAMPLE_ROWS = 40_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, y (0 or 1) of labelled rows that keep accepts: all, or about so many of them chosen by hash of the key.

    keep is an expression over doc_id. Labels that are null or neither 0 nor 1
    and null keys take no part; of a key's labels the largest counts. Rows that
    repeat a key are all taken, unless that makes more than `most` (and a tenth):
    then one row of each key.
    """
    y = F.col(label).cast("int")
    rows = labels.select(F.col("doc_id"), y.alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(keep)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), 1_000_000) < int(1_000_000 * most / n))
    # at most `most` keys, give or take the chance of the hash: a size that is bounded, so the texts need no shuffle
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    many = docs.select("doc_id").join(F.broadcast(rows), "doc_id").count() > most + most // 10
    return found.dropDuplicates(["doc_id"]) if many else found
