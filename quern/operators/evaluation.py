"""Rates and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(rows: DataFrame, by: list[str], happened: Column, name: str) -> DataFrame:
    """by, n, name: the share of rows in which it happened (six places). Rows in which it is unknown do not count."""
    return rows.where(happened.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(happened.cast("double")), 6).alias(name))


def mean_gate(rows: DataFrame, score: Column, least: float) -> DataFrame:
    """n, mean (six places), least, passed: the mean of given scores and whether it reaches the threshold. Null scores do not count; without a score the mean is null and fails."""
    counted = rows.agg(F.count(score).alias("n"), F.round(F.avg(score.cast("double")), 6).alias("mean"))
    return counted.withColumns({"least": F.lit(float(least)), "passed": F.coalesce(F.col("mean") >= least, F.lit(False))})


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa (Cohen): of two raters' labels. Null where chance alone would agree. Pairs with a null label do not count."""
    counted = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows, columns = counted.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("r")), counted.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("c"))
    chance = rows.join(columns, "v").agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("e"))
    t, p = F.col("t").cast("double"), F.col("same") / F.col("t")
    expected = F.coalesce("e", F.lit(0.0)) / (t * t)
    both = total.crossJoin(F.broadcast(chance))  # one row each
    return both.select(F.coalesce("t", F.lit(0)).alias("n"), F.round(p, 6).alias("agreement"), F.round(F.when(expected < 1, (p - expected) / (1 - expected)), 6).alias("kappa"))
