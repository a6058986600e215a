"""Tally of tagged records: how many records name each tag, their share, and example records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import tasks

#: Tasks that count pairs, for each that the input's size asks for: pairs take several times the memory of their records.
COUNTING = 4


def tally(records: DataFrame, tags: Column, key: Column, order: list[Column], examples: int = 3) -> DataFrame:
    """One row per tag: tag, n (distinct keys that name it), pct of all distinct keys, and the first keys by order.

    A key counts once per tag, however often it names it, at its first place in
    the order. Records without tags count in the total. Null keys do not count.
    The records are dealt by key to COUNTING times the tasks that the input's size asks for, and
    only there they become (tag, key) pairs, which are counted in their order where
    they are: a task that reads holds no pairs, however large its split is, one that
    counts a bounded share of them. What it hands on of a tag is its count and first
    keys, so that a tag that all records name is no task's. Records of one key meet.
    """
    parts, counting = tasks(records), tasks(records, COUNTING)
    place = F.struct(*order, key.alias("_id")) if order else key
    keyed = records.select("*", key.alias("_key")).where("_key IS NOT NULL")
    dealt = keyed.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(counting)).cast("int")).repartitionById(counting, "_part")
    named = dealt.select("_part", "_key", place.alias("_at"), F.explode(F.array_distinct(tags)).alias("tag")).where("tag IS NOT NULL")
    # without an order the key is its own place, and equal places are one key
    named = named.groupBy("tag", "_part", "_key").agg(F.min("_at").alias("_at")) if order else named
    ranked = named.select("tag", "_part", "_at", F.dense_rank().over(Window.partitionBy("tag", "_part").orderBy("_at")).alias("_rank"))
    first = [F.max(F.when(F.col("_rank") == i + 1, F.struct("_at"))) for i in range(examples)]
    counted = ranked.groupBy("tag", "_part").agg(F.max("_rank").cast("long").alias("_n"), F.array_compact(F.array(*first)).alias("_first"))
    tallied = counted.repartition(parts, "tag").groupBy("tag").agg(F.sum("_n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("_first"))), 1, examples).alias("_first"))
    total = keyed.select("_key").repartition(parts, "_key").agg(F.countDistinct("_key").alias("_total"))
    return (
        tallied.crossJoin(F.broadcast(total))  # one row
        .select("tag", "n", F.round(100.0 * F.col("n") / F.col("_total"), 2).alias("pct"), F.transform("_first", lambda x: x["_at"]["_id"] if order else x["_at"]).alias("examples"))
    )


def most_named(tallied: DataFrame) -> DataFrame:
    """A tally in its order: by n descending, then by tag, cut into ranges for as many tasks as the input's size asks for."""
    order = [F.desc("n"), F.asc("tag")]
    return tallied.repartitionByRange(tasks(tallied), *order).sortWithinPartitions(*order)
