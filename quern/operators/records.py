"""Operators on tagged records: freshness, uniqueness, vocabulary, gaps and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(rows: DataFrame, seen: Column, posted: Column, days: int) -> DataFrame:
    """Rows posted at most so many days before they were seen; rows without either date go."""
    return rows.where(F.date_diff(seen, posted) <= days)


def on_topic(rows: DataFrame, label: Column) -> DataFrame:
    """Rows whose label says that they are of the topic; rows without a label go."""
    return rows.where(F.coalesce(label.cast("boolean"), F.lit(False)))


def with_tags(rows: DataFrame, tags: Column) -> DataFrame:
    """Rows that name a tag; a null tag names nothing, and rows without tags or with null ones alone go."""
    return rows.where(F.coalesce(F.exists(tags, lambda t: t.isNotNull()), F.lit(False)))


def unique(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by order (nulls last). Rows that repeat both give one row; rows with a null key are one key's.

    Each task hands on the first row of a key alone, so a key with very many rows is no load.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last(order)))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def to_vocabulary(rows: DataFrame, word: str, synonyms: DataFrame) -> DataFrame:
    """rows with term: what synonyms (word, term) says, or the word itself. Words are matched by equality.

    Of several terms for a word the first in order counts, so no row is
    multiplied. Null words have a null term; repeated rows each get theirs.
    """
    one = synonyms.where("word IS NOT NULL").groupBy(F.col("word").alias(word)).agg(F.min("term").alias("term"))
    return rows.join(one, word, "left").withColumn("term", F.coalesce("term", word))


def gap(demanded: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """What is demanded and not held. Null demands are never held; repeated ones each stay."""
    return demanded.join(held.select(on).distinct(), on, "left_anti")


def coverage(weights: DataFrame, options: DataFrame, on: str, weight: str) -> DataFrame:
    """option, covered, share, rank: the weight of what each option names, of the whole, best first; ties by option."""
    total = weights.agg(F.sum(weight).alias("_total"))
    summed = options.select("option", on).distinct().join(weights, on).groupBy("option").agg(F.sum(weight).alias("covered"))
    ranked = summed.crossJoin(F.broadcast(total))  # one row
    rank = F.row_number().over(Window.orderBy(F.desc("covered"), "option"))  # a row per option: few
    return ranked.select("option", "covered", F.round(100.0 * F.col("covered") / F.col("_total"), 4).alias("share"), rank.alias("rank"))


def markdown_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """line: each row as a row of a Markdown table; arrays are joined by commas, nulls are empty and go from arrays. Repeated rows are repeated lines."""
    cells = [F.array_join(F.col(c).cast("array<string>"), ", ") if table.schema[c].dataType.typeName() == "array" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
