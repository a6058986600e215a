"""Phrases of several words found in texts and mapped to a controlled vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources import tables

#: A word (fixed value): a run of ASCII letters and digits, A-Z in lower case, and of any characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; null and wordless texts have none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), 1)


def phrase_table(phrases: DataFrame) -> DataFrame:
    """phrases (phrase, term) → phrase (its words joined by spaces), size, term: one row a phrase, of several terms the first in order. Null and wordless phrases and null terms go."""
    own = phrases.select(words(F.col("phrase")).alias("_w"), "term").where((F.size("_w") > 0) & F.col("term").isNotNull())
    return own.groupBy(F.array_join("_w", " ").alias("phrase")).agg(F.first(F.size("_w")).alias("size"), F.min("term").alias("term"))


def occurrences(docs: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """key, row, at (number of the first word, from 0), size, phrase, term: every place of every phrase, overlapping ones too.

    row numbers the rows of docs, so that rows that repeat a key stay apart. Runs
    of words are made in the sizes that phrases have, and joined by equality: the table
    of phrases is written first, so that Spark knows its size and broadcasts a small one, or
    shuffles runs of words for a large one. Texts do not
    move, their runs of words do.
    """
    table = tables.kept(phrase_table(phrases), "phrases")
    sizes = table.agg(F.sort_array(F.collect_set("size")).alias("_sizes"))  # one row, as many sizes as the longest phrase has words
    rows = docs.select(F.col(key), words(F.col(text)).alias("_w")).withColumn("row", F.monotonically_increasing_id())
    runs = rows.crossJoin(F.broadcast(sizes)).select(key, "row", "_w", F.explode("_sizes").alias("size")).where(F.size("_w") >= F.col("size"))
    runs = runs.select(key, "row", "size", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("size") + 1), lambda i: F.array_join(F.slice("_w", i, F.col("size")), " "))).alias("at", "phrase"))
    return runs.join(table, ["phrase", "size"]).select(key, "row", "at", "size", "phrase", "term")


def tag_phrases(docs: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """key, at, size, phrase, term: the phrases of a text from left to right, at each place the longest, none overlapping one before it.

    docs: key and text; phrases: phrase and term. Null and empty texts have no
    phrases, a key that repeats has those of each of its rows, and no phrases give
    no rows. Matches that overlap are a cluster; the choice is made within a
    cluster, so what is folded together is as long as a chain of overlaps.
    """
    found = occurrences(docs, key, text, phrases)
    longest = found.groupBy(key, "row", "at").agg(F.max(F.struct("size", "phrase", "term")).alias("_m"))
    by = Window.partitionBy("row").orderBy("at")
    reach = F.max(F.col("at") + F.col("_m.size")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    clusters = longest.withColumn("_new", (F.coalesce(reach, F.lit(0)) <= F.col("at")).cast("int")).withColumn("_cluster", F.sum("_new").over(by))
    ordered = clusters.groupBy(key, "row", "_cluster").agg(F.array_sort(F.collect_list(F.struct("at", "_m.size", "_m.phrase", "_m.term"))).alias("_all"))
    kind = ordered.schema["_all"].dataType
    none = F.struct(F.lit(0).alias("reach"), F.array().cast(kind).alias("kept"))
    take = lambda s, x: F.when(x["at"] >= s["reach"], F.struct((x["at"] + x["size"]).alias("reach"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    return ordered.select(key, F.explode(F.aggregate("_all", none, take)["kept"]).alias("_k")).select(key, "_k.at", "_k.size", "_k.phrase", "_k.term")
