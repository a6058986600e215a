"""Tagged records in Markdown blocks, and JSON lines with a fixed schema.

A file of records begins with ``Ads collected: <n>``; each record is a heading
``### <company> — <title> — <city>`` (em dashes), then ``URL:``, ``Seen:`` (an
ISO date), snippets in lines that begin with ``- ``, and ``Tags:``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.tables import tasks

SPLIT = " — "


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """source_file, pos, company, title, city, url, seen, snippets, tags: one row per block of every file in path.

    The block separator is the record delimiter of the reader, so large files
    are split and no file is held whole. pos is the record's number in its file,
    from 1: its number within the split, and what the splits before it hold,
    which is one row a split. Headings are cut at em dashes alone. A block without
    tags has an empty list. Repeated blocks are records each; an empty file has none.
    """
    lines = _blocks(spark, path)
    splits = lines.groupBy("source_file", "_split").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"), F.min_by("_head", "_row").alias("_heads"))
    before = Window.partitionBy("source_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_heads", F.when(F.col("_split") == 0, F.col("_heads")).otherwise(0))
    splits = splits.withColumn("_before", F.coalesce(F.sum(F.col("_n") - F.col("_heads")).over(before), F.lit(0)))
    lines = lines.join(F.broadcast(splits), ["source_file", "_split"])  # a row a split: the blocks stay where they are read
    blocks = lines.where((F.col("_row") > F.col("_first")) | (F.col("_heads") == 0))
    line = lambda name: F.regexp_extract("value", rf"(?m)^{name}: ?(.*)$", 1)
    head = F.split(F.regexp_extract("value", r"^(?:### )?([^\n]*)", 1), SPLIT)
    return blocks.select(
        "source_file",
        (F.col("_row") - F.col("_first") + F.col("_before") + 1 - F.col("_heads")).cast("int").alias("pos"),
        F.get(head, 0).alias("company"),
        F.get(head, 1).alias("title"),
        F.get(head, 2).alias("city"),
        line("URL").alias("url"),
        F.try_to_date(line("Seen")).alias("seen"),
        F.regexp_extract_all("value", F.lit(r"(?m)^- (.*)$"), 1).alias("snippets"),
        F.filter(F.transform(F.split(line("Tags"), ","), lambda x: F.trim(x)), lambda x: x != "").alias("tags"),
    )


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """value, source_file, _split (where the split begins in the file), _row (ascending within a split) and _head (1 if a first block looks like a count)."""
    lines = spark.read.option("lineSep", "\n### ").text(path)
    return lines.select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"), F.col("value").startswith("Ads collected:").cast("int").alias("_head"))


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """source_file, stated: the count in each file's first line. A later block that looks like one is a record."""
    first = _blocks(spark, path).where("_split = 0").groupBy("source_file").agg(F.min_by(F.struct("value", "_head"), "_row").alias("_f")).where("_f._head = 1")
    return first.select("source_file", F.regexp_extract("_f.value", r"^Ads collected: *([0-9]+)", 1).try_cast("long").alias("stated"))


def record_block(company, title, city, url, seen, snippets, tags):
    """The Markdown of one record, without the leading marks of its heading."""
    head = F.concat_ws(SPLIT, company, title, city)
    body = F.array_join(F.transform(snippets, lambda s: F.concat(F.lit("- "), s)), "\n")
    return F.concat(head, F.lit("\nURL: "), url, F.lit("\nSeen: "), seen.cast("string"), F.lit("\nRequirements:\n"), body, F.lit("\nTags: "), F.array_join(tags, ", "), F.lit("\n"))


def write_records(records: DataFrame, path: str, files: int | None = None) -> None:
    """records: block (from record_block). Every file states the number of its blocks in its first line. Null blocks are empty ones; no rows give no file with a count.

    Blocks are dealt to files (unless told, as many as shuffle partitions, or more as the
    tables behind the records grow) by their hash and counted where they are written: one
    shuffle, and a sort by numbers. What comes before is shuffled in as many parts, so that
    no task holds more of a larger input.
    """
    spark, setting = records.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    parts = max(int(before), tasks(records))
    files = files or parts
    dealt = records.select(F.coalesce("block", F.lit("")).alias("block")).withColumns({"_part": F.pmod(F.xxhash64("block"), F.lit(files)).cast("int"), "_id": F.monotonically_increasing_id()})
    by = Window.partitionBy("_part")
    placed = dealt.repartitionById(files, "_part").withColumns({"_n": F.count("*").over(by), "_place": F.row_number().over(by.orderBy("_id"))})
    value = F.when(F.col("_place") == 1, F.concat(F.lit("Ads collected: "), F.col("_n").cast("string"), F.lit("\n### "), F.col("block"))).otherwise(F.col("block"))
    spark.conf.set(setting, str(parts))
    try:
        placed.select(value.alias("value")).write.option("lineSep", "\n### ").text(path)
    finally:
        spark.conf.set(setting, before)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; a line that does not fit it fails the read. Fields that are missing are null; blank lines give no row; repeated lines are repeated rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
