"""Documents and their chunks as two tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.chunking import chunk

#: Bytes of one Arrow batch that Spark hands to Python.
BATCH_BYTES = 4 << 20
#: Bytes a core below which a table is dealt anew.
SMALL = 4 << 20
#: Bytes of the files behind a table for each task that its rows are dealt to.
TASK = 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold one Arrow batch to BATCH_BYTES, however long its texts are; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?[0-9]+) *([a-z]*)", str(spark.conf.get(key)).lower()).groups()
    if not 0 < int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[unit] <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def spread(df: DataFrame) -> DataFrame:
    """A table over all cores: one so small that its files are read in fewer tasks is dealt anew, any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def tasks(df: DataFrame, each: int = 1) -> int:
    """How many tasks to deal rows of this plan to, so that one's share does not grow with the input: each (more where rows become many) for TASK bytes of the files that it reads, one a core at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # Spark takes rows of the driver as without end
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-known * each // TASK))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one, as in tests, gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """A folder in the shared one for what this application writes on the way; it goes when the driver ends."""
    top = f"{shared_folder(spark)}/quern-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return top


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table of this application: computed once, and of a size that Spark knows when it plans a join."""
    path = f"{session_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_documents(docs: DataFrame, key: str, text: str, before: str, title: str, path: str, mode: str = "errorifexists") -> None:
    """docs without their text as path/documents, and path/chunks: key, chunk and metadata (pos, title, n_chars), cut as chunk() cuts.

    Rows with a null text are documents without chunks; repeated rows are
    repeated in both tables.
    """
    docs.drop(text).write.mode(mode).parquet(f"{path}/documents")
    chunks = chunk(docs, key, text, before, title)
    chunks.select(key, "chunk", F.struct("pos", "title", "n_chars").alias("metadata")).write.mode(mode).parquet(f"{path}/chunks")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents and the chunks."""
    return spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/chunks")


def create_store(docs: DataFrame, key: str, text: str, name: str, path: str, parts: int = 16, buckets: int = 16) -> None:
    """Empty tables <name>_documents (docs without their text) and <name>_chunks (key, chunk, metadata) for upsert(), unless they are there.

    A key's rows are in the part and in the bucket that its hash names, in both
    tables: so an upsert writes whole parts, and a join on the key shuffles nothing.
    """
    spark = docs.sparkSession
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    kind = docs.schema[key].dataType.simpleString()
    for table, own in (("documents", columns), ("chunks", f"`{key}` {kind}, chunk string, metadata struct<pos:int,title:string,n_chars:int>")):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{table} ({own}, part int) USING parquet PARTITIONED BY (part) CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}/{table}' TBLPROPERTIES ('parts' = '{parts}')")


def upsert(docs: DataFrame, key: str, text: str, before: str, title: str, name: str) -> None:
    """Puts documents and their chunks in the tables of create_store(), in place of what these hold of the same keys.

    A second run with the same documents changes nothing. Parts that hold a new
    key are written anew with what they keep (dynamic partition overwrite, visible
    once committed); others are not read. Null keys go; of rows that repeat a key
    the one with the greatest text stays; a null text has no chunks, and takes
    away those that were there. Each table is committed by itself: where a run
    ends between them, the next one mends it.
    """
    spark = docs.sparkSession
    parts = int({r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}_documents").collect()}["parts"])
    best = Window.partitionBy(key).orderBy(F.desc_nulls_last(text), *[F.col(c) for c in docs.columns if c not in (key, text)])
    new = docs.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    new = new.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    keys = docs.select(key).where(F.col(key).isNotNull())  # what is new is told by keys alone: texts are not shuffled for it
    touched = [r[0] for r in keys.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).distinct().collect()]  # at most `parts` numbers
    chunks = chunk(new, key, text, before, title).select(key, "chunk", F.struct("pos", "title", "n_chars").alias("metadata")).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    setting = "spark.sql.sources.partitionOverwriteMode"
    kept = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        for table, rows in (("documents", new.drop(text)), ("chunks", chunks)):
            held = spark.table(f"{name}_{table}")
            stays = held.where(F.col("part").isin(touched)).join(keys, key, "left_anti")
            # one task a part and bucket, as the files are cut
            stays.select(held.columns).unionByName(rows.select(held.columns)).repartition("part", key).write.mode("overwrite").insertInto(f"{name}_{table}")
    finally:
        spark.conf.set(setting, kept)


def stored(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """The documents and the chunks of create_store()."""
    return spark.table(f"{name}_documents").drop("part"), spark.table(f"{name}_chunks").drop("part")
