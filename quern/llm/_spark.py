"""What the operators share on the Spark side: reading, written tables, small columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import BATCH_BYTES, session_folder, small_batches, spread  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; one that is small over all cores, as each text takes long."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, for as long as the driver runs."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Lets Spark delete a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here, nothing is computed twice, and shuffle files go once the table stands."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made; nothing may be read from it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def crc32_mod(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo by; of a null key, that of the empty text (0)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by
