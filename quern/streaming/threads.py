"""Streams: windowed counts with a watermark, and keyed thread state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """window_start, keys, n: append-mode counts; rows later than the watermark are dropped, windows close when it has passed them."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


class ThreadState(StatefulProcessor):
    """Counts a key's rows and sums their values across batches; says the new totals after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, total = self.totals.get() if self.totals.exists() else (0, 0.0)
        for part in rows:
            n, total = n + len(part), total + float(part["value"].fillna(0).sum())
        self.totals.update((n, total))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def thread_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total in update mode: kept per key in the state store. Needs the RocksDB state store."""
    rows = stream.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(ThreadState(), "key long, n long, total double", "Update", "None")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet, then reads the result."""
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        # each batch is a folder of its own, overwritten if the batch is run again
        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
