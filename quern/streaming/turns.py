"""Durable threads and sliding limits: keyed state with lists, timers and restarts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Turns of a thread that its state holds, unless told: what a follow-up may refer to.
REMEMBERED = 20
TURNS = "thread long, id long, kind string, turn long, previous string"


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that list state and timers need, for streams started within."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


class ThreadTurns(StatefulProcessor):
    """The last turns of a thread, or all of them, until it has been idle for too long."""

    def __init__(self, idle: int, remembered: int | None):
        self.idle, self.remembered = idle, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "at long, id long, said string")
        self.count = handle.getValueState("count", "n long, last long, id long, said string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given = sorted(t for part in rows for t in zip(_micros(part["ts"]), part["id"].tolist(), part["said"].tolist(), strict=True))
        n, last, id_, said = self.count.get() if self.count.exists() else (0, None, None, None)
        fresh, begun, out = [], not n, []
        for at, key_, words in given:
            if n and at - last >= self.idle:
                out.append((key[0], id_, "closed", n, said))
                n, fresh, begun = 0, [], True
            out.append((key[0], key_, "turn", n + 1, said if n else None))
            n, last, id_, said = n + 1, at, key_, words
            fresh.append((at, key_, words))
        if self.remembered is not None:
            self.turns.put(list(deque([*([] if begun else self.turns.get()), *fresh], self.remembered)))
        elif begun:
            self.turns.put(fresh)
        else:  # what the thread said before is not read again
            self.turns.appendList(fresh)
        self.count.update((n, last, id_, said))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.idle) // 1000)
        yield pd.DataFrame(out, columns=["thread", "id", "kind", "turn", "previous"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, _, id_, said = self.count.get()
        self.turns.clear()
        self.count.clear()
        yield pd.DataFrame([(key[0], id_, "closed", n, said)], columns=["thread", "id", "kind", "turn", "previous"])

    def close(self) -> None:
        pass


def follow_threads(stream: DataFrame, thread: str, key: str, ts: str, said: str, idle: int, late: str, remembered: int | None = REMEMBERED) -> DataFrame:
    """thread, id, kind, turn, previous: for each turn its number in its thread and what was said before it; for each thread that ended its last turn.

    A thread ends when nothing is said for `idle` seconds: at its next turn, which
    begins another, or by a timer once the watermark (`late` behind the newest
    row) has passed. State is a counter and a list of the last turns, which is
    bounded, or (remembered=None) of all turns of the thread that is open, to which a
    batch adds its own. It lives in the checkpoint: a stream that starts again from
    there goes on with the threads that were open. Rows with a null thread or time go.
    Equal times stand by id. Needs rocksdb().
    """
    rows = stream.where(F.col(thread).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(F.col(thread).cast("long").alias("thread"), F.col(key).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(F.col(said).cast("string"), F.lit("")).alias("said"))
    timed = rows.withWatermark("ts", late)
    return timed.groupBy("thread").transformWithStateInPandas(ThreadTurns(idle * 1_000_000, remembered), TURNS, "Append", "EventTime")


def open_threads(spark: SparkSession, checkpoint: str) -> DataFrame:
    """thread, at (microseconds), id, said: the turns that a stopped stream's checkpoint holds, read by Spark's state source."""
    with rocksdb(spark):
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "turns").load()
        return state.select(F.col("key.thread").alias("thread"), "list_element.at", "list_element.id", "list_element.said")


class SlidingLimit(StatefulProcessor):
    """How many requests a user made in each of the last seconds."""

    def __init__(self, seconds: int, limit: int):
        self.seconds, self.limit = seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked: dict[int, list[int]] = {}
        for part in rows:
            for at, id_ in zip(_micros(part["ts"]), part["id"].tolist(), strict=True):
                asked.setdefault(at // 1_000_000, []).append(id_)
        held = deque(sorted(self.recent.get()) if self.recent.exists() else [])
        total, out = sum(n for _, n in held), []
        for at, ids in sorted(asked.items()):
            while held and held[0][0] < at - self.seconds:
                total -= held.popleft()[1]
            total += len(ids)
            if held and held[-1][0] == at:  # a second that an earlier batch began
                held[-1] = (at, held[-1][1] + len(ids))
            else:
                held.append((at, len(ids)))
            out += [(i, total, total > self.limit) for i in ids]
        self.recent.put(list(held))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((held[-1][0] + self.seconds + 1) * 1000)
        yield pd.DataFrame(out, columns=["id", "n_recent", "limited"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(stream: DataFrame, user: str, key: str, ts: str, seconds: int, limit: int, late: str) -> DataFrame:
    """id, n_recent, limited: what threads.rolling says of each request, as it comes.

    State is one count for each second of the last `seconds` in which the user
    asked, and a timer clears it once the watermark has passed them. Requests of
    one second count each other as far as they came by then; rows later than the
    watermark and rows without a user or time go. Needs rocksdb().
    """
    rows = stream.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(F.col(user).cast("long").alias("user"), F.col(key).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.withWatermark("ts", late).groupBy("user").transformWithStateInPandas(SlidingLimit(seconds, limit), "id long, n_recent long, limited boolean", "Append", "EventTime")
