"""Drains an inbox by keyed state: what is claimed, what was parsed, and what has to be done again.

Records name a file with its time and size. State holds, for each file, the last snapshot that was parsed and the claim
that is open. A claim goes out to be parsed; what comes back is an outcome: the snapshot that was parsed and the one that
the file has after it. Where these differ the file is claimed anew; where no outcome comes within ``lease`` (a worker
was lost) a timer claims it again. State and timers are the stream's own, so they outlive a restart.

Defined results: of records of one file in a batch the newest counts. A record of the snapshot that was parsed last, or
is claimed, makes nothing. An outcome that fits no open claim is ignored: it is a second one, or of a lease that ran out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from threadloom.functions import text as T
from threadloom.runtime import keep_state_in_rocksdb, share_code
from threadloom.store import Store

_S, _L = StringType(), LongType()
#: A record has time and size; an outcome these after the parse, and ``parsed_`` ones.
MESSAGE = StructType([StructField("source", _S), StructField("path", _S), StructField("mtime", _L), StructField("size", _L), StructField("parsed_mtime", _L), StructField("parsed_size", _L)])
CLAIM = StructType([StructField("key", _S), StructField("source", _S), StructField("path", _S), StructField("mtime", _L), StructField("size", _L), StructField("attempt", IntegerType()), StructField("action", _S)])


class Claims(StatefulProcessor):
    """``action`` of a row that comes out: claim, again (it changed while it was parsed), retry (its lease ran out) or done."""

    def __init__(self, lease: float):
        self.lease = int(lease * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "mtime long, size long")
        self.open = handle.getValueState("open", "source string, path string, mtime long, size long, attempt int, newest_mtime long, newest_size long")

    def _claim(self, key: str, file: tuple, snap: tuple, attempt: int, action: str, now: int) -> tuple:
        self.open.update((*file, *snap, attempt, *snap))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.lease)
        return (key, *file, *snap, attempt, action)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, now, out = key[0], timerValues.getCurrentProcessingTimeInMs(), []
        whole = pd.concat(list(rows), ignore_index=True)
        is_outcome = whole["parsed_mtime"].notna()
        seen = whole[~is_outcome].sort_values(["mtime", "size"]).tail(1)
        for r in seen.itertuples():
            file, snap = (r.source, r.path), (int(r.mtime), int(r.size))
            if self.open.exists():
                o = self.open.get()
                self.open.update((*o[:5], *max(snap, (o[5], o[6]))))
            elif not self.done.exists() or tuple(self.done.get()) != snap:
                out.append(self._claim(name, file, snap, 1, "claim", now))
        for r in whole[is_outcome].drop_duplicates().itertuples():
            parsed, after = (int(r.parsed_mtime), int(r.parsed_size)), (int(r.mtime), int(r.size))
            if not self.open.exists():
                continue
            o = self.open.get()
            if (o[2], o[3]) != parsed:
                continue
            newest = max(after, (o[5], o[6]))
            if newest != parsed:
                out.append(self._claim(name, (o[0], o[1]), newest, o[4] + 1, "again", now))
                continue
            self.done.update(parsed)
            self.open.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            out.append((name, o[0], o[1], *parsed, o[4], "done"))
        yield pd.DataFrame(out, columns=CLAIM.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            o = self.open.get()
            out.append(self._claim(key[0], (o[0], o[1]), (o[5], o[6]), o[4] + 1, "retry", timerValues.getCurrentProcessingTimeInMs()))
        yield pd.DataFrame(out, columns=CLAIM.names)

    def close(self) -> None:
        """Nothing is held outside the state."""


def claims(messages: DataFrame, lease: float = 600.0) -> DataFrame:
    """What is to be parsed, and what is done, of a stream of records and outcomes (``MESSAGE``)."""
    share_code(messages.sparkSession)
    keep_state_in_rocksdb(messages.sparkSession)
    keyed = messages.filter("path is not null").select(T.gen_id("hook", F.concat_ws(":", "source", "path")).alias("key"), *MESSAGE.names)
    return keyed.groupBy("key").transformWithStateInPandas(Claims(lease), CLAIM, "update", "ProcessingTime")


def messages(spark: SparkSession, inbox: str, files_per_trigger: int = 10_000) -> DataFrame:
    """An inbox folder, of records and outcomes, as a stream."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(inbox)


def drain(
    spark: SparkSession, inbox: str, store: Store, parse: Callable[[DataFrame], dict[str, DataFrame]], stat: Callable[[DataFrame], DataFrame], checkpoint: str,
    now: Callable[[], datetime] = datetime.now, lease: float = 600.0, once: bool = True,
) -> StreamingQuery:
    """Parses and ingests what is claimed, and writes the outcomes back to the inbox.

    ``stat`` takes claims and gives ``path`` with its ``mtime`` and ``size`` as they are then; it is asked after the parse.
    Outcomes of a run are read by the next trigger.
    """

    def batch(df: DataFrame, number: int) -> None:
        todo = df.filter("action <> 'done'").persist()
        try:
            if todo.isEmpty():
                return
            store.ingest(parse(todo), now())
            after = stat(todo).select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
            out = todo.join(after, "path").select("source", "path", F.col("_m").alias("mtime"), F.col("_s").alias("size"), F.col("mtime").alias("parsed_mtime"), F.col("size").alias("parsed_size"))
            out.write.mode("append").json(inbox)
        finally:
            todo.unpersist()

    writer = claims(messages(spark, inbox), lease).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
