"""Conversations, traces and arriving records as Structured Streaming."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.buckets import BucketTable, attach_evals
from ..operators.records import attach_eval

HISTORY = "thread string, seq long, role string, content string, history array<struct<role:string,content:string>>"
HELD = "held"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _History(StatefulProcessor):
    """A thread's last messages as list state, which may expire, and a timer that forgets a thread that has gone quiet."""

    def __init__(self, n: int, keep_ms: int | None, quiet_ms: int | None) -> None:
        self.n, self.keep_ms, self.quiet_ms = n, keep_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState(HELD, "role string, content string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        due = list(self.handle.listTimers()) if self.quiet_ms is not None else []
        held = deque([] if any(t <= now for t in due) else map(tuple, self.held.get()), self.n)
        for m in sorted(rows, key=lambda m: (m.seq, m.role or "", m.content or "")):
            yield Row(thread=key[0], seq=m.seq, role=m.role, content=m.content, history=[Row(role=r, content=c) for r, c in held])
            held.append((m.role, m.content))
        if held:
            self.held.put(list(held))
        if self.quiet_ms is not None:
            for t in due:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        return iter(())


def thread_history(messages: DataFrame, n: int = 6, keep_ms: int | None = None, quiet_ms: int | None = None) -> DataFrame:
    """Each arriving message (thread, seq, role, content) with the last n of its thread before it, kept as list state per thread.

    Inside a batch messages go by seq, equal ones by role and content; a message that arrives in a later batch comes after those
    already seen. A message is forgotten `keep_ms` after its batch or the last later one of its thread, a whole thread when nothing has
    come for `quiet_ms`, both by processing time; by default nothing is. State is kept in RocksDB, which is set for the session. A
    thread's messages of one batch are sorted in memory: bound batches at the source (maxFilesPerTrigger). With a limit, Spark looks for
    due timers in batches without data too, so an AvailableNow run ends only where spark.sql.streaming.noDataMicroBatches.enabled is
    false; timers then go off with the next batch.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return messages.groupBy("thread").transformWithState(_History(n, keep_ms, quiet_ms), HISTORY, "Append", "None" if keep_ms is None and quiet_ms is None else "ProcessingTime")


def held_messages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """thread, role, content of what a stream of thread_history holds, in the order of its state, read from its checkpoint."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", HELD).load()
    message = "list_element.value" if "value" in rows.schema["list_element"].dataType.names else "list_element"  # with an expiry or without
    return rows.select("key.thread", f"{message}.role", f"{message}.content")


def new_records(records: DataFrame, key: str = "id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first record of each id; ids are remembered for `late`."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_trace(traces: DataFrame, path: str, checkpoint: str, answer_chars: int = 300):
    """Starts a stream that appends trace rows, answers clipped, as JSON lines."""
    clipped = traces.withColumn("answer", F.substring("answer", 1, answer_chars))
    return clipped.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def merge_evals(evals: DataFrame, trace_path: str, checkpoint: str):
    """Starts a stream that attaches arriving evaluations to the trace table; each batch writes a new version of the table.

    The trace table is `trace_path`/v=<batch>; a batch that runs twice writes the same version twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = spark.read.parquet(trace_path).where(F.col("v") < number + 1)
        newest = last.agg(F.max("v")).first()[0]
        attach_eval(last.where(F.col("v") == newest).drop("v"), batch).write.mode("overwrite").parquet(f"{trace_path}/v={number + 1}")

    return evals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_evals_in_buckets(evals: DataFrame, traces: BucketTable, checkpoint: str):
    """The same over a table of traces in buckets of the question: a batch reads and rewrites only the buckets of its questions.

    A batch that runs twice attaches once. One stream writes to a table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        attach_evals(traces, batch, number)

    return evals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
