"""Table functions that take tables: rows of a thread in order, with state from row to row."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Exchanges:
    """exchanges(TABLE(messages), thread, seq, role, content): a row per exchange, which is a run of messages by `user` and all by
    `assistant` up to the next one by `user`.

    The last four arguments name columns. The thread's column keeps its name and type, the first message's place that of `seq`; question
    and answer are texts joined by line ends, null where nobody spoke; messages counts both. Other roles are left out, null texts are
    empty. The function asks Spark for threads apart and in order itself, so a call says neither PARTITION BY nor ORDER BY; messages of
    one place are ordered arbitrarily. An exchange is given out when the next one begins: a long thread is never held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, thread: AnalyzeArgument, seq: AnalyzeArgument, role: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("exchanges: the first argument is TABLE(...)")
        types = {f.name: f.dataType for f in rows.dataType.fields}
        for arg in (thread, seq, role, content):
            if not arg.isConstantExpression or arg.value not in types:
                raise ValueError(f"exchanges: {arg.value!r} is not a column of the table, which has {', '.join(types)}")
        schema = StructType([StructField(c.value, types[c.value]) for c in (thread, seq)])
        schema = schema.add("question", StringType()).add("answer", StringType()).add("messages", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{thread.value}`")], orderBy=[OrderingColumn(f"`{seq.value}`")])

    def __init__(self) -> None:
        self.open: tuple | None = None

    def _closed(self):
        if self.open:
            thread, seq, user, assistant = self.open
            yield thread, seq, *("\n".join(t) if t else None for t in (user, assistant)), len(user) + len(assistant)
        self.open = None

    def eval(self, row, thread: str, seq: str, role: str, content: str):
        if row[role] not in ("user", "assistant"):
            return
        if row[role] == "user" and self.open and self.open[3]:
            yield from self._closed()
        if self.open is None:
            self.open = (row[thread], row[seq], [], [])
        self.open[2 if row[role] == "user" else 3].append(row[content] or "")

    def terminate(self):
        yield from self._closed()


def register(spark: SparkSession) -> None:
    """The function for SQL."""
    spark.udtf.register("exchanges", F.udtf(Exchanges))
