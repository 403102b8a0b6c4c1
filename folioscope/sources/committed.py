"""A sink with a commit protocol: tasks write files, and only a load that came through makes its files count.

`path`/data holds Parquet files with random names, `path`/commits one list of files a load. A task attempt that fails or runs twice, or
an executor that is lost, leaves at most files that no list names. Lists are put in place by a rename. A load's name is its batch in
a stream, the option `load` otherwise (random where there is none); a load that is written again replaces its list, so nothing is doubled.

    spark.dataSource.register(CommittedSink)
    rows.write.format("committed").option("path", path).option("load", "2025-01-01").mode("append").save()
    stream.writeStream.format("committed").option("path", path).option("checkpointLocation", at).start()
    committed(spark, path, schema)
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: no file where it had no rows."""

    file: str | None
    rows: int


class _Files:
    """What batches and streams share: a task's file, the list of a load, and taking files back."""

    def __init__(self, options) -> None:
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        file, out, rows = f"data/{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(f"{root}/data")
                    out = pq.ParquetWriter(f"{root}/{file}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(f"{root}/{file}")
            raise
        return Written(file if rows else None, rows)

    def list_files(self, messages: list[Written | None], load: str) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{root}/commits")
        draft, final = f"{root}/commits/.{uuid.uuid4().hex}", f"{root}/commits/{load}.json"
        with system.open_output_stream(draft) as out:
            out.write("".join(json.dumps({"file": m.file, "rows": m.rows}) + "\n" for m in messages if m is not None and m.file).encode())
        system.move(draft, final)

    def take_back(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/{m.file}")


class _Batch(_Files, DataSourceArrowWriter):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.load = "load-" + re.sub(r"[^\w.=-]", lambda m: f"%{ord(m[0]):x}%", options.get("load") or uuid.uuid4().hex)

    def commit(self, messages) -> None:
        self.list_files(messages, self.load)

    def abort(self, messages) -> None:
        self.take_back(messages)


class _Stream(_Files, DataSourceStreamArrowWriter):
    """A batch that was committed and runs again, as after a restart, replaces its list."""

    def commit(self, messages, batchId) -> None:
        self.list_files(messages, f"batch-{batchId}")

    def abort(self, messages, batchId) -> None:
        self.take_back(messages)


class CommittedSink(DataSource):
    """Appends; for a new whole use another path."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a committed sink appends; write a load again under its name to replace it")
        return _Batch(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Stream(self.options)


def _named(spark: SparkSession, path: str) -> list[str]:
    """The files of all lists; the driver holds their names."""
    system, root = fs.FileSystem.from_uri(path)
    lists = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    lists = [f"{path}/commits/{x.base_name}" for x in lists if x.base_name.endswith(".json")]
    return [r.file for r in spark.read.schema("file string").json(lists).collect()] if lists else []


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed loads, read by Spark. No rows where nothing was committed."""
    path = path.rstrip("/")
    files = [f"{path}/{f}" for f in _named(spark, path)]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def sweep(spark: SparkSession, path: str, quiet_s: float = 86_400) -> int:
    """Deletes files that no list names and that nothing was written to for `quiet_s`, longer than any load runs; how many."""
    path, named = path.rstrip("/"), set(_named(spark, path.rstrip("/")))
    system, root = fs.FileSystem.from_uri(path)
    old = [x for x in system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if f"data/{x.base_name}" not in named and x.mtime.timestamp() <= time.time() - quiet_s]
    for x in old:
        system.delete_file(x.path)
    return len(old)
