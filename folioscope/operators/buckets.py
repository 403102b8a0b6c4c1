"""Tables kept in buckets of their key, so that a load reads and rewrites only the buckets that its rows fall into."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import attach_eval, upsert
from .shared import saved

BUCKET = "bucket_"


@dataclass(frozen=True)
class BucketTable:
    """Parquet below `path`/rows, a partition folder a bucket; key, number of buckets and schema are kept in `path`/about.

    A load replaces the folders of its buckets when all its files are written, folder by folder: one writer at a time, and a load
    that was cut short is repeated, which gives the same rows. Null keys are one key. Choose the number of buckets so that a bucket is
    some files of the size that reads like (a load's cost is that of the buckets it touches); it cannot change later.
    """

    path: str
    key: str
    buckets: int
    schema: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 256) -> BucketTable:
        """An empty table; an error where there is one already."""
        made = cls(path, key, buckets, schema)
        spark.createDataFrame([(key, buckets, schema)], "key string, buckets int, schema string").coalesce(1).write.mode("error").json(f"{path}/about")
        spark.createDataFrame([], f"{schema}, {BUCKET} int").write.partitionBy(BUCKET).parquet(f"{path}/rows")
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BucketTable:
        about = spark.read.schema("key string, buckets int, schema string").json(f"{path}/about").first()
        return cls(path, about.key, about.buckets, about.schema)

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of the given buckets; other buckets' folders are not opened."""
        rows = spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(f"{self.path}/rows")
        return (rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def rows_of(self, spark: SparkSession, keys: list) -> DataFrame:
        """The rows of some keys, which the driver knows: a look-up opens at most a bucket a key."""
        typed = spark.createDataFrame([(k,) for k in keys], self.read(spark).select(self.key).schema)
        wanted = [r[0] for r in typed.select(self.bucket()).distinct().collect()]
        return self.read(spark, wanted).where(F.col(self.key).isin(keys))

    def rewrite(self, load: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets of the load's keys by change(their rows, the load) and returns them.

        At most a number a bucket reaches the driver. Large buckets are written by several tasks, small ones share a task.
        """
        spark = load.sparkSession
        new = saved(load)
        touched = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())
        if touched:
            out = change(self.read(spark, touched), new).select(*self.read(spark).columns).withColumn(BUCKET, self.bucket())
            out.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")
        return touched


def upsert_into(table: BucketTable, rows: DataFrame, version: str = "version") -> list[int]:
    """Rows into the table by the rules of records.upsert; the buckets that were written again."""
    return table.rewrite(rows, lambda old, new: upsert(old, new, table.key, version))


#: Columns that a table of traces has at least; eval_batch is the batch that gave the evaluation, -1 for one that came with the row.
TRACES = "seq long, question string, eval string, eval_batch long"


def attach_evals(traces: BucketTable, evals: DataFrame, batch: int) -> list[int]:
    """A numbered batch of evaluations into a table of traces in buckets of the question, by the rules of records.attach_eval.

    What the same batch attached before is taken back first, so a batch that runs twice, or that was cut short, attaches once.
    """

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        mine = F.coalesce(F.col("eval_batch") == batch, F.lit(False))
        before = old.withColumn("eval", F.when(~mine, F.col("eval"))).withColumn("eval_batch", F.when(F.col("eval").isNotNull(), F.coalesce("eval_batch", F.lit(-1))))
        return attach_eval(before, new).withColumn("eval_batch", F.when(F.col("eval").isNotNull(), F.coalesce("eval_batch", F.lit(batch))))

    return traces.rewrite(evals, change)
