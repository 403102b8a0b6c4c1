"""Collections of JSON-lines files, with a row id made of the file's name and the line's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import record_id

_COMMON = "source string, board_id string, doc_no string, standard_title string, src_file string, crawled_at string, record_type string, standard_no string, standard_name string, ref_key string"
#: Records of all types as one wide row; absent keys are null.
RECORD = (
    _COMMON + ", para_no string, series string, section string, text string, section_key string, term string, standard string, page_no int, "
    "post_id string, title string, reply_date string, question string, answer string, standard_refs array<string>, attachments array<string>, qa_source string, url string, body string, "
    "case_id string, facts string, violation string, basis string, audit_gap string, implication string, source_url string, standard_superseded boolean, fiscal_year string"
)
GOLDEN = "id string, question string, term string, expected_collections array<string>, expected_ref_keys array<string>, expected_gist string, doc_no string, board string"
RETRIEVAL = "id string, board string, expected array<string>, hits array<struct<ref_key:string,section_key:string>>"
TRACE = (
    "question string, rewritten string, route struct<collections:array<string>,qtype:string>, retrieved_refs array<string>, audit_cases array<struct<case_id:string,score:double>>, answer string, "
    "used_refs array<string>, trace array<struct<node:string,latency_ms:bigint,json_ok:boolean>>, "
    "eval struct<faithfulness:double,unsupported:array<string>,answer_relevancy:double,relevancy_reason:string,judge_vendor:string,judge_model:string>"
)


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, lineno, value): lines counted from 0 in each file, blank ones too, in parallel over the splits of large files.

    Each split counts its lines; a prefix sum over the few splits of a file gives every split its first number.
    """
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("m")
    )
    splits = lines.groupBy("path", "split").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(splits, ["path", "split"]).select("file", (F.col("before") + F.col("m") - F.col("first")).alias("lineno"), "value")


def read_collections(spark: SparkSession, root: str, files: dict[str, list[str]], schema: str = RECORD) -> DataFrame:
    """Records of the named collections with collection, id (file:line) and lineno; missing files are skipped, blank lines too.

    Line numbers count all lines. A line that is no JSON object becomes a row of nulls with its id, in column _corrupt true.
    """
    where = {f: c for c, names in files.items() for f in names}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    have = [f for f in where if (p := hadoop(f"{root}/{f}")).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)]
    if not have:
        return spark.createDataFrame([], f"collection string, id string, file string, lineno long, _corrupt boolean, {schema}")
    lines = numbered_lines(spark, *(f"{root}/{f}" for f in have)).where(F.trim("value") != "")
    coll = F.element_at(F.create_map(*(F.lit(x) for kv in where.items() for x in kv)), F.col("file"))
    rows = lines.select(coll.alias("collection"), record_id(F.col("file"), F.col("lineno")).alias("id"), "file", "lineno", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.select("collection", "id", "file", "lineno", F.col("r._bad").isNotNull().alias("_corrupt"), *(F.col(f"r.{x.name}") for x in rows.schema["r"].dataType.fields if x.name != "_bad"))


def write_collections(records: DataFrame, path: str, mode: str = "append") -> None:
    """Records as JSON lines, a folder per collection."""
    records.write.mode(mode).partitionBy("collection").json(path)


def rebuild_collections(records: DataFrame, path: str) -> None:
    """Parquet folders of the collections among the records are replaced, other collections stay."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def dead_letters(failures: DataFrame, path: str) -> None:
    """Tab-separated ts, board, seq, stage, err, appended."""
    failures.select("ts", "board", "seq", "stage", "err").write.mode("append").option("sep", "\t").csv(path)
