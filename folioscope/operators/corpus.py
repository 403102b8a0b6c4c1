"""Corpus building: conversion, standards to records, reparsing, embedding loads, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import only_new, upsert
from .split import assembled, split_documents

# The fields that an audit case keeps.
AUDIT_FIELDS = ("case_id", "title", "facts", "violation", "basis", "audit_gap", "implication", "standard", "source_url", "standard_superseded", "fiscal_year")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path that Spark can reach holds anything."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(p) and len(system.listStatus(p)) > 0


def ensure_corpus(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The corpus at a path; built and written first if the path is missing or empty."""
    if not exists(spark, path):
        build().write.mode("overwrite").partitionBy("collection").parquet(path)
    return spark.read.parquet(path)


def converted(rows: DataFrame, record_type: str = "audit_case", fields: tuple[str, ...] = AUDIT_FIELDS) -> DataFrame:
    """The known fields that the rows have, and their record type."""
    return rows.select(F.lit(record_type).alias("record_type"), *(f for f in fields if f in rows.columns))


def standard_records(docs: DataFrame) -> DataFrame:
    """Paragraph and term records of standards and chapters; documents whose title is neither give none.

    docs: doc_id, title, text and more. Standards give paragraphs and terms, chapters give paragraphs.
    """
    no, chapter = F.regexp_extract("title", r"제(\d{3,4})호\s*(.+)$", 1), F.regexp_extract("title", r"^제(\d{1,2})장\s*(.+)$", 1)
    std = docs.withColumn("number", no).where("number <> ''")
    ch = docs.withColumn("number", chapter).where("number <> ''")
    name = lambda unit: F.trim(F.regexp_extract("title", rf"제\d+{unit}\s*(.+)$", 1))
    parts = [
        split_documents(std, "standard").withColumn("record_type", F.lit("paragraph")).join(std.select("doc_id", F.col("number").alias("standard_no"), name("호").alias("standard_name")), "doc_id"),
        split_documents(std, "terms").withColumn("record_type", F.lit("term")).join(std.select("doc_id", F.col("number").alias("standard_no"), name("호").alias("standard_name")), "doc_id"),
        split_documents(ch, "chapter").withColumn("record_type", F.lit("paragraph")).join(ch.select("doc_id", F.concat(F.lit("제"), F.col("number").cast("int").cast("string"), F.lit("장")).alias("standard_no"), name("장").alias("standard_name")), "doc_id"),
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def reparsed(records: DataFrame, raw: DataFrame, target: Column) -> DataFrame:
    """Records with question, answer, related, qa_source and body taken anew from stored pages where `target` holds; others stay.

    records: id, question, answer, qa_source, body and more; raw: id, body, att_text, att_kind. A record that still cannot be split
    keeps the page's own text as its body.
    """
    todo = records.where(F.coalesce(target, F.lit(False))).select("id").join(raw, "id")
    pages = todo.select("id", F.col("body").alias("page"))
    new = assembled(todo).join(pages, "id").select("id", F.col("question").alias("q"), F.col("answer").alias("a"), F.col("qa_source").alias("s"), F.when(F.col("qa_source") == "body_fallback", F.col("page")).alias("b"), F.lit(True).alias("new"))
    out = records.join(new, "id", "left")
    pick = lambda old, fresh: F.when(F.col("new"), F.col(fresh)).otherwise(F.col(old)).alias(old)
    swap = {"question": "q", "answer": "a", "qa_source": "s", "body": "b"}
    return out.select(*(pick(c, swap[c]) if c in swap else c for c in records.columns))


def embedded(records: DataFrame, text: Column, embed: Callable[[Column], Column], existing: DataFrame | None = None) -> DataFrame:
    """New records with their vectors; blank texts are dropped, known ids are skipped whatever they say now."""
    rows = records.withColumn("embed_text", text).where(F.regexp_replace("embed_text", r"(?U)\s+", "") != "")
    if existing is not None:
        rows = only_new(rows, existing)
    return rows.withColumn("vec", embed(F.col("embed_text")))


def reembedded(existing: DataFrame, records: DataFrame, text: Column, embed: Callable[[Column], Column], record_type: str = "term") -> DataFrame:
    """The existing vectors with those of one record type made anew."""
    rows = embedded(records.where(F.col("record_type") == record_type), text, embed)
    last = existing.agg(F.coalesce(F.max("version"), F.lit(0)).alias("last"))
    return upsert(existing, rows.crossJoin(F.broadcast(last)).withColumn("version", F.col("last") + 1).drop("last").select(existing.columns))


def report(summary: DataFrame, title: str) -> tuple[str, str]:
    """(JSON, Markdown table) of a summary's few rows, in their order; every figure is measured."""
    rows = [r.asDict() for r in summary.collect()]
    head = summary.columns
    table = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows)]
    return json.dumps(rows, ensure_ascii=False, default=str), "\n".join(table) + "\n"
