"""A training corpus from `documents` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of their docs. run() writes
each stage's rows to the shared folder as Parquet and reads them again for the next one, so a lost executor costs one stage's
tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.base import documents, id_key, let_go, shared_folder
from folioscope.llm.decontam import clean
from folioscope.llm.minhash import near_duplicates, text_id
from folioscope.llm.mixing import mixed_documents
from folioscope.llm.quality import fit_quality, keep_quality
from folioscope.llm.tokens import token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of the labels, does not reject. Empty texts are scored too."""
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group linked by 5-word shingles; equal rows become one. Blank texts stay.

    Of near copies under one doc_id, or under none, one stays; texts under it that are no copies stay too. Of rows with equal doc_id and
    text, the least by all other columns in their order stays, nulls first (maps go by their JSON).
    """
    found = near_duplicates(docs).where("doc_key = component")
    group = found.groupBy("doc_key", "text_group", F.when(F.col("text_group").isNull(), F.col("text_id")))
    kept = group.agg(F.min("text_id").alias("text__")).select(F.col("doc_key").alias("key__"), "text__")
    keyed = docs.withColumn("key__", id_key()).withColumn("text__", text_id())
    keyed = keyed.withColumn("null__", F.col("text").isNull()).join(kept, ["key__", "text__"], "left_semi")
    plain = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema if f.name != "text"]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return keyed.groupBy("key__", "text__", "null__").agg(F.min_by(row, F.struct(*plain)).alias("row__")).select("row__.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one document of a source may be cut to reach the source's target."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: A classifier and a tokenizer are not SQL.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Through Spark's own file system, so that any shared store will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`.

    The rows of a stage are deleted when those of the next one are written, its shuffle files when its own are. The last stage writes its files before it returns and
    reads nothing else afterwards.
    """
    docs, folder, before = documents(spark, sf_dir), shared_folder(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            _delete(spark, before)
        before = at
        let_go(spark)
    out = STAGES[-1][1](spark, docs, sf_dir)
    _delete(spark, folder)
    return out
