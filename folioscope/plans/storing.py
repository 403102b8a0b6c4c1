"""Queries that write a table the way a load does and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buckets as B
from ..operators import stored as K
from ..operators.shared import shared_folder
from ..sources.committed import CommittedSink, committed
from ..streaming import conversations as C
from .records import incremental_anti, trace_eval_merge, upsert_latest
from .registry import ORACLE_SQL, query, table


@query(ORACLE_SQL[upsert_latest.__name__])
def bucketed_upsert(spark, d):
    """The latest version of each id, in a table of buckets after two loads."""
    o = table(spark, d, "orders").selectExpr("o_custkey as id", "o_orderkey as version", "o_totalprice as price")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in o.schema)
    t = B.BucketTable.create(spark, shared_folder(spark, "upserts"), "id", schema, 32)
    for rest in (0, 1):
        B.upsert_into(t, o.where(F.col("version") % 2 == rest))
    return t.read(spark)


@query(ORACLE_SQL[trace_eval_merge.__name__])
def trace_eval_stream(spark, d):
    """Evaluations that arrive as a stream, attached in the buckets of their questions."""
    question = F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("question")
    at = shared_folder(spark, "traces")
    traces = B.BucketTable.create(spark, f"{at}/table", "question", B.TRACES, 32)
    rows = table(spark, d, "events").select(F.col("event_id").cast("long").alias("seq"), question, F.when(F.col("event_id") % 4 == 0, "old").alias("eval"), F.lit(None).cast("long").alias("eval_batch"))
    traces.rewrite(rows, lambda old, new: new)
    each = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("new1"), F.lit("new2"))).otherwise(F.array(F.lit("new1")))
    table(spark, d, "events").where("user_id % 2 = 0").select(question, F.explode(each).alias("eval")).distinct().write.parquet(f"{at}/evals")
    C.merge_evals_in_buckets(spark.readStream.schema("question string, eval string").parquet(f"{at}/evals"), traces, f"{at}/state").awaitTermination()
    return traces.read(spark).drop("eval_batch")


_LETTERS = "board string, seq long, stage string, err string"


def _failures(pages):
    """A row for each rule that a page fails."""
    letters = F.array(F.when(~F.col("url").startswith("https://"), F.struct(F.lit("list").alias("stage"), F.lit("plain http").alias("err"))), F.when(~F.rtrim("html").endswith("</html>"), F.struct(F.lit("body").alias("stage"), F.lit("cut off").alias("err"))))
    return pages.select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("board"), F.col("page_id").cast("long").alias("seq"), F.inline(F.filter(letters, lambda x: x.isNotNull())))


_DEAD = """SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS board, page_id AS seq, 'list' AS stage, 'plain http' AS err FROM pages WHERE NOT starts_with(url, 'https://')
UNION ALL SELECT regexp_extract(url, '^https?://([^/]*)', 1), page_id, 'body', 'cut off' FROM pages WHERE NOT suffix(rtrim(html, ' '), '</html>')"""


@query(_DEAD)
def dead_letter_sink(spark, d):
    """Pages that fail a rule, through the sink with commits, and back."""
    spark.dataSource.register(CommittedSink)
    at = shared_folder(spark, "letters")
    _failures(table(spark, d, "pages")).write.format("committed").option("path", at).option("load", "all").mode("append").save()
    return committed(spark, at, _LETTERS)


@query(_DEAD)
def dead_letter_stream(spark, d):
    """The same from a stream of pages."""
    spark.dataSource.register(CommittedSink)
    at = shared_folder(spark, "letters")
    pages = spark.readStream.schema(table(spark, d, "pages").schema).parquet(f"{d}/pages.parque[t]")  # a pattern may be one file or a folder
    _failures(pages).writeStream.format("committed").option("path", f"{at}/sink").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return committed(spark, f"{at}/sink", _LETTERS)


def _stored(spark, rows):
    at = shared_folder(spark, "corpus")
    name = at.rsplit("/", 1)[1].replace("-", "_")
    K.store(rows, name, "doc_id", path=at)
    return name


@query(ORACLE_SQL[incremental_anti.__name__])
def stored_incremental(spark, d):
    """Documents that a stored table does not have, which stays in its buckets."""
    return K.load_new(table(spark, d, "documents").select("doc_id", "lang"), _stored(spark, table(spark, d, "labels")), "doc_id")


@query("SELECT l.doc_id, l.quality, d.lang, length(d.text) AS chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def stored_gather(spark, d):
    """Stored documents by id, which stay in their buckets."""
    name = _stored(spark, table(spark, d, "documents").select("doc_id", "lang", "text"))
    return K.gather(table(spark, d, "labels").select("doc_id", "quality"), name, "doc_id").select("doc_id", "quality", "lang", F.length("text").cast("long").alias("chars"))
