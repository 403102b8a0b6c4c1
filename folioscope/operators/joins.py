"""Joins between citations, paragraphs and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import PRECISE, bound, kind_of, split_label


def citation_hits(cited: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Adds kind, precise and hit to one row per citation (column ref).

    paragraphs: ref_key, section_key, standard_no, chapter_no (each may be null). Paragraph and term-section citations must equal
    a key; titles and bare standards or chapters need only a record of that number.
    """
    c = cited.withColumn("kind", kind_of(F.col("ref"))).withColumn("precise", F.col("kind").isin(*PRECISE))
    number = F.regexp_extract("ref", r"^제(\d+)[호장]", 1)
    c = c.withColumn(
        "probe",
        F.when(F.col("kind") == "문단", F.concat(F.lit("k:"), "ref"))
        .when(F.col("kind") == "장문단", F.concat(F.lit("k:"), "ref"))
        .when(F.col("kind") == "용어섹션", F.concat(F.lit("s:"), "ref"))
        .when(F.col("kind").isin("제목", "단독호"), F.concat(F.lit("n:"), number))
        .when(F.col("kind").isin("장제목", "단독장"), F.concat(F.lit("c:"), number)),
    )
    keys = F.filter(
        F.array(*(F.concat(F.lit(p), F.col(x)) for p, x in (("k:", "ref_key"), ("s:", "section_key"), ("n:", "standard_no"), ("c:", "chapter_no")))),
        lambda x: x.isNotNull(),
    )
    have = paragraphs.select(F.explode(keys).alias("probe")).distinct().withColumn("found", F.lit(True))
    return c.join(have, "probe", "left").withColumn("hit", F.coalesce("found", F.lit(False))).drop("probe", "found")


def join_report(hits: DataFrame) -> DataFrame:
    """(scope, n, hits): per kind, over precise kinds, and over all."""
    scopes = F.array(F.lit("all"), F.when(F.col("precise"), F.lit("precise")), F.col("kind"))
    each = hits.withColumn("scope", F.explode(F.filter(scopes, lambda s: s.isNotNull())))
    return each.groupBy("scope").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order; rows without a key are dropped."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def lookup(refs: DataFrame, records: DataFrame) -> DataFrame:
    """The record for each (rid, ref): collection by collection, there first by ref_key, then by doc_no, then in file order.

    refs: rid, ref; records: coll_pos, lineno, ref_key, doc_no and more. Refs without a record are dropped.
    """
    keyed = records.withColumn("keys_", F.array(F.struct(F.col("ref_key").alias("k"), F.lit(0).alias("field_pos")), F.struct(F.col("doc_no").alias("k"), F.lit(1).alias("field_pos"))))
    keyed = keyed.select("*", F.inline("keys_")).where("k is not null").drop("keys_")
    # of all records under one key only the first can win, so a key shared by very many is one row before the join
    firsts = keyed.withColumn("n_", F.row_number().over(Window.partitionBy("k", "coll_pos", "field_pos").orderBy("lineno"))).where("n_ = 1").drop("n_")
    w = Window.partitionBy("rid", "ref").orderBy("coll_pos", "field_pos", "lineno")
    return refs.join(firsts, refs["ref"] == firsts["k"]).withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_", "k")


def looked_up_in_order(answers: DataFrame, records: DataFrame) -> DataFrame:
    """(rid, verified): for each answer's used_refs, in their order, the texts of the records found; misses are dropped."""
    each = answers.select("rid", F.posexplode("used_refs").alias("pos", "ref"))
    found = lookup(each.select("rid", "ref").distinct(), records).select("rid", "ref", "text")
    got = each.join(found, ["rid", "ref"]).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "text"))).alias("v"))
    verified = F.transform("v", lambda x: F.struct(x["ref"].alias("ref"), x["text"].alias("text")))
    return answers.select("rid").join(got, "rid", "left").select("rid", F.coalesce(verified, F.array().cast("array<struct<ref:string,text:string>>")).alias("verified"))


def key_parts(key: Column) -> Column:
    ho = F.regexp_extract(key, r"^(제\d+[호장])", 1)
    return bound(bound(F.regexp_extract(key, r"문단 (.+)$", 1), split_label), lambda s: F.struct(ho.alias("ho"), s["prefix"].alias("prefix"), s["n"].alias("n"), s["tail"].alias("tail")))


#: Keys, before their neighbours are added, of a task that looks for repeated ones: some 100 bytes each in a hash map.
KEYS_A_TASK = 500_000


def with_neighbors(keys: DataFrame, corpus: DataFrame, most: int = KEYS_A_TASK) -> DataFrame:
    """(qid, ref_key): the keys of each query and those next to them (number one less or more) that the corpus has, each once.

    `keys` may repeat. They are counted first, as rows are dealt out at once, unsummed, to as many tasks as have about `most` keys each:
    Spark would deal more rows to a task, or sum most of them up in vain before, the larger the input is.
    """
    p = keys.where(F.col("ref_key").rlike("문단 ")).select("qid", key_parts(F.col("ref_key")).alias("p")).where("p.n is not null")
    near = p.select("qid", F.explode(F.array(F.col("p.n") - 1, F.col("p.n") + 1)).alias("n"), "p.ho", "p.prefix", "p.tail")
    near = near.select("qid", F.concat("ho", F.lit(" 문단 "), "prefix", F.col("n").cast("string"), "tail").alias("ref_key"))
    near = near.join(corpus.select("ref_key").distinct(), "ref_key", "left_semi")
    tasks = max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // most))
    return keys.select("qid", "ref_key").unionByName(near.select("qid", "ref_key")).repartition(tasks, "qid", "ref_key").distinct()


def next_to(x: Column, y: Column) -> Column:
    """Parts of two paragraph keys of one standard, prefix and tail whose numbers differ by one; false for other keys."""
    same = (x["ho"] == y["ho"]) & (x["prefix"] == y["prefix"]) & (x["tail"] == y["tail"])
    return F.coalesce((x["ho"] != "") & same & (F.abs(x["n"] - y["n"]) == 1), F.lit(False))


def adjacent(a: Column, b: Column) -> Column:
    return next_to(key_parts(a), key_parts(b))


def adjacent_pairs(keys: DataFrame) -> DataFrame:
    """(a, b): the distinct keys (ref_key) of which b is the next one after a, by an equality join."""
    c = keys.select("ref_key").distinct().select("ref_key", key_parts(F.col("ref_key")).alias("p")).where("p.n is not null")
    left = c.select(F.col("ref_key").alias("a"), "p.ho", "p.prefix", "p.tail", (F.col("p.n") + 1).alias("n"))
    right = c.select(F.col("ref_key").alias("b"), "p.ho", "p.prefix", "p.tail", "p.n")
    return left.join(right, ["ho", "prefix", "tail", "n"]).where("ho <> ''").select("a", "b")


def regression(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Rows that hit before and do not hit any more, by their place."""
    return before.where("hit").select(*keys).join(after.where("hit").select(*keys), list(keys), "left_anti")
