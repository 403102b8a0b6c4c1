"""Retrieval metrics at k and their means per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import bound, standard_of
from .joins import key_parts


def without_own(ranked: DataFrame) -> DataFrame:
    """Hits from a query's own document (doc_no = own_doc) go before ranks are cut; ranks close up."""
    kept = ranked.where(~F.coalesce(F.col("doc_no") == F.col("own_doc"), F.lit(False)))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def got(ranked: DataFrame) -> DataFrame:
    """(qid, got): the ref_keys and section_keys of each query's hits with their ranks, gathered by one shuffle; a key may repeat."""
    keys = F.filter(F.array("ref_key", "section_key"), lambda x: F.coalesce(x, F.lit("")) != "")
    rows = ranked.select("qid", F.struct("rank", keys.alias("keys")).alias("hit")).groupBy("qid").agg(F.collect_list("hit").alias("hits"))
    flat = F.flatten(F.transform("hits", lambda h: F.transform(h["keys"], lambda x: F.struct(x.alias("key"), h["rank"].alias("rank")))))
    return rows.select("qid", flat.alias("got"))


# A paragraph's place: standard or chapter, prefix, number without leading zeros, tail. Neighbours differ in the number alone.
_LINE = r"[\D&&[^\n\r\u0085\u2028\u2029]]"
_PLACE = r"(?U)^(제[0-9]+[호장])(?s:.*?)문단 (.*?)0*(\d+)(" + _LINE + r"*)(?:\r\n|[\n\r\u0085\u2028\u2029])?$"


def place(key: Column) -> Column:
    """The place of a paragraph key as one string, by one search; null for other keys."""
    at = F.regexp_replace(key, _PLACE, "\u0001$1\u0001$2\u0001$3\u0001$4")
    return F.when(F.startswith(key, F.lit("제")) & F.contains(key, F.lit("문단 ")), bound(at, lambda x: F.when(F.startswith(x, F.lit("\u0001")), x)))


def beside(key: Column) -> Column:
    """The places next to a paragraph key's; none for other keys."""
    some = lambda p: (p["ho"] != "") & p["n"].isNotNull()
    at = lambda p, n: F.concat(F.lit("\u0001"), p["ho"], F.lit("\u0001"), p["prefix"], F.lit("\u0001"), n.cast("string"), F.lit("\u0001"), p["tail"])
    return bound(key_parts(key), lambda p: F.when(some(p), F.array(at(p, p["n"] - 1), at(p, p["n"] + 1))).otherwise(F.array().cast("array<string>")))


def parsed(keys: Column, normal=lambda x: x) -> Column:
    """Keys with the form in which they are compared, their standard, their place among paragraphs, and what they are made of."""
    return F.transform(keys, lambda k: F.struct(normal(k).alias("key"), standard_of(k).alias("of"), place(k).alias("at"), k.alias("whole")))


def scores(expected: Column, have: Column, k: int | Column) -> Column:
    """struct of exact, capped, relaxed, ho, hit, precision (doubles) and nhit; all 0 without expected keys.

    expected and have are arrays from :func:`parsed`, k is how many hits were asked for.
    """

    def measured(x: Column) -> Column:
        exp, got_ = x["exp"], x["got"]
        keys, places = F.transform(got_, lambda g: g["key"]), F.transform(got_, lambda g: g["at"])
        found = lambda e: F.array_contains(keys, e["key"])
        near = F.filter(exp, lambda e: ~found(e) & F.arrays_overlap(beside(e["whole"]), F.filter(places, lambda y: y.isNotNull())))
        ho = lambda a: F.array_distinct(F.filter(F.transform(a, lambda y: y["of"]), lambda y: y.isNotNull()))
        return F.struct(
            F.size(exp).alias("n"), F.size(F.filter(exp, found)).alias("nhit"), F.size(near).alias("near"),
            F.size(F.array_intersect(ho(exp), ho(got_))).alias("ho"), F.size(ho(exp)).alias("of"),
        )

    share = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(F.lit(0.0))
    size = F.lit(k) if isinstance(k, int) else k

    def rated(m: Column) -> Column:
        return F.struct(
            share(m["nhit"], m["n"]).alias("exact"),
            share(m["nhit"], F.least(m["n"], size)).alias("capped"),
            share(m["nhit"] + F.lit(0.5) * m["near"], m["n"]).alias("relaxed"),
            share(m["ho"], m["of"]).alias("ho"),
            F.when(m["nhit"] > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit"),
            (F.when(m["n"] > 0, m["nhit"]).otherwise(0) / size).alias("precision"),
            m["nhit"].cast("long").alias("nhit"),
        )

    return bound(bound(F.struct(expected.alias("exp"), have.alias("got")), measured), rated)


METRICS = ("exact", "capped", "relaxed", "ho", "hit", "precision")


def evaluate(goldens: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (5, 10), normal=lambda x: x) -> DataFrame:
    """One row per query and k with its metrics. goldens: qid, board, expected; ranked: qid, rank, ref_key, section_key.

    Hits are gathered and keys are taken apart once for all k. normal maps a key to the form in which keys are compared. Gathered hits
    are far larger than the rows that they are estimated from, so the join names its kind: they are never broadcast.
    """
    none = F.array().cast("array<string>")
    rows = goldens.join(got(ranked.where(F.col("rank") <= max(ks))).hint("merge"), "qid", "left").select(
        "qid", "board", parsed(F.coalesce("expected", none), normal).alias("exp"),
        F.coalesce(F.col("got.rank"), F.array().cast("array<int>")).alias("ranks"), parsed(F.coalesce(F.col("got.key"), none), normal).alias("have"),
    )
    each = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    kept = F.filter(F.col("have"), lambda x, i: F.get("ranks", i) <= F.col("k"))
    return each.select("qid", "board", "k", scores(F.col("exp"), kept, F.col("k")).alias("m")).select("qid", "board", "k", "m.*")


def refreshed(dump: DataFrame, goldens: DataFrame) -> DataFrame:
    """A retrieval dump with the expected keys of today's goldens (qid, expected; of one qid the last by `at`, if there is such a
    column); queries without a golden go. Its hits are evaluated again as they are."""
    order = F.col("at") if "at" in goldens.columns else F.lit(0)
    latest = goldens.groupBy("qid").agg(F.max_by("expected", order).alias("expected"))
    return dump.drop("expected").join(latest, "qid")


def rounded(x: Column, digits: int) -> Column:
    """To decimals by the exact binary value, ties to even; round() goes by the shortest decimal form, ties up."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double")


def summarize(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Means per k and board and over all boards (ALL), by one pass over grouping sets."""
    means = [rounded(F.avg(m), digits).alias(m) for m in METRICS]
    r = rows.rollup("k", "board").agg(F.count("*").alias("n"), *means, F.grouping_id().alias("g"))
    return r.where("g < 3").select("k", F.when(F.col("g") == 1, F.lit("ALL")).otherwise(F.col("board")).alias("scope"), "n", *METRICS)
