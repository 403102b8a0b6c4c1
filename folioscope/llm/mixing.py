"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WORD, documents, saved

EPOCHS, SEED = 3, 17


def source_key(source: Column) -> Column:
    """Sorts as the source does by code point, null last, and is never null."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def fill(sources: DataFrame, epochs: int) -> DataFrame:
    """Adds target to one row per source (src, weight, source_size long, no nulls).

    The budget is the sum of all sizes. The level L solves sum(min(epochs * size, L * weight)) = budget; a source is clamped if
    its cap is reached at or below that level. Sorted by cap / weight, the clamped ones come first, so a prefix sum of caps and
    a suffix sum of weights decide each source; comparisons are in exact decimals. There are few sources: they are one window.
    """
    wide = "decimal(38,0)"
    s = sources.select("src", "weight", "source_size", (F.col("source_size") * epochs).cast(wide).alias("cap"), F.col("weight").cast(wide).alias("w"))
    order = [(F.col("cap").cast("double") / F.col("weight")).asc(), F.col("src").asc()]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast(wide)
    s = s.select(
        "*",
        F.sum("cap").over(upto).cast(wide).alias("caps"),
        F.coalesce(F.sum("w").over(after), zero).cast(wide).alias("free"),
        F.sum(F.col("source_size").cast(wide)).over(every).cast(wide).alias("budget"),
    )
    # the level at which this source is just clamped needs caps + cap / w * free words in all
    s = s.withColumn("clamped", F.col("caps") * F.col("w") + F.col("cap") * F.col("free") <= F.col("budget") * F.col("w"))
    s = s.withColumn("used", F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(every), zero))
    s = s.withColumn("weights", F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("w"))).over(every), zero))
    share = (F.col("budget") - F.col("used")).cast("double") / F.col("weights").cast("double") * F.col("weight").cast("double")
    return s.select("src", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def take(docs: DataFrame, size: Column, epochs: int = EPOCHS, seed: int = SEED, weights: tuple[int, ...] = (1, 2, 3), tie: Column | None = None) -> DataFrame:
    """The rows of `docs` (doc_id, source and what `size` needs; more are kept) with size, source_size, target and taken.

    Sources by code point (null last) weigh `weights`, repeating. Every document is taken floor(target / source_size) times in
    whole; the rest of the target goes to documents in the order of a seeded hash of their id, each once in whole, until one
    document at the boundary is taken in part, so that each source takes its target to the word. Documents of size 0 take 0.
    Columns of `docs` that have a name of a result are replaced, all others stay. Equal doc_ids are ordered by size, then by `tie`; rows
    equal in these are interchangeable. An empty table gives no rows.

    The order inside a source is found by 4096 hash ranges: sums per range, a prefix sum over them, and a running sum inside each
    range, so a source that holds most rows is never sorted or gathered in one task, and rows are shuffled once.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    own = {f"c{i}_": c for i, c in enumerate(docs.columns)}  # so that no name clashes with a helper's
    doc_id = next(k for k, c in own.items() if c == "doc_id")
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in own.items()), F.coalesce(size, F.lit(0)).cast("long").alias("size"), source_key(F.col("source")).alias("src_"), h.alias("h_"), *([] if tie is None else [tie.alias("tie_")]))
    rows = rows.withColumn("range_", F.substring("h_", 1, 3))
    ranges = saved(rows.groupBy("src_", "range_").agg(F.sum("size").alias("words")))
    sizes = ranges.groupBy(F.col("src_").alias("src")).agg(F.sum("words").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("src")) - 1) % len(weights) + 1
    filled = fill(sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)), epochs)
    goal = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("rest", (goal - F.col("whole") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("src_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(filled, F.col("src_") == F.col("src")).drop("src")
    inside = Window.partitionBy("src_", "range_").orderBy("h_", doc_id, "size", *([] if tie is None else ["tie_"])).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(ranges, ["src_", "range_"]).withColumn("first", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("first")))
    both = joined.withColumn("taken", F.col("whole") * F.col("size") + extra)
    results = ("size", "source_size", "target", "taken")
    return both.select(*(F.col(k).alias(c) for k, c in own.items() if c.lower() not in results), *results)


def cut(text: Column, words: Column) -> Column:
    """The text up to the end of its word number `words`, white space inside unchanged."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), (words + lead).cast("int")), ""), r"[\x20\x09-\x0D]+\z", "")


def mixed_documents(docs: DataFrame, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of `docs` (doc_id, source, text and others): a row per whole repetition of a document, and
    the one cut document of a source with its first words (n_chars follows, where there is one). Documents without words go."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")}
    plain = docs.select("doc_id", "source", "text", *(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    every = F.md5(F.to_json(F.struct(*plain.columns)).cast("binary"))  # so that reruns cut the same one of rows under one doc_id
    taken = take(plain, F.regexp_count("text", F.lit(WORD)), epochs, seed, tie=every).where("taken > 0")
    times = F.array_repeat("size", F.floor(F.col("taken") / F.col("size")).cast("int"))
    part = F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<bigint>"))
    rows = taken.withColumn("words_", F.explode(F.concat(times, part)))
    rows = rows.withColumn("whole_", F.col("words_") == F.col("size"))
    rows = rows.withColumn("text", F.when(F.col("whole_"), F.col("text")).otherwise(cut(F.col("text"), F.col("words_"))))

    def out(c: str) -> Column:
        if c == "n_chars":
            return F.when(F.col("whole_"), F.col(own[c])).otherwise(F.length("text").cast(docs.schema[c].dataType)).alias(c)
        return F.col(own.get(c, c)).alias(c)

    return rows.select(*map(out, docs.columns))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("n"))
    return take(saved(docs), F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(source_size AS HUGEINT) * 3 AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s
), p AS (
  SELECT *, sum(cap) OVER o AS caps, coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS free,
         sum(source_size) OVER () AS budget
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), c AS (
  SELECT *, caps * w + cap * free <= budget * w AS clamped FROM p
), t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE)
              ELSE CAST(budget - coalesce(sum(cap) FILTER (clamped) OVER (), 0) AS DOUBLE) / CAST(sum(w) FILTER (NOT clamped) OVER () AS DOUBLE) * CAST(w AS DOUBLE) END AS target
  FROM c
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t
), x AS (
  SELECT d.*, g.source_size, g.target, g.whole, CAST(floor(g.target + 0.5) AS BIGINT) - g.whole * g.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x
"""
