"""Loading, keeping and counting records: ids, incremental loads, upserts, board statistics, goldens, traces, batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved


def record_id(file: Column, lineno: Column) -> Column:
    return F.concat_ws(":", F.regexp_replace(file, r"\.jsonl$", ""), lineno.cast("string"))


def only_new(rows: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not loaded yet; changed rows of a known id are not loaded again."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, rows: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The union with the latest version of each id; of equal versions a new row before an existing one, then the greatest as JSON."""
    both = existing.withColumn("new_", F.lit(0)).unionByName(rows.withColumn("new_", F.lit(1)), allowMissingColumns=True)
    whole = F.to_json(F.struct(*(c for c in both.columns if c != "new_")))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("new_"), F.desc(whole))
    return both.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_", "new_")


def latest_by_position(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))).where("n_ = 1").drop("n_")


def board_stats(records: DataFrame) -> DataFrame:
    """Per board: n, body fallbacks and their share, html records (also those without a qa_source), official numbers, no refs."""
    src = F.coalesce("qa_source", F.lit("html"))
    return records.groupBy("board").agg(
        F.count("*").alias("n"),
        F.count_if(src == "html").alias("html"),
        F.count_if(src == "body_fallback").alias("fallback"),
        (F.count_if(src == "body_fallback") / F.count("*")).alias("fallback_ratio"),
        F.count_if(~F.startswith("doc_no", F.concat("board", F.lit("-")))).alias("official"),
        F.count_if(F.size("standard_refs") == 0).alias("no_refs"),
    )


def guard(rows: DataFrame, threshold: float = 0.3, least: int = 20) -> DataFrame:
    """(board, tripped_at): the first row (by seq) at which, with at least `least` rows seen, fallbacks exceed the threshold.

    Rows are dealt out by ranges of board and seq, so one huge board is many tasks: counts of the ranges before and running counts
    inside a range make the running counts of the board. Which range a row is in is saved with it.
    """
    flags = rows.select("board", "seq", F.coalesce(F.col("fallback").cast("int"), F.lit(0)).alias("f"))
    dealt = saved(flags.repartitionByRange("board", "seq").withColumn("range_", F.spark_partition_id()))
    before = Window.partitionBy("board").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = dealt.groupBy("board", "range_").agg(F.count("*").alias("n_"), F.sum("f").alias("f_"))
    sums = sums.select(F.col("board").alias("b_"), F.col("range_").alias("r_"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n_", "f_")))
    inside = Window.partitionBy("board", "range_").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.withColumn("n", F.count("*").over(inside)).withColumn("s", F.sum("f").over(inside))
    both = run.join(sums, F.col("board").eqNullSafe(F.col("b_")) & (F.col("range_") == F.col("r_"))).select("board", "seq", (F.col("n") + F.col("n_")).alias("n"), (F.col("s") + F.col("f_")).alias("s"))
    trip = F.min(F.when((F.col("n") >= least) & (F.col("s") / F.col("n") > threshold), F.col("seq")))
    return both.groupBy("board").agg(trip.alias("tripped_at"))


def golden_rows(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """Questions with the collections and keys that their citations lead to, or why they have none.

    questions: id, board, question, refs; targets: ref_key, section_key, collection, pos. A citation is looked up as a ref_key,
    then as a section_key; of equal keys the first record counts. Result: id, board, reason (null, no_question,
    no_joinable_ref), expected_ref_keys in citation order, expected_collections sorted.
    """
    by = lambda key: targets.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("ref")).agg(F.min_by("collection", "pos").alias(f"by_{key}"))
    each = questions.select("id", F.posexplode(F.array_distinct("refs")).alias("at", "ref"))
    hit = each.join(by("ref_key"), "ref", "left").join(by("section_key"), "ref", "left").withColumn("coll", F.coalesce("by_ref_key", "by_section_key"))
    got = hit.where("coll is not null").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "ref"))).alias("r"), F.sort_array(F.collect_set("coll")).alias("expected_collections"))
    empty = F.array().cast("array<string>")
    out = questions.join(got, "id", "left")
    reason = F.when(F.coalesce("question", F.lit("")) == "", "no_question").when(F.col("r").isNull(), "no_joinable_ref")
    return out.select("id", "board", reason.alias("reason"), F.coalesce(F.col("r.ref"), empty).alias("expected_ref_keys"), F.coalesce("expected_collections", empty).alias("expected_collections"))


def numbered(rows: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """Adds the number of each row, from 0, in a global order, without gathering the rows in one task.

    Rows are dealt out by ranges of `order` and numbered inside each; a prefix sum over one count per range gives the rest.
    """
    # the number of the range is saved with the rows' place in it, so both come from one execution
    spread = rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    inside = Window.partitionBy("range_").orderBy(*order)
    place = saved(spread.withColumn("place_", F.row_number().over(inside).cast("long") - 1))
    counts = place.groupBy("range_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("begin_"))
    return place.join(F.broadcast(begin), "range_").withColumn(name, F.col("begin_") + F.col("place_")).drop("range_", "place_", "begin_")


def definition_goldens(terms: DataFrame, templates: tuple[str, ...]) -> DataFrame:
    """One question per term (section_key set, a term in its key, two characters or more), templates in turn by ref_key."""
    t = numbered(terms.where("section_key is not null and instr(ref_key, ':') > 0 and length(term) >= 2"), "ref_key", name="n_of_term")
    q = F.element_at(F.array(*map(F.lit, templates)), (F.col("n_of_term") % len(templates) + 1).cast("int"))
    return t.withColumn("question", F.replace(q, F.lit("{term}"), F.col("term"))).drop("n_of_term")


def history(messages: DataFrame, n: int = 6) -> DataFrame:
    """Adds the last n messages before each one of a thread, oldest first. messages: thread, seq, role, content."""
    w = Window.partitionBy("thread").orderBy("seq").rowsBetween(-n, -1)
    return messages.withColumn("history", F.collect_list(F.struct("role", "content")).over(w))


def latency_by_node(trace: DataFrame) -> DataFrame:
    """Mean latency per node in whole milliseconds, cut, over nodes that have one. trace: array of (node, latency_ms, ...)."""
    each = trace.select(F.inline("trace")).where("latency_ms is not null")
    return each.groupBy("node").agg(F.count("*").alias("n"), F.avg("latency_ms").cast("long").alias("mean_ms"))


def attach_eval(trace: DataFrame, evals: DataFrame) -> DataFrame:
    """Evaluations go to the trace rows of their question that have none, the last row (by seq) first; trace: seq, question, eval.

    Of several evaluations of one question (in the order of `at`, or of eval where there is no such column) each goes to the next
    row back. Those without a row are dropped.
    """
    mine = Window.partitionBy("question")
    open_ = trace.where("eval is null").select("seq", "question", F.row_number().over(mine.orderBy(F.desc("seq"))).alias("n_"))
    order = "at" if "at" in evals.columns else "eval"
    new = evals.select("question", F.col("eval").alias("new_eval"), F.row_number().over(mine.orderBy(order)).alias("n_"))
    return trace.join(open_.join(new, ["question", "n_"]).select("seq", "new_eval"), "seq", "left").withColumn("eval", F.coalesce("eval", "new_eval")).drop("new_eval")


def adaptive_batches(rows: DataFrame, group: str, most_tokens: int = 8192, most_rows: int = 32) -> DataFrame:
    """(id, group, tokens, batch): each group's texts from long to short in batches that fit a token budget.

    A text counts max(1, length // 2) tokens, most_tokens at most; a batch holds max(1, min(most_rows, most_tokens // its first
    text's tokens)) texts. Where batches begin is a chain over how many texts a group has of each size, at most `most_tokens`
    counts a group; each text then finds its batch by its place among the texts of its size, in ranges of the id (a number).
    """
    size = F.least(F.greatest(F.floor(F.length(F.coalesce("text", F.lit(""))) / 2), F.lit(1)), F.lit(most_tokens)).cast("long")
    short = rows.select("id", F.col(group).alias("grp"), size.alias("tokens"))
    counts = short.groupBy("grp", "tokens").agg(F.count("*").alias("n"))
    shape = counts.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct((-F.col("tokens")).alias("t"), "n"))).alias("sizes"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grp, sizes in zip(b["grp"].to_pylist(), b["sizes"].to_pylist(), strict=True):
                out, batch, left = [], -1, 0
                for x in sizes:
                    tok, n = -x["t"], x["n"]
                    fit = max(1, min(most_rows, most_tokens // tok))
                    # texts that still go into the open batch, then full batches of this size
                    begin = min(left, n)
                    out.append((grp, tok, batch, left, fit))
                    full = -(-(n - begin) // fit)
                    batch, left = batch + full, (left - n if not full else full * fit - (n - begin))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), *(pa.int64(),) * 4), strict=True)], ["grp", "tokens", "open", "room", "fit"])

    plan = shape.mapInArrow(run, "grp string, tokens long, open long, room long, fit long")
    # a text's place among those of its size: a running count inside ranges of ids, after a prefix sum over the ranges
    ranged = short.withColumn("range_", F.floor(F.col("id") / 4096))
    per = ranged.groupBy("grp", "tokens", "range_").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp", "tokens").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("grp", "tokens", "range_", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("grp", "tokens", "range_").orderBy("id")) - 1
    a, b, c = ranged.withColumn("inside", inside).alias("a"), per.alias("b"), plan.alias("c")
    same = lambda x, y, *names: reduce(and_, (F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}")) for n in names))  # noqa: E731  a null group is one
    x = a.join(b, same("a", "b", "grp", "tokens", "range_")).join(c, same("a", "c", "grp", "tokens"))
    x = x.select("a.id", "a.grp", "a.tokens", (F.col("before") + F.col("inside")).alias("place"), "open", "room", "fit")
    later = F.col("open") + 1 + F.floor((F.col("place") - F.col("room")) / F.col("fit")).cast("long")
    return x.select("id", "grp", "tokens", F.when(F.col("place") < F.col("room"), F.col("open")).otherwise(later).alias("batch"))


# The fields of a record that its metadata keep.
BASE_FIELDS = ("doc_no", "source", "record_type")
KEPT_FIELDS = ("ref_key", "section_key", "src_file", "standard_no", "standard_name", "para_no", "term", "title", "reply_date", "qa_source", "url")
AUDIT_ONLY = ("case_id", "standard", "source_url", "audit_gap", "implication", "fiscal_year")


def metadata(records: DataFrame, collection: Column) -> Column:
    """A flat struct of a record's metadata: base fields never null, kept fields null where empty, attachments joined, the audit
    fields only of audit cases. Fields that `records` has no column for are null."""
    have = set(records.columns)
    field = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in have else F.lit(None).cast("string")
    audit = F.coalesce(F.col("record_type") == "audit_case", F.lit(False)) if "record_type" in have else F.lit(False)
    joined = F.nullif(F.array_join("attachments", " | "), F.lit("")) if "attachments" in have else F.lit(None).cast("string")
    return F.struct(
        collection.alias("collection"),
        *(F.coalesce(field(c), F.lit("")).alias(c) for c in BASE_FIELDS),
        *(field(c).alias(c) for c in KEPT_FIELDS),
        (F.col("page_no").cast("int") if "page_no" in have else F.lit(None).cast("int")).alias("page_no"),
        joined.alias("attachments"),
        *(F.when(audit, field(c)).alias(c) for c in AUDIT_ONLY),
        F.when(audit, F.col("standard_superseded").cast("boolean") if "standard_superseded" in have else F.lit(None).cast("boolean")).alias("standard_superseded"),
    )


def head_sample(rows: DataFrame, n: int, position: str = "lineno") -> DataFrame:
    """The first n rows in file order."""
    return rows.orderBy(position).limit(n)


def now_iso() -> Column:
    """The time of the query with its zone, to the second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def latency_ms(begin: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(begin)


def collected(ids: DataFrame, key: str = "id") -> DataFrame:
    """The state of a crawl as one row: its ids, sorted, and when. It is small and overwritten as a whole."""
    return ids.agg(F.sort_array(F.collect_set(key)).alias("collected"), now_iso().alias("updated_at"))
