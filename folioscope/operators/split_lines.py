"""Paragraphs of standards from their lines, where one document may lie over many tasks.

``split.split_standard`` reads a document from its first line to its last. Here the lines are cut into blocks, and what a block does to
the state before it is a summary that goes with any other one:

* a number comes next in its series by the last one alone, so a block maps the last number before it to the last one in it. That map is
  constant between a few bounds, and the maps of a document's blocks, one after another, give the state before each block;
* the open paragraph and the heading are those of the last line that opens or closes one, so the last such line of each block is enough;
* a sub-item begins where its mark is greater than all marks before it in its paragraph.

A paragraph's text is one value and is put together in one task; a document's is not.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import split as S
from .shared import saved, shared_folder

LINES_A_BLOCK = 4096
_MOST_TAIL = 1 << 16  # characters of plain lines that one row holds

_EVENTS = (
    "doc_id long, number string, block long, n long, kind string, series string, num string, suffix string, label string, mark string, "
    "rest int, line string, tail string, at boolean, bounds array<string>, exits array<string>, start string"
)
_NAMES = [c.split()[0] for c in _EVENTS.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_ARROW = [_TYPES[c.split()[1]] for c in _EVENTS.split(", ")]


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, number, n, line for every line of docs (doc_id, text, number)."""
    return docs.select("doc_id", "number", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def _begins(series: str, num: str, suffix: str) -> bool:
    """Whether a series may begin with this number (three digits a component, so that numbers compare as strings)."""
    return not suffix and int(num[:3]) <= (S.SERIES_BEGINS if series else S.TEXT_BEGINS)


def _follows(last: str, num: str) -> bool:
    return last < num and int(num[:3]) - int(last[:3]) <= S.WIDEST_JUMP


def step(state: str | None, series: str, num: str, suffix: str) -> str | None:
    """The last number of a series after a candidate."""
    ok = _begins(series, num, suffix) if state is None else _follows(state, num)
    return num if ok else state


def summary(series: str, candidates: list[tuple[str, str]]) -> tuple[list[str], list[str], str | None]:
    """What a block's candidates (number, suffix) make of the last number before it: bounds, results, result without one.

    A number from bounds[i] on, and below bounds[i + 1], leads to results[i], or stays where that is empty.
    """
    lowest = [f"{int(num[:3]) - S.WIDEST_JUMP:03d}" if int(num[:3]) > S.WIDEST_JUMP else "" for num, _ in candidates]
    bounds = sorted({"", *lowest, *(num for num, _ in candidates)})
    to = np.full(len(bounds), -1)
    start = None
    for (num, suffix), low in zip(reversed(candidates), reversed(lowest), strict=True):
        own = bisect_left(bounds, num)
        end = to[own] if to[own] >= 0 else own  # where later candidates lead from here
        to[bisect_left(bounds, low) : own] = end
        if _begins(series, num, suffix):
            start = bounds[end]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return [bounds[i] for i in first], [bounds[to[i]] if to[i] >= 0 else "" for i in first], start


def after(state: str | None, bounds: list[str], results: list[str], start: str | None) -> str | None:
    """The last number behind a block with this summary."""
    return start if state is None else results[bisect_right(bounds, state) - 1] or state


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of documents, blocks and lines to rows: one a heading, candidate or sub-item with the plain lines behind it,
    and one a series of a block with its summary; the first block of a document has no state before it and is decided at once."""
    held: list[tuple] = []
    size, at_block = 0, None
    row: list | None = None
    tail: list[str] = []
    tailed = 0
    series_of: dict[str, list] = {}
    last: dict[str, str | None] = {}

    def put(values: tuple) -> None:
        nonlocal size
        held.append(values)
        size += 200 + 4 * sum(len(v) for v in values if isinstance(v, str)) + sum(8 * len(v) for v in values if isinstance(v, list))

    def close_row() -> None:
        nonlocal row, tail, tailed
        if row is not None:
            put((*row[:12], "\n".join(tail) if tail else None, row[12], None, None, None))
        row, tail, tailed = None, [], 0

    def close_block() -> None:
        close_row()
        for series in series_of.keys() | last.keys():
            bounds, exits, start = summary(series, series_of[series]) if at_block[1] else ([""], [""], last[series])
            put((at_block[0], None, at_block[1], None, "summary", series, *[None] * 8, bounds, exits, start))
        series_of.clear()
        last.clear()

    def portion() -> pa.RecordBatch:
        nonlocal size
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True) if held else [[]] * len(_NAMES), _ARROW, strict=True)], _NAMES)
        held.clear()
        size = 0
        return out

    for doc_id, number, block, n, raw in S.rows_of(batches, "line"):
        if (doc_id, block) != at_block:
            if at_block is not None:
                close_block()
            at_block = (doc_id, block)
        line = S.normal(raw).strip()
        if not line:
            continue
        found = None if S.is_heading(line) else S.paragraph_start(line)
        item = S.SUBITEM.match(line)
        base = (doc_id, number, block, n)
        if S.is_heading(line):
            close_row()
            row = [*base, "heading", None, None, None, None, None, None, line, None]
        elif found:
            close_row()
            series, digits, suffix, rest = found
            num = "".join(f"{int(x):03d}" for x in digits.split("."))
            at = None
            if block:
                series_of.setdefault(series, []).append((num, suffix))
            else:
                last[series] = step(last.get(series), series, num, suffix)
                at = last[series] == num
            row = [*base, "start", series, num, suffix, series + digits + suffix, None, len(line) - len(rest) + 1, line, at]
        elif item:
            close_row()
            row = [*base, "item", None, None, None, None, item[1], len(line) - len(item[2]) + 1, line, None]
        elif row is None or tailed > _MOST_TAIL:
            close_row()
            row = [*base, "plain", None, None, None, None, None, None, line, None]
        else:
            tail.append(line)
            tailed += len(line)
        if size > S.MOST_BYTES:
            yield portion()
    if at_block is not None:
        close_block()
    yield portion()


def _before_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """The last number of a series before each block but the first, from the summaries of a document's blocks."""
    group, state, entries = group.sort_values("block"), None, []
    for g in group.itertuples(index=False):
        entries.append(state)
        state = after(state, list(g.bounds), list(g.exits), g.start) if g.block else g.start
    return group[["doc_id", "series", "block"]].assign(entry=entries)[group["block"] > 0]


def _decided(group: pd.DataFrame) -> pd.DataFrame:
    """Of a block's candidates in one series, those at which the last number is their own."""
    group = group.sort_values("n")
    state, at = group["entry"].iloc[0], []
    for series, num, suffix in group[["series", "num", "suffix"]].itertuples(index=False):
        state = step(state, series, num, suffix)
        at.append(state == num)
    return group.loc[at, ["doc_id", "series", "num", "suffix", "block", "n"]]


def split_lines(lines: DataFrame, lines_a_block: int = LINES_A_BLOCK, in_order: bool = False) -> DataFrame:
    """The parts of ``split_standard`` with the line at which each begins: doc_id, n, ref_key, para_no, series, section, text.

    lines: doc_id long, number string (one a document), n (from 0 on, distinct in a document; gaps do no harm), line string. Null lines
    are blank. Lines without a doc_id belong to no document and are left out. An empty table gives no rows.

    in_order: the lines of a document lie together and in order in one partition, as those of ``lines_of``, so they are read in place.
    What is read is written to the shared folder as Parquet, of which later steps read the columns they need.
    """
    cut = lines.where("doc_id is not null").select(
        F.col("doc_id").cast("long"), F.col("number").cast("string"), F.floor(F.col("n") / lines_a_block).alias("block"), F.col("n").cast("long"), F.col("line").cast("string")
    )
    if not in_order:
        cut = cut.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "n")
    folder = shared_folder(lines.sparkSession, "lines")
    cut.mapInArrow(_read, _EVENTS).write.parquet(folder)
    rows = lines.sparkSession.read.parquet(folder)

    at = rows.where("kind = 'start' and at").select("doc_id", "series", "num", "suffix", "block", "n")
    long_docs = rows.where("block > 0").select("doc_id").distinct()
    maps = rows.where("kind = 'summary'").select("doc_id", "series", "block", "bounds", "exits", "start").join(long_docs, "doc_id", "left_semi")
    entry = maps.groupBy("doc_id", "series").applyInPandas(_before_blocks, "doc_id long, series string, block long, entry string")
    later = rows.where("kind = 'start' and block > 0").select("doc_id", "series", "block", "num", "suffix", "n").join(entry, ["doc_id", "series", "block"])
    later = later.groupBy("doc_id", "series", "block").applyInPandas(_decided, "doc_id long, series string, num string, suffix string, block long, n long")
    opened = at.unionByName(later).groupBy("doc_id", "series", "num", "suffix").agg(F.min(F.struct("n", "block")).alias("x"))  # a repeated one opens nothing
    opened = saved(opened.select("doc_id", "x.block", "x.n"))

    event = F.struct(F.col("n").alias("n"), F.lit(True).alias("open"))
    closed = F.when(F.col("kind") == "heading", F.struct(F.col("n").alias("n"), F.lit(False).alias("open")))
    headed = F.when(F.col("kind") == "heading", F.struct(F.col("n").alias("n"), F.col("line").alias("section")))
    marks = rows.where("kind <> 'summary'").withColumn("event", closed).withColumn("head", headed).drop("at", "bounds", "exits", "start", "num", "suffix")
    opens = opened.select("doc_id", "block", "n", event.alias("event"))
    ends = marks.select("doc_id", "block", "event", "head").unionByName(opens.select("doc_id", "block", "event"), allowMissingColumns=True)
    ends = ends.groupBy("doc_id", "block").agg(F.max("event").alias("event"), F.max("head").alias("head"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    carried = ends.select("doc_id", "block", F.lit(-1).cast("long").alias("n"), F.max("event").over(before).alias("event"), F.max("head").over(before).alias("head"))
    carried = carried.where("event is not null")

    # an opening or carried event stands before the line itself; structs with a greater n are greater
    upto = Window.partitionBy("doc_id", "block").orderBy("n", F.col("kind").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    every = marks.unionByName(opens, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    owned = every.withColumn("own", F.max("event").over(upto)).withColumn("section", F.max("head").over(upto)["section"])
    owned = owned.where("kind is not null and kind <> 'heading' and own.open").withColumn("para", F.col("own.n"))

    inside = Window.partitionBy("doc_id", "para").orderBy("n")
    marked = F.max("mark").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    item = (F.col("kind") == "item") & (marked.isNull() | (F.col("mark") > marked))
    owned = owned.withColumn("item", item).withColumn("item_n", F.max(F.when(F.col("item"), F.col("n"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("n") == F.col("para")
    said = F.concat_ws("\n", F.when(first | F.col("item"), F.substring(F.col("line"), F.col("rest"), F.length("line"))).otherwise(F.col("line")), "tail")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c.alias("said")))), lambda x: x["said"]), "\n")
    parts = owned.groupBy("doc_id", "para", "item_n").agg(
        F.trim(joined(said), F.lit("\n")).alias("text"), F.max(F.when(F.col("item"), F.col("mark"))).alias("mark"),
        F.max(F.when(first, F.struct("number", "label", "series", "section"))).alias("top"),
    )
    part = F.struct(F.coalesce("item_n", "para").alias("n"), F.coalesce("mark", F.lit("")).alias("mark"), "text")
    paras = parts.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("top").alias("top"))
    shown = F.filter(F.transform("parts", lambda p: F.when(p["mark"] == "", p["text"]).otherwise(F.concat(p["mark"], F.lit(" "), p["text"]))), lambda x: x != "")
    whole = F.transform(F.slice("parts", 1, 1), lambda p: F.struct(p["n"].alias("n"), p["mark"].alias("mark"), F.array_join(shown, "\n").alias("text")))
    paras = paras.withColumn("p", F.explode(F.concat(whole, F.slice("parts", F.lit(2), F.size("parts")))))
    no = F.concat("top.label", "p.mark")
    return paras.select(
        "doc_id", "p.n", F.concat(F.lit("제"), "top.number", F.lit("호 문단 "), no).alias("ref_key"), no.alias("para_no"),
        F.when(F.col("top.series") == "", "본문").otherwise(F.col("top.series")).alias("series"), F.coalesce("top.section", F.lit("")).alias("section"), "p.text",
    )
