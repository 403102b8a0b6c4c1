"""Binary documents by a chain of extractors; the extractors are pluggable, as none is installed here."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EXTRACTORS: dict[str, Callable[[bytes], str]] = {}


def register_extractor(suffix: str, extract: Callable[[bytes], str]) -> None:
    """extract(content) returns a file's text, or raises."""
    _EXTRACTORS[suffix.lower()] = extract


def extract(content: bytes | None, suffix: str, extractors: dict[str, Callable[[bytes], str]]) -> tuple[str | None, str | None]:
    """(text, error); an empty text is an error too."""
    try:
        text = extractors[suffix.lower()](content or b"")
        return (text, None) if text.strip() else (None, f"{suffix}: no text")
    except Exception as e:  # noqa: BLE001  any extractor's failure is a row, not the end of the job
        return None, f"{suffix}: {e!r}"


def read_documents(spark: SparkSession, path: str, order: tuple[str, ...] = (".hwp", ".pdf")) -> DataFrame:
    """name, text, kind, error: of the files that share a name, the text of the first kind in `order` that can be extracted."""
    table = dict(_EXTRACTORS)  # goes to the workers with the function
    files = spark.read.format("binaryFile").load(path)
    base = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.select(base.alias("name"), kind.alias("kind"), "content").where(F.col("kind").isin(*order))

    def run(frames):
        for f in frames:
            got = [extract(c, k, table) for c, k in zip(f.content, f.kind, strict=True)]
            yield pd.DataFrame({"name": f.name, "kind": f.kind, "text": [t for t, _ in got], "error": [e for _, e in got]})

    tried = rows.mapInPandas(run, "name string, kind string, text string, error string")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    best = F.min(F.when(F.col("text").isNotNull(), F.struct(rank.alias("r"), "kind", "text")))
    g = tried.groupBy("name").agg(best.alias("b"), F.array_join(F.collect_list("error"), "; ").alias("error"))
    return g.select("name", "b.text", "b.kind", F.when(F.col("b").isNull(), F.col("error")).alias("error"))
