"""Pluggable models: embedders, rerankers and text generators are columns made by registered functions.

The built-in ones are deterministic stand-ins for tests and offline use; they say nothing about the quality of a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCORERS: dict[str, Callable] = {}


def register_scorer(name: str, make: Callable[..., Column]) -> None:
    """make(qtext, text, qvec, vec) returns a score column; a pandas UDF goes here for a model."""
    _SCORERS[name] = make


def scorer(name: str) -> Callable[..., Column]:
    return _SCORERS[name]


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def overlap(qtext: Column, text: Column) -> Column:
    """The share of the question's distinct tokens that stand in the text."""
    from ..functions.text import tokens

    q = F.array_distinct(tokens(qtext))
    return F.size(F.array_intersect(q, F.array_distinct(tokens(text)))) / F.greatest(F.size(q), F.lit(1))


register_scorer("cosine", lambda qtext, text, qvec, vec: cosine(qvec, vec))
register_scorer("overlap", lambda qtext, text, qvec, vec: overlap(qtext, text))


def rewritten(model_output: Column, question: Column) -> Column:
    """A rewriting model's stripped output, or the question if that is empty."""
    from ..functions.text import strip

    return F.coalesce(F.nullif(strip(F.coalesce(model_output, F.lit(""))), F.lit("")), question)


def judged(score: Column) -> Column:
    """A judge's score held to 0 to 1; null stays null."""
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def context(ids: Column, collections: Column, texts: Column, width: int = 700) -> Column:
    """The evidence part of an answer prompt: [id] (collection) text, blank lines between."""
    each = F.transform(F.arrays_zip(ids.alias("i"), collections.alias("c"), texts.alias("t")), lambda x: F.concat(F.lit("["), x["i"], F.lit("] ("), x["c"], F.lit(") "), F.substring(x["t"], 1, width)))
    return F.array_join(each, "\n\n")
