"""Compatibility normalisation, which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _nfkc(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else "".join(unicodedata.normalize("NFKC", k).split()))


def nfkc_key(key: Column) -> Column:
    """NFKC without any white space, so that equal citations in different glyphs compare equal; null stays null."""
    return F.pandas_udf(_nfkc, "string")(key)


def register(spark: SparkSession) -> None:
    """Makes nfkc_key a function of SQL texts in this session."""
    spark.udf.register("nfkc_key", F.pandas_udf(_nfkc, "string"))
