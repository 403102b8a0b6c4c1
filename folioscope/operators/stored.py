"""A corpus stored in sorted buckets of its id: loads and gathers by id do not shuffle what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import only_new


def store(records: DataFrame, name: str, key: str = "id", buckets: int = 64, path: str | None = None, mode: str = "error") -> None:
    """The records as a table of the catalog in `buckets` buckets of the key, each sorted by it.

    Rows are dealt out the way buckets are, so each bucket is written by one task as one file. `append` takes the same key and number
    of buckets and adds files to them. A key of very many rows would be one bucket: this is for ids.
    """
    rows = records.repartition(buckets, F.col(key))
    rows.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name, format="parquet", **({"path": path} if path else {}))


def load_new(rows: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Rows whose id the stored corpus does not have (only they are shuffled, to its buckets)."""
    return only_new(rows, rows.sparkSession.table(name), key)


def gather(ids: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Each wanted row (its id and other columns) with its stored record; ids without one are left out, repeated ids stay."""
    stored = ids.sparkSession.table(name)
    clash = [c for c in ids.columns if c != key and c in stored.columns]
    if clash:
        raise ValueError(f"columns of the stored records: {clash}")
    return ids.join(stored, key)
