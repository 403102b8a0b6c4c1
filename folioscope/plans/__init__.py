"""Named queries over the driver's tables and their SQL."""

from . import citations, evaluation, records, retrieval, storing  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
