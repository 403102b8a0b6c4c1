"""Routing of questions to collections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Collection names in their order, and the words that name an accounting framework.
COLLECTIONS = ("qa_kifrs", "qa_kgaap", "kifrs_standards", "kgaap_standards")
KGAAP_WORDS = "중소기업|일반기업|비상장|중견기업"
KIFRS_WORDS = "상장|연결재무제표|K-?IFRS|국제회계|지배기업"


def known(collections: Column, loaded: tuple[str, ...] = COLLECTIONS) -> Column:
    """The asked ones that are loaded, in their order; all loaded ones if none is left."""
    all_ = F.array(*map(F.lit, loaded))
    kept = F.filter(F.coalesce(collections, F.array().cast("array<string>")), lambda c: F.array_contains(all_, c))
    return F.when(F.size(kept) > 0, kept).otherwise(all_)


def framework_guard(question: Column, collections: Column) -> Column:
    """Only one framework's words: only its collections. Both or none: all collections, missing ones appended."""
    kgaap, kifrs = question.rlike(KGAAP_WORDS), question.rlike(KIFRS_WORDS)

    def only(name: str) -> Column:
        kept = F.filter(collections, lambda c: F.contains(c, F.lit(name)))
        return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(f"qa_{name}"), F.lit(f"{name}_standards")))

    both = F.array_union(collections, F.array(*map(F.lit, COLLECTIONS)))
    return F.when(kgaap & ~kifrs, only("kgaap")).when(kifrs & ~kgaap, only("kifrs")).otherwise(both)


def ordered(collections: Column, kind: Column) -> Column:
    """A definition question gets a standards collection; a case question has the qa collections first."""
    standards = F.exists(collections, lambda c: F.endswith(c, F.lit("standards")))
    c = F.when((kind == "정의조회") & ~standards, F.concat(collections, F.array(F.lit("kifrs_standards")))).otherwise(collections)
    qa_first = F.concat(F.filter(c, lambda x: F.startswith(x, F.lit("qa_"))), F.filter(c, lambda x: ~F.startswith(x, F.lit("qa_"))))
    return F.when(kind == "사례시나리오", qa_first).otherwise(c)


def route(question: Column, asked: Column, kind: Column) -> Column:
    """The asked collections that exist, guarded by the question's framework and ordered by the question's kind."""
    all_ = F.array(*map(F.lit, COLLECTIONS))
    kept = F.filter(F.coalesce(asked, F.array().cast("array<string>")), lambda c: F.array_contains(all_, c))
    return ordered(framework_guard(question, kept), F.coalesce(kind, F.lit("일반")))
