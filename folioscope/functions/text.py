"""Record projections, citation checks, JSON extraction and small text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)^\s+|\s+$"
# The refusal sentence's marker and the length below which an answer counts as a refusal.
REFUSAL = "근거를 찾지 못"
SHORTEST_ANSWER = 15
FILE_CHARS = r'[\\/:*?"<>|\x00-\x1f]'
OFFICIAL_NUMBER = r"\d{4}-[A-Z]{1,3}-[A-Z]{2,5}\d+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def clip(text: Column, n: int) -> Column:
    """The first n characters; null becomes empty."""
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; null if none is."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def display_id(ref_key: Column, doc_no: Column, row_id: Column) -> Column:
    return F.coalesce(F.nullif(ref_key, F.lit("")), F.nullif(doc_no, F.lit("")), row_id)


def embed_text(record_type: Column, text: Column, term: Column, question: Column, answer: Column, body: Column, facts: Column, violation: Column, basis: Column) -> Column:
    """The text that stands for a record, by its type; question and answer unless both are empty, then the body."""
    e = lambda c: F.coalesce(c, F.lit(""))
    audit = F.concat(F.lit("사실관계: "), e(facts), F.lit("\n\n지적사항: "), e(violation), F.lit("\n\n판단근거: "), e(basis))
    of_term = F.when(e(term) != "", F.concat(term, F.lit(": "), e(text))).otherwise(e(text))
    qa = F.when((e(question) != "") | (e(answer) != ""), F.concat(F.lit("질의: "), e(question), F.lit("\n회신: "), e(answer))).otherwise(e(body))
    return F.when(record_type == "audit_case", audit).when(record_type == "term", of_term).when(record_type == "paragraph", e(text)).otherwise(qa)


def citations(text: Column) -> Column:
    """What stands between square brackets, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))


def invalid_citations(text: Column, valid: Column) -> Column:
    return F.array_except(citations(text), valid)


def strip_citations(text: Column, invalid: Column) -> Column:
    """The text without the brackets of invalid citations; runs of blanks become one, ends are trimmed."""
    gone = F.aggregate(invalid, text, lambda acc, x: F.replace(acc, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
    return strip(F.regexp_replace(gone, r"[ \t]{2,}", " "))


def is_refusal(text: Column) -> Column:
    return text.contains(REFUSAL) | (F.length(text) < SHORTEST_ANSWER)


def needs_citation_retry(text: Column, valid: Column) -> Column:
    """Some citation is invalid in a text that is no refusal."""
    return ~is_refusal(text) & (F.size(invalid_citations(text, valid)) > 0)


def answer_gate(text: Column, valid: Column, strict: bool, refusal: Column) -> Column:
    """struct(has_grounds, used_refs, text): strict wants a valid citation, lenient strips invalid ones; refusals have no grounds."""
    used = F.array_intersect(F.array_distinct(citations(text)), valid)
    refused = is_refusal(text)
    grounded = (~refused & (F.size(used) > 0)) if strict else ~refused
    refs = F.when(grounded, used).otherwise(F.array().cast("array<string>")) if strict else used
    shown = text if strict else strip_citations(text, invalid_citations(text, valid))
    return F.struct(grounded.alias("has_grounds"), refs.alias("used_refs"), F.when(grounded, shown).otherwise(refusal).alias("text"))


def json_object(text: Column) -> Column:
    """From the first { to the last }, if that is a JSON object; else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    # a parser may stop after the first value; as the one element of a list, everything has to be read
    return F.when((found != "") & (F.json_array_length(F.concat(F.lit("["), found, F.lit("]"))) == 1), found)


def file_name(name: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_replace(name, FILE_CHARS, "_")), F.lit("")), F.lit("unnamed"))


def official_number(names: Column) -> Column:
    """The first official document number in a list of names."""
    found = F.transform(names, lambda n: F.regexp_extract(F.coalesce(n, F.lit("")), OFFICIAL_NUMBER, 0))
    return F.get(F.filter(found, lambda n: n != ""), F.lit(0))


def without_page_marks(text: Column) -> Column:
    """Lines that are only "n/m" go."""
    return strip(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*\d+/\d+\s*$")), "\n"))


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|~>$])", r"\\$1")


def anchor(key: Column) -> Column:
    return F.concat(F.lit("ref-"), F.substring(F.md5(key.cast("binary")), 1, 8))


def highlight(text: Column, valid: Column) -> Column:
    """Valid bracketed citations become links to their anchors."""
    return F.aggregate(
        F.array_intersect(F.array_distinct(citations(text)), valid), text,
        lambda acc, x: F.replace(acc, F.concat(F.lit("["), x, F.lit("]")), F.concat(F.lit("[**"), x, F.lit("**](#"), anchor(x), F.lit(")"))),
    )


def without_blanks(text: Column) -> Column:
    """For containment tests between texts that were extracted differently."""
    from .refs import normalize_ref

    return F.regexp_replace(normalize_ref(F.coalesce(text, F.lit(""))), r"(?U)\s+", "")


def tokens(text: Column) -> Column:
    """The default tokenizer of lexical search; a pluggable one replaces it."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^ \t\n\r.,;:!?()]+"), F.lit(0))


def retry_needed(retrieved_scores: Column, already_retried: Column, threshold: float = 0.6) -> Column:
    """No retry yet and the first score (0 without any) is below the threshold."""
    return ~already_retried & (F.coalesce(F.get(retrieved_scores, F.lit(0)), F.lit(0.0)) < threshold)
