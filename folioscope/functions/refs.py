"""Citation keys as column expressions: normalise, extract, expand ranges, classify."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters, patterns and formats that make keys comparable.
QUOTES_FROM = "‘’＇`´“”＂\"\u3000\u00a0"
QUOTES_TO = "'''''''''  "
PARA = r"(?:[A-Z]{1,2})?\d+(?:\.\d+)*[A-Z]*(?:[⑴-⒇])?"
NAME_AND_PARA = r"(?:\s*'([^'\n]{1,40})')?(?:[^\n]{0,15}?문단\s*(" + PARA + ")"
MORE = r"((?:\s*[~∼]\s*" + PARA + r")?(?:\s*[,，]\s*문단\s*" + PARA + r")*)"
STANDARD = r"(?U)제(\d{3,4})호" + NAME_AND_PARA + MORE + ")?"
CHAPTER = r"(?U)제(\d{1,2})장" + NAME_AND_PARA + MORE + ")?"
TERM_SECTION = r"(?U)제(\d{3,4})호[^\n]{0,10}?용어의 정의"
INTERNATIONAL = r"(?U)(?<![-\w])(IFRS|IAS|IFRIC|SIC)\s*(\d{1,2})\b" + NAME_AND_PARA + ")?"
INTERNATIONAL_PREFIX = {"IFRS": "11", "IAS": "10", "IFRIC": "21", "SIC": "20"}
WIDEST_RANGE = 50


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used; a lambda's body is evaluated expression by expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_ref(text: Column) -> Column:
    """Quotation marks of all kinds become ', wide and no-break spaces a space."""
    return F.translate(text, QUOTES_FROM, QUOTES_TO)


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"(?U)\s+", " "), r"^ | $", "")


LABEL = r"(?U)^(.*?)(\d+)(\D*)$"


def split_label(label: Column) -> Column:
    """(prefix, n, tail) around the last run of digits; n is null without one."""
    return F.struct(
        F.regexp_extract(label, LABEL, 1).alias("prefix"),
        F.nullif(F.regexp_extract(label, LABEL, 2), F.lit("")).cast("bigint").alias("n"),
        F.regexp_extract(label, LABEL, 3).alias("tail"),
    )


def expand_range(first: Column, last: Column) -> Column:
    """All labels of a range of up to WIDEST_RANGE labels with one prefix and tail; else its two ends."""

    def labels(x: Column) -> Column:
        a, b = x["a"], x["b"]
        fits = (a["prefix"] == b["prefix"]) & (a["tail"] == b["tail"]) & (a["n"] <= b["n"]) & (b["n"] - a["n"] + 1 <= WIDEST_RANGE)
        filled = F.transform(F.sequence(a["n"], F.greatest(a["n"], F.least(b["n"], a["n"] + WIDEST_RANGE))), lambda n: F.concat(a["prefix"], n.cast("string"), a["tail"]))
        return F.when(F.coalesce(fits, F.lit(False)), filled).otherwise(F.array(x["first"], x["last"]))

    return bound(F.struct(first.alias("first"), last.alias("last"), split_label(first).alias("a"), split_label(last).alias("b")), labels)


def ref_key(number: Column, para: Column | None = None, name: Column | None = None) -> Column:
    """The key of a standard's paragraph, else of its title, else of the standard."""
    alone = F.concat(F.lit("제"), number, F.lit("호"))
    titled = alone if name is None else F.when(F.coalesce(name, F.lit("")) != "", F.concat(alone, F.lit(" '"), clean_name(name), F.lit("'"))).otherwise(alone)
    return titled if para is None else F.when(F.coalesce(para, F.lit("")) != "", F.concat(alone, F.lit(" 문단 "), para)).otherwise(titled)


def chapter_para(chapter: Column, para: Column) -> Column:
    """A short paragraph label gets its chapter in front; full and ambiguous ones stay."""
    no = chapter.cast("int").cast("string")
    short = ~F.contains(para, F.lit(".")) & para.rlike(r"(?U)^\d+(?:[A-Z]|[⑴-⒇])*$")
    return F.when(short, F.concat(no, F.lit("."), para)).otherwise(para)


def chapter_key(chapter: Column, para: Column | None = None, name: Column | None = None) -> Column:
    alone = F.concat(F.lit("제"), chapter.cast("int").cast("string"), F.lit("장"))
    titled = alone if name is None else F.when(F.coalesce(name, F.lit("")) != "", F.concat(alone, F.lit(" '"), clean_name(name), F.lit("'"))).otherwise(alone)
    if para is None:
        return titled
    return F.when(F.coalesce(para, F.lit("")) != "", F.concat(alone, F.lit(" 문단 "), chapter_para(chapter, para))).otherwise(titled)


def section_key(number: Column) -> Column:
    return F.concat(F.lit("제"), number, F.lit("호 용어의 정의"))


def term_key(number: Column, term: Column) -> Column:
    return F.concat(section_key(number), F.lit(":"), clean_name(normalize_ref(term)))


_MARK = "\u0001"


def _matches(text: Column, pattern: str, n: int, use) -> Column:
    """use(struct of g1..gn) of each match, one list; a group that took no part is ''.

    The text is searched once. Groups are read from each match alone, where the pattern takes the same way as in the text: it
    looks at nothing behind a match but the end of a number, which the end of the match is too.
    """
    # one search of a match gives all its groups: they are put behind a mark each, and there is no mark in what is searched
    marked = "".join(f"{_MARK}${i}" for i in range(1, n + 1))
    split = lambda m: F.split(F.regexp_replace(m, pattern, marked), _MARK)
    by_search = lambda m: F.struct(*(F.regexp_extract(m, pattern, i).alias(f"g{i}") for i in range(1, n + 1)))
    by_mark = lambda m: bound(split(m), lambda a: F.struct(*(F.get(a, F.lit(i)).alias(f"g{i}") for i in range(1, n + 1))))
    groups = lambda m: F.when(F.contains(m, F.lit(_MARK)), by_search(m)).otherwise(by_mark(m))
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: bound(groups(m), use)))


def _keys(m: Column, key) -> Column:
    """Keys of one match (number, name, paragraph, more paragraphs): title, paragraph, range and list, or the standard alone."""
    no, name, para, more = m["g1"], m["g2"], m["g3"], m["g4"]
    empty = F.array().cast("array<string>")
    last = F.regexp_extract(more, r"(?U)^\s*[~∼]\s*(" + PARA + ")", 1)
    listed = F.regexp_extract_all(more, F.lit(r"(?U)[,，]\s*문단\s*(" + PARA + ")"), F.lit(1))
    ranged = F.when(more != "", bound(last, lambda x: F.when(x != "", expand_range(para, x)).otherwise(empty))).otherwise(empty)
    paras = F.when(para != "", F.concat(F.array(para), ranged, F.when(more != "", listed).otherwise(empty))).otherwise(empty)
    title = F.when(name != "", F.array(key(no, None, name))).otherwise(empty)
    alone = F.when((name == "") & (para == ""), F.array(key(no, None, None))).otherwise(empty)
    return F.concat(title, F.transform(paras, lambda p: key(no, p, None)), alone)


def extract_refs(*texts: Column) -> Column:
    """Distinct keys in order: of each text all standards, then term sections, then chapters. Null and empty texts have none.

    A text is normalised once, and searched only for what its plain characters leave possible.
    """
    empty = F.array().cast("array<string>")

    def found(t: Column) -> Column:
        standards = F.when(F.contains(t, F.lit("호")), _matches(t, STANDARD, 4, lambda m: _keys(m, ref_key))).otherwise(empty)
        terms = F.when(F.contains(t, F.lit("용어의 정의")), F.transform(F.regexp_extract_all(t, F.lit(TERM_SECTION), F.lit(1)), section_key)).otherwise(empty)
        chapters = F.when(F.contains(t, F.lit("장")), _matches(t, CHAPTER, 4, lambda m: _keys(m, chapter_key))).otherwise(empty)
        return F.concat(standards, terms, chapters)

    parts = [bound(normalize_ref(F.coalesce(text, F.lit(""))), found) for text in texts]
    return F.array_distinct(F.concat(*parts))


def international_number(kind: Column, number: Column) -> Column:
    prefix = F.element_at(F.create_map(*(F.lit(x) for kv in INTERNATIONAL_PREFIX.items() for x in kv)), kind)
    return F.concat(prefix, F.lpad(number.cast("int").cast("string"), 2, "0"))


def extract_international(*texts: Column) -> Column:
    """Distinct keys of citations in international notation, mapped to national numbers; no ranges and lists."""
    empty = F.array().cast("array<string>")

    def keys(m: Column) -> Column:
        no, name, para = international_number(m["g1"], m["g2"]), m["g3"], m["g4"]
        return F.concat(
            F.when(name != "", F.array(ref_key(no, None, name))).otherwise(empty),
            F.when(para != "", F.array(ref_key(no, para))).otherwise(empty),
            F.when((name == "") & (para == ""), F.array(ref_key(no))).otherwise(empty),
        )

    parts = [_matches(normalize_ref(F.coalesce(t, F.lit(""))), INTERNATIONAL, 4, keys) for t in texts]
    return F.array_distinct(F.concat(*parts))


def all_refs(meta: Column, question: Column, answer: Column, related: Column, body: Column) -> Column:
    """National keys of a record's parts (of its body only without a question), then unseen international ones."""
    parts = [meta, question, answer, related, F.when(question.isNull(), body)]
    return F.array_distinct(F.concat(extract_refs(*parts), extract_international(*parts)))


def standard_of(key: Column) -> Column:
    """The leading standard or chapter of a key; null without one."""
    return bound(F.regexp_extract(key, r"(?U)^(제\d+[호장])", 1), lambda x: F.when(x != "", x))


# Kinds of citations in the order in which they are tried, with their patterns.
KINDS = (
    ("장문단", r"^제\d{1,2}장.*문단"),
    ("장제목", r"^제\d{1,2}장.*'"),
    ("단독장", r"^제\d{1,2}장"),
    ("용어섹션", r"^제\d{3,4}호.*용어의 정의$"),
    ("문단", r"^제\d{3,4}호.*문단"),
    ("제목", r"^제\d{3,4}호.*'"),
    ("단독호", r"^제\d{3,4}호"),
)
PRECISE = ("장문단", "용어섹션", "문단")


def kind_of(key: Column) -> Column:
    """The first kind whose pattern fits; chapters, standards and other keys are told apart first."""
    kinds = dict(KINDS)

    def among(*names: str) -> Column:
        out = F.lit(names[-1])
        for name in reversed(names[:-1]):
            out = F.when(key.rlike(kinds[name]), F.lit(name)).otherwise(out)
        return out

    names = [name for name, _ in KINDS]
    at = names.index("단독장") + 1
    chapter, standard = key.rlike(kinds["단독장"]), key.rlike(kinds["단독호"])
    return F.when(chapter, among(*names[:at])).when(standard, among(*names[at:])).otherwise("기타")


def is_precise(kind: Column) -> Column:
    return kind.isin(*PRECISE)
