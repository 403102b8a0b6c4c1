"""Web pages: list rows, page counts and links as expressions; trees as text by a streaming parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Calls that list pages make.
DETAIL_CALL = r"fn_Detail\('(\d+)','(\d+)'\)"
PAGE_CALL = r"G_MovePage\((\d+)\)"
DOWNLOAD_CALL = r"fileDownload\('(-?\d+)','(\d+)'\)"
BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 br title section article ul ol table".split())


def last_page(html: Column) -> Column:
    """The largest page number called, 1 without any."""
    calls = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(PAGE_CALL), F.lit(1))
    return F.coalesce(F.array_max(F.transform(calls, lambda x: x.cast("int"))), F.lit(1))


def links(html: Column) -> Column:
    """array<struct<href, text>> of anchors with an href, tags inside the text removed."""
    pattern = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    h = F.coalesce(html, F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(h, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(h, F.lit(pattern), F.lit(2)).alias("text"))
    return F.transform(both, lambda x: F.struct(x["href"].alias("href"), F.trim(F.regexp_replace(x["text"], r"<[^>]*>", "")).alias("text")))


def list_rows(pages: DataFrame, board: str, order: tuple[int, int] = (1, 2)) -> DataFrame:
    """seq, title, reply_date, open_date of the list rows of a board; other boards' pinned rows go.

    order: which argument of the call is the row's number and which the board's (standards lists have them the other way round).
    Dates are the fourth and fifth cell, empty if there are fewer.
    """
    rows = pages.select(F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("tr"))
    cell = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), plain)
    title = plain(F.regexp_extract("tr", r"(?is)<a[^>]*" + DETAIL_CALL + r"[^>]*>(.*?)</a>", 3))
    rows = rows.select("*", cell.alias("td"), title.alias("title"), *(F.regexp_extract("tr", DETAIL_CALL, i).alias(n) for i, n in zip(order, ("seq", "ctg"), strict=True)))
    date = lambda i: F.coalesce(F.get("td", F.lit(i)), F.lit(""))
    return rows.where(F.col("ctg") == board).select("seq", "title", date(3).alias("reply_date"), date(4).alias("open_date"))


def standard_rows(pages: DataFrame, board: str) -> DataFrame:
    """seq, title and attachments (file_no, file_seq, name) of a standards list, whose calls name the board first."""
    rows = pages.select(F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("tr"))
    file = r"(?is)<a[^>]*" + DOWNLOAD_CALL + r"[^>]*>(.*?)</a>"
    files = F.arrays_zip(*(F.regexp_extract_all("tr", F.lit(file), F.lit(i)).alias(n) for i, n in enumerate(("file_no", "file_seq", "raw"), 1)))
    named = F.transform(files, lambda f: F.struct(f["file_no"].alias("file_no"), f["file_seq"].alias("file_seq"), plain(f["raw"]).alias("name")))
    title = plain(F.regexp_extract("tr", r"(?is)<a[^>]*" + DETAIL_CALL + r"[^>]*>(.*?)</a>", 3))
    rows = rows.select(F.regexp_extract("tr", DETAIL_CALL, 1).alias("ctg"), F.regexp_extract("tr", DETAIL_CALL, 2).alias("seq"), title.alias("title"), F.filter(named, lambda f: f["name"] != "").alias("attachments"))
    return rows.where(F.col("ctg") == board).drop("ctg")


def plain(html: Column) -> Column:
    """Tags out, blanks in a row as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))


class _Text(HTMLParser):
    """Paragraphs one per line, table rows one per line with " | " between cells, inner tables inside their cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.tables: list[list[list[list[str]]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append([])
        elif tag in BLOCKS:
            self.put("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.tables:
            rows = [[" ".join("".join(c).split(" ")) for c in row] for row in self.tables.pop()]
            rows = [[re.sub(r"[^\S\x00]+", " ", c).strip() for c in row] for row in rows]
            self.put("\x00" + "\x00".join(" | ".join(r) for r in rows if any(r)) + "\x00")
        elif tag in BLOCKS:
            self.put("\n")

    def put(self, text: str) -> None:
        if self.tables and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1].append(text)
        else:
            self.out.append(text)

    def handle_data(self, data):
        if not self.skip:
            self.put(data)

    def text(self) -> str:
        while self.tables:
            self.handle_endtag("table")
        lines = (" ".join(x.split()) for x in "".join(self.out).replace("\x00", "\n").split("\n"))
        return "\n".join(x for x in lines if x)


def to_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    return p.text()


def html_text(html: Column) -> Column:
    """Text of a page with one line per block and per table row; null becomes empty."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(to_text)

    return F.pandas_udf(run, "string")(html)


class _Detail(HTMLParser):
    """Header cells with the cells beside them, downloads, and the text of the content block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.files: list[dict] = []
        self.body: list[str] = []
        self.depth = self.th = self.td = 0
        self.key, self.value, self.name = "", [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "div" and (self.depth or "board_view_cont" in (a.get("class") or "")):
            self.depth += 1
        if tag == "th":
            self.th, self.key = 1, ""
        elif tag == "td" and self.key:
            self.td, self.value = 1, []
        elif tag == "a" and (m := re.search(DOWNLOAD_CALL, a.get("onclick") or "")):
            self.name = {"file_no": m[1], "file_seq": m[2], "name": ""}

    def handle_endtag(self, tag):
        if tag == "div" and self.depth:
            self.depth -= 1
        elif tag == "th":
            self.th = 0
        elif tag == "td" and self.td:
            self.meta[self.key.strip()] = " ".join(x for x in (v.strip() for v in self.value) if x)
            self.td, self.key = 0, ""
        elif tag == "a" and self.name:
            self.files.append(self.name | {"name": self.name["name"].strip()})
            self.name = None

    def handle_data(self, data):
        if self.th:
            self.key += data
        elif self.td:
            self.value.append(data)
        if self.name is not None:
            self.name["name"] += data
        if self.depth and data.strip():
            self.body.append(data.strip())


def parse_detail(html: str | None, footer: tuple[str, ...] = ()) -> dict:
    """meta, attachments and body of a page; the body ends at the disclaimer, and at the first footer found beyond 40 % of it."""
    p = _Detail()
    p.feed(html or "")
    body = "\n".join(p.body)
    if m := re.search(r"[‘']신속처리질의[’']\s*는", body):
        body = body[: m.start()].rstrip()
    for pattern in footer:
        m = re.search(pattern, body, re.M)
        if m and m.start() > 0.4 * len(body):
            body = body[: m.start()].rstrip()
            break
    return {"meta": p.meta, "attachments": p.files, "body": body}


DETAIL = "meta map<string,string>, attachments array<struct<file_no:string,file_seq:string,name:string>>, body string"


def details(pages: DataFrame, footer: tuple[str, ...] = ()) -> DataFrame:
    """page_id and the parsed parts of each page."""

    def run(frames):
        for f in frames:
            d = [parse_detail(h, footer) for h in f.html]
            yield pd.DataFrame({"page_id": f.page_id, "meta": [x["meta"] for x in d], "attachments": [x["attachments"] for x in d], "body": [x["body"] for x in d]})

    return pages.select("page_id", "html").mapInPandas(run, f"page_id long, {DETAIL}")


def detail_url(base: Column, board: Column, seq: Column) -> Column:
    return F.concat(base, F.lit("?board="), F.url_encode(board), F.lit("&seq="), F.url_encode(seq))
