"""Web rules: hosts and blocked domains, content types, text and titles of HTML."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernstone.functions.text import one_by_one

#: Social, question and content-farm sites, sorted by name.
BLOCKED = sorted(
    """answerbag blurtit ehow facebook instagram linkedin livestrong medium pinterest quora reddit substack tiktok twitter wikihow youtube""".split()
)
BLOCKED = [f"{name}.com" for name in BLOCKED]
_SKIPPED = set("footer header nav script style".split())
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def host(url: Column) -> Column:
    """Lower case, without one leading ``www.``; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def is_blocked(url: Column, blocked: list[str] = BLOCKED) -> Column:
    """Whether the host is a listed domain or below one; URLs without a host aren't."""
    h = host(url)
    return F.coalesce(h.isin(blocked) | F.exists(F.array(*map(F.lit, blocked)), lambda b: F.endswith(h, F.concat(F.lit("."), b))), F.lit(False)) if blocked else F.lit(False)


def content_type(url: Column, header: Column | None = None) -> Column:
    h = F.lower(header) if header is not None else F.lit("")
    u = F.lower(url)
    out = F.when(F.contains(h, F.lit("pdf")), "application/pdf").when(F.contains(h, F.lit("html")), "text/html").when(F.contains(h, F.lit("json")), "application/json").when(F.contains(h, F.lit("text")), "text/plain")
    return out.when(F.endswith(u, F.lit(".pdf")), "application/pdf").when(F.endswith(u, F.lit(".md")) | F.endswith(u, F.lit(".txt")), "text/plain").otherwise("text/html")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED or self.depth and tag not in _VOID:
            self.depth += tag in _SKIPPED

    def handle_endtag(self, tag):
        if tag in _SKIPPED and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and (t := data.strip()):
            self.parts.append(t)


def html_to_text(html: str | None) -> str | None:
    """The text nodes outside script, style, nav, footer and header, stripped, one a line."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


@F.arrow_udf(StringType())
def html_text(html: pa.Array) -> pa.Array:
    return one_by_one(html, html_to_text, pa.string())


#: A filter over the text and what is made of it would otherwise parse every page once each, in Python workers of their own.
_html_text_once = F.arrow_udf(html_text.func, StringType()).asNondeterministic()


def html_title(html: Column) -> Column:
    """The text of the first title element with entities left as they are; empty where there is none."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


@F.arrow_udf(StringType())
def decoded(text: pa.Array) -> pa.Array:
    return one_by_one(text, lambda t: None if t is None else unescape(t), pa.string())


def main_text(html: Column) -> Column:
    """An approximation of main-content extraction: the text of <article> or <main>, else of <body>, else of all."""
    part = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1)
    article, main, body = part("article"), part("main"), part("body")
    return _html_text_once(F.when(article != "", article).when(main != "", main).when(body != "", body).otherwise(html))


def result_links(html: Column) -> Column:
    """URLs that a page of search results links to: direct ones, or those in the parameter ``uddg``; in order, each once."""
    hrefs = F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+)"'), F.lit(1))
    inner = F.transform(hrefs, lambda h: F.when(F.contains(h, F.lit("uddg=")), F.try_url_decode(F.regexp_extract(h, r"[?&;]uddg=([^&]+)", 1))).when(h.rlike(r"^https?://"), h))
    return F.array_distinct(F.filter(inner, lambda u: u.rlike(r"^https?://")))


def pdf_text(_: Column) -> Column:
    """PDF isn't read."""
    return F.lit("[PDF content is not extracted]")
