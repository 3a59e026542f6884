"""Web pages: title, dates, links and main content as Markdown, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIPPED = {"script", "style", "iframe", "form", "noscript", "svg", "nav", "footer", "aside", "button"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}
_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "figure", "header", "body"}


class _Page(HTMLParser):
    """Markdown of the body and of its main element, if it has one; meta values; links of the body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.skip, self.main, self.span, self.title, self.href = 0, 0, None, None, []
        self.lists: list[int | None] = []
        self.pre = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := a.get("property") or a.get("name")):
            self.meta.setdefault(name.lower(), a.get("content", ""))
        if tag == "title" and self.title is None:
            self.title = ""
        if tag in _SKIPPED or self.skip:
            self.skip += tag not in _VOID
            return
        if tag in ("main", "article"):
            if not self.main and self.span is None:
                self.span = [len(self.out), None]
            self.main += 1
        if re.fullmatch("h[1-6]", tag):
            self.out.append(f"\n\n{'#' * int(tag[1])} ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self.out.append("\n")
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            mark = f"{self.lists[-1]}." if self.lists and self.lists[-1] else "-"
            self.out.append(f"\n{'  ' * max(0, len(self.lists) - 1)}{mark} ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.href.append(a.get("href", ""))
            if a.get("href"):
                self.links.append(a["href"])
                self.out.append("[")
        elif tag in _BLOCK:
            self.out.append("\n\n" if tag != "tr" else "\n")

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= tag not in _VOID
            return
        if tag in ("main", "article") and self.main:
            self.main -= 1
            if not self.main and self.span and self.span[1] is None:
                self.span[1] = len(self.out)
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.href and (href := self.href.pop()):
            self.out.append(f"]({href})")
        elif tag == "tr":
            self.out.append(" |")
        elif tag in _BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.title == "" and not self.out:
            self.title = data.strip()
        elif not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))

    def markdown(self) -> str:
        start, end = self.span or (0, None)
        text = re.sub(r"[ \t]+\n", "\n", "".join(self.out[start:end]))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+(?=[^\s|\-0-9])", "\n", text)).strip()


def parse_page(html: str) -> tuple:
    """(title, description, author, published_at, updated_at, markdown, links): each by a chain of fallbacks."""
    page = _Page()
    page.feed(html)
    page.close()
    body = page.markdown()
    first = lambda *names: next((page.meta[n].strip() for n in names if page.meta.get(n, "").strip()), None)
    heading = re.search(r"(?m)^#\s+(.+)$", body)
    dates = re.findall(r"\b\d{2}/\d{2}/\d{4}\b", body)
    title = heading.group(1).strip() if heading else first("og:title") or page.title or None
    return title, first("description", "og:description"), first("author", "article:author"), first("article:published_time") or (dates[0] if dates else None), first("article:modified_time", "og:updated_time"), body, list(dict.fromkeys(page.links))


_PAGE = "title string, description string, author string, published_at string, updated_at string, markdown string, links array<string>"


def articles_of(pages: DataFrame, url: str = "url", html: str = "html", min_words: int = 300) -> DataFrame:
    """A row a page with a title and at least ``min_words`` words: its url, the parsed fields and up to 30 links to its own host.

    Null html has no row; broken markup is read as far as it makes sense, and repeated rows stay.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_page(x) for x in batch], columns=[f.split()[0] for f in _PAGE.split(", ")])

    parsed = pages.filter(F.col(html).isNotNull()).select(F.col(url).alias("url"), F.pandas_udf(run, _PAGE)(F.col(html)).alias("p")).select("url", "p.*")
    host = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    whole = F.transform("links", lambda x: F.when(x.startswith("/"), F.concat(host, x)).otherwise(x))
    own = F.slice(F.array_distinct(F.filter(whole, lambda x: x.startswith(host) & (host != ""))), 1, 30)
    words = F.size(F.filter(F.split("markdown", r"\s+"), lambda w: w != ""))
    return parsed.filter((F.coalesce("title", F.lit("")) != "") & (words >= min_words)).withColumn("related_links", own).drop("links")
