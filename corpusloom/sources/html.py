"""HTML pages as records: a table function over the standard library's parser, errors as values."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = {"br", "img", "hr", "meta", "link", "input"}


class _Elements(HTMLParser):
    """Text of the wanted elements (by tag or tag.class), outermost first come."""

    def __init__(self, wanted: set[str]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.open, self.out = wanted, [], []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        cls = (dict(attrs).get("class") or "").split()
        hit = next((w for w in (tag, *[f"{tag}.{c}" for c in cls]) if w in self.wanted), None)
        self.open.append((tag, hit, []))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for _, hit, parts in self.open[i:][::-1]:
                    if hit:
                        self.out.append((hit, " ".join("".join(parts).split())))
                del self.open[i:]
                return

    def handle_data(self, data):
        for _, hit, parts in self.open:
            if hit:
                parts.append(data)


def elements(html: str, wanted: list[str]) -> list[tuple[str, str]]:
    """(selector, text) of every wanted element, in closing order."""
    p = _Elements(set(wanted))
    p.feed(html)
    p.close()
    return p.out


def page_records(pages: DataFrame, key: str, html: str, wanted: list[str]) -> DataFrame:
    """(key, elem_idx, selector, text, error): many records per page; a page that fails gives one row with its error."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h in zip(b[key], b[html], strict=True):
                try:
                    out += [(k, i, s, t, None) for i, (s, t) in enumerate(elements(h, wanted))]
                except Exception as e:  # the page's error is its record
                    out.append((k, None, None, None, repr(e)))
            yield pd.DataFrame(out, columns=[key, "elem_idx", "selector", "text", "error"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, elem_idx int, selector string, text string, error string")


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_idx, cells) of HTML tables."""
    tr = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    x = pages.select(key, F.posexplode(tr).alias("row_idx", "tr"))
    cells = F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return x.select(key, "row_idx", F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))).alias("cells"))


def html_to_tagged(html: Column, entities: dict[str, str], drop: list[str] | None = None, sign: str = "▪") -> Column:
    """Body text with entity elements as inline tags: dropped elements go with their text, others are unwrapped, blanks squeezed."""
    c = html
    for t in drop or []:
        c = F.regexp_replace(c, f"(?is)<{t}\\b[^>]*>.*?</{t}>", "")
    for t, name in entities.items():
        c = F.regexp_replace(c, f"(?is)<{t}\\b[^>]*>(.*?)</{t}>", f"\u0001{name}\u0002$1\u0003{name}\u0002")
    c = F.regexp_replace(c, "<[^>]+>", "")
    c = F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    return F.replace(F.replace(F.replace(c, F.lit("\u0001"), F.lit(f"<{sign}")), F.lit("\u0003"), F.lit(f"</{sign}")), F.lit("\u0002"), F.lit(">"))
