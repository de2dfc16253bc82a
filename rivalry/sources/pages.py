"""Structured rows from stored HTML pages and from short texts."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Rows(HTMLParser):
    """Cells of table rows, and items of lists as rows of one cell; script and style are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[int] = []
        self.cell: list[str] | None = None
        self.row: list[str] | None = None
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("table", "ul", "ol"):
            self.tables.append([])
            self.open.append(len(self.tables) - 1)
        elif self.open and tag == "tr":
            self.row = []
        elif self.open and tag in ("td", "th", "li"):
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None and not self.skip:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.open and tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif self.open and tag == "li" and self.cell is not None:
            self.tables[self.open[-1]].append([" ".join("".join(self.cell).split())])
            self.cell = None
        elif self.open and tag == "tr" and self.row is not None:
            self.tables[self.open[-1]].append(self.row)
            self.row = None
        elif self.open and tag in ("table", "ul", "ol"):
            self.open.pop()


def html_table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, table_no, row_no, cells) of every table and list of each page. Null pages have none."""

    def extract(batches):
        for batch in batches:
            out = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                p = _Rows()
                p.feed(html or "")
                out += [(page, i, j, row) for i, t in enumerate(p.tables) for j, row in enumerate(t)]
            yield pd.DataFrame(out, columns=["page_id", "table_no", "row_no", "cells"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInPandas(extract, "page_id long, table_no int, row_no int, cells array<string>")


def commented_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, section_no, kind, number, text): sections that a comment `<!-- kind number -->` heads, up to the next tag's end."""
    pattern = r"<!--\s*(\w+)\s+(\d+)\s*-->\s*<[^>]*>([^<]*)"
    hit = lambda g: F.regexp_extract_all(F.col(html_col), F.lit(pattern), F.lit(g))
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(F.arrays_zip(hit(1).alias("k"), hit(2).alias("n"), hit(3).alias("t"))).alias("section_no", "x"))
    return rows.select("page_id", "section_no", F.col("x.k").alias("kind"), F.col("x.n").cast("long").alias("number"), F.trim("x.t").alias("text"))


def embedded_json(rows: DataFrame, key: str, text_col: str, pattern: str, fields: dict[str, str]) -> DataFrame:
    """Fields (name -> JSON path) of the first JSON object that pattern's group 1 finds in a text; nulls if it isn't JSON."""
    found = F.regexp_extract(F.col(text_col), pattern, 1)
    return rows.select(key, *[F.get_json_object(found, path).alias(n) for n, path in fields.items()])


def text_summary(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """Scores and expected goals from a full-time sentence: "... 2-1 ... xG 1.2-0.7"; nulls where it isn't there."""
    score, xg = r"(\d+)-(\d+)", r"xG\s+(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)"
    get = lambda p, g: F.nullif(F.regexp_extract(F.col(text_col), p, g), F.lit(""))
    return rows.select(
        key, get(score, 1).cast("int").alias("home_score"), get(score, 2).cast("int").alias("away_score"), get(xg, 1).cast("double").alias("home_xg"),
        get(xg, 2).cast("double").alias("away_xg"),
    )
