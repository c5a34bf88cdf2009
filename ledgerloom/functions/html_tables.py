"""HTML tables as grids and logical schemas, and back; an Arrow function over the standard library's parser."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

GRIDS = "array<struct<rows:int,cols:int,spans:array<array<int>>,header_rows:int,cells:array<array<string>>>>"


class _Reader(HTMLParser):
    """Rows of cells with their spans; a cell or row left open ends with the next."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open = self.cell = False
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
            self.open = True
        elif self.open and tag == "tr":
            self.tables[-1].append([])
            self.cell = False
        elif self.open and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            a = dict(attrs)
            # The standard's bound on spans.
            size = lambda x: max(1, min(1000, int(x))) if str(x or "").isdigit() else 1
            self.tables[-1][-1].append(["", size(a.get("rowspan")), size(a.get("colspan")), tag == "th"])
            self.cell = True
        elif self.cell and tag == "br":
            self.tables[-1][-1][-1][0] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.open = self.cell = False
        elif tag in ("td", "th", "tr"):
            self.cell = False

    def handle_data(self, data: str) -> None:
        if self.open and self.cell:
            self.tables[-1][-1][-1][0] += data


def grids(text: str | None) -> list[dict]:
    """The tables of an HTML text: rows, columns, merged areas (r1, c1, r2, c2), header rows, and rectangular cells; a merged cell's text fills its area."""
    if not text or "<t" not in text.lower():
        return []
    reader = _Reader()
    reader.feed(text)
    reader.close()
    out = []
    for rows in reader.tables:
        taken: dict[tuple[int, int], str] = {}
        spans, heads, width = [], 0, 0
        for r, row in enumerate(rows):
            c = 0
            for words, down, across, _ in row:
                while (r, c) in taken:
                    c += 1
                down = min(down, len(rows) - r)
                for i in range(down):
                    for j in range(across):
                        taken[r + i, c + j] = " ".join(words.split())
                if down > 1 or across > 1:
                    spans.append([r, c, r + down - 1, c + across - 1])
                c += across
            width = max([width, *(k + 1 for (i, k) in taken if i == r)])
            heads += r == heads and bool(row) and all(h for *_, h in row)
        out.append({"rows": len(rows), "cols": width, "spans": sorted(spans), "header_rows": heads, "cells": [[taken.get((r, c), "") for c in range(width)] for r in range(len(rows))]})
    return out


def html_grids(c: Column) -> Column:
    """The tables of an HTML text as an array of grids; empty without any, null for null."""
    kind = pa.list_(pa.struct([("rows", pa.int32()), ("cols", pa.int32()), ("spans", pa.list_(pa.list_(pa.int32()))), ("header_rows", pa.int32()), ("cells", pa.list_(pa.list_(pa.string())))]))

    @F.arrow_udf(GRIDS)
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else grids(t) for t in texts.to_pylist()], type=kind)

    has = F.lower(c).contains("<table")
    return F.when(has, read(F.when(has, c))).when(c.isNotNull(), F.array().cast(GRIDS))


def to_html(schema: dict) -> str:
    """A minimal HTML table of a logical schema: a cell per place that no merged area covers."""
    covered = {(r, c) for r1, c1, r2, c2 in schema["spans"] for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)} - {(s[0], s[1]) for s in schema["spans"]}
    size = {(s[0], s[1]): (s[2] - s[0] + 1, s[3] - s[1] + 1) for s in schema["spans"]}
    out = []
    for r in range(schema["rows"]):
        tag = "th" if r < schema["header_rows"] else "td"
        cells = []
        for c in range(schema["cols"]):
            if (r, c) not in covered:
                down, across = size.get((r, c), (1, 1))
                words = escape(schema["cells"][r][c]) if schema.get("cells") else ""
                cells.append(f"<{tag}" + f' rowspan="{down}"' * (down > 1) + f' colspan="{across}"' * (across > 1) + f">{words}</{tag}>")
        out.append(f"<tr>{''.join(cells)}</tr>")
    return f"<table>{''.join(out)}</table>"
