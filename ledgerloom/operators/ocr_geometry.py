"""Pages rebuilt from boxes of recognised text: pieces mended, rows by vertical distance, numbers joined, runs of table and text rows, columns by right edges, wrapped labels joined.

Rows and columns are clusters with a running mean, which depends on order, so a page is one group; it
holds the boxes of one page, a few hundred, whatever the data's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.markdown import grid
from ledgerloom.operators.blocks import once
from ledgerloom.tables import table

# Distances in points of rows, columns, and pieces of one number; the label column ends so far left of the numbers.
ROW_GAP, COLUMN_GAP, JOIN_GAP, LABEL_GAP = 14.0, 35.0, 35.0, 10.0
# What numbers, notes, headings and heads of columns look like on a statement page.
GROUPED = regex.compile(r"\d{1,3}(?:\.\d{3})+")
LARGE = regex.compile(r"\d{1,3}(?:\.\d{3}){2,}|\(\d{1,3}(?:\.\d{3})+\)")
MAJOR = regex.compile(r"\b\d{1,3}(?:\.\d{3}){2,}\b")
BRACKETED = regex.compile(r"\(\d+")
DASHES = {"-", "--", "( - )", "—"}
MONEY = {"VND", "USD", "%"}
NOTE = regex.compile(r"^(?:\(\d+\)|\(\*\)|\*|Ghi chú:|Note:)\s+", regex.I)
ASIDE = regex.compile(r"^(?:Trong đó:|Chi tiết:)\s+", regex.I)
PERIOD = regex.compile(r"31/12|1/1|\b20\d\d\b|Cuối năm|Đầu năm|Kỳ này|Kỳ trước", regex.I)
NUMBERED = regex.compile(r"^(?:[IVX|]+|\d+)\.\s+")
HEAD, TAIL = regex.compile(r"^\(?\d{1,3}(?:\.\d{3})*\.?$"), regex.compile(r"^\d{3}(?:\.\d{3})*\)?$")
SEVERAL = regex.compile(r"\(?\d{1,3}(?:\.\d{3})+\)?")
ITEM = "doc_id string, page string, x0 double, y0 double, x1 double, y1 double, text string"


def clusters(values: list[float], gap: float) -> list[int]:
    """The cluster of each value: in order, a value joins the cluster whose running mean is within the gap."""
    order = sorted(range(len(values)), key=lambda k: values[k])
    out, mean, n, c = [0] * len(values), 0.0, 0, -1
    for k in order:
        if n and abs(values[k] - mean) <= gap:
            n += 1
            mean += (values[k] - mean) / n
        else:
            c, mean, n = c + 1, values[k], 1
        out[k] = c
    return out


class Box(NamedTuple):
    x0: float
    x1: float
    y: float
    text: str

    @property
    def figure(self) -> bool:
        """Whether it is a figure of a statement: a number in groups, one in a bracket, or a dash."""
        return bool(GROUPED.search(self.text) or BRACKETED.search(self.text)) or self.text in DASHES


def pieces(items: pd.DataFrame) -> list[Box]:
    """The boxes of a page, mended: no stray closing brackets, blanks within numbers as dots; a box that holds several long numbers is cut into as many, of equal width."""
    out = []
    for r in items.dropna(subset=["x0", "x1", "y0", "y1", "text"]).itertuples(index=False):
        text = regex.sub(r"^\)+", "", r.text.strip())
        text = regex.sub(r"\)+(\(?[\d.]+\)?)", r"\1", text)
        text = regex.sub(r"(?<=\d)\s+(?=\d{3}(?:\.|\b))", ".", text)
        numbers = SEVERAL.findall(text)
        several = numbers if len(numbers) > 1 and len(text) > 20 else [text]
        width = (r.x1 - r.x0) / len(several)
        out += [Box(r.x0 + k * width, r.x0 + (k + 1) * width, (r.y0 + r.y1) / 2, t) for k, t in enumerate(several) if t]
    return out


def joined(row: list[Box]) -> list[Box]:
    """A row from the left, with pieces of one number joined that are less than JOIN_GAP apart."""
    out: list[Box] = []
    for b in row:
        last = out[-1] if out else None
        if last and HEAD.match(last.text) and TAIL.match(b.text) and b.x0 - last.x1 < JOIN_GAP:
            out[-1] = last._replace(x1=b.x1, text=last.text + ("" if last.text.endswith(".") else ".") + b.text)
        else:
            out.append(b)
    return out


def rows_of(boxes: list[Box]) -> list[list[Box]]:
    """Boxes as rows from the top."""
    row = clusters([b.y for b in boxes], ROW_GAP)
    order = sorted(zip(row, boxes, strict=True), key=lambda x: (x[0], x[1].x0, x[1].text))
    return [joined([b for _, b in g]) for _, g in groupby(order, key=lambda x: x[0])]


def is_table_row(row: list[Box]) -> bool:
    """Whether a row belongs to a table: no note or long prose, and a figure, or two boxes with a currency or a period, or three with any number."""
    text = " ".join(b.text for b in row)
    if NOTE.match(text) or ASIDE.match(text) or (len(text) > 55 and not any(MAJOR.search(b.text) for b in row)):
        return False
    money = any(b.text in MONEY for b in row)
    several = len(row) > 1 and (money or any(PERIOD.search(b.text) for b in row))
    return any(b.figure for b in row) or several or (len(row) > 2 and (money or any(regex.search(r"\d", b.text) for b in row)))


def segments(rows: list[list[Box]]) -> Iterator[tuple[str, list[list[Box]]]]:
    """Runs of rows of one kind, from the top; a table of one row, or with fewer than two figures, is text."""
    for table_, run in groupby(rows, key=is_table_row):
        run = list(run)
        yield ("table" if table_ and len(run) > 1 and sum(b.figure for r in run for b in r) > 1 else "text"), run


def table_of(rows: list[list[Box]]) -> tuple[list[str], list[list[str]], list[str]]:
    """(heads, cells, notes) of the rows of a table: figures go to the column whose right edge is nearest, the rest is the label."""
    figures = [b for r in rows for b in r if b.figure]
    left = min(b.x0 for b in figures)
    column = clusters([b.x1 for b in figures], COLUMN_GAP)
    edges = [sum(x) / len(x) for x in ([b.x1 for b, c in zip(figures, column, strict=True) if c == k] for k in range(max(column) + 1))]
    nearest = lambda b: min(range(len(edges)), key=lambda k: abs(b.x1 - edges[k]))
    first = next((k for k, r in enumerate(rows) if any(LARGE.search(b.text) for b in r)), 0)
    heads = ["Khoản mục / Chỉ tiêu"] + [""] * len(edges)
    for b in (b for r in rows[:first] for b in r if b.x1 >= left - 2 * LABEL_GAP and len(b.text) < 45):
        k = 1 + min(range(len(edges)), key=lambda k: min(abs(b.x1 - edges[k]), abs((b.x0 + b.x1) / 2 - (edges[k] - 40))))
        heads[k] = f"{heads[k]} {b.text}".strip()
    heads = [h or f"Cột {k}" for k, h in enumerate(heads)]
    cells: list[list[str]] = []
    notes: list[str] = []
    for r in rows[first:]:
        text = " ".join(b.text for b in r)
        if cells and NOTE.match(text):
            notes.append(text)
            continue
        line = [""] * (1 + len(edges))
        for b in r:
            k = 1 + nearest(b) if (GROUPED.search(b.text) or b.text in DASHES) and b.x0 >= left - LABEL_GAP else 0
            line[k] = f"{line[k]} {b.text}".strip()
        cells.append(line)
    return heads, wrapped(cells), notes


def wrapped(cells: list[list[str]]) -> list[list[str]]:
    """Rows with labels that run over several rows joined: a row of a label alone goes to the row before it, or, at the beginning, to the one after; numbered headings keep their row."""
    out: list[list[str]] = []
    for row in cells:
        bare = lambda r: not any(r[1:])
        if bare(row) and row[0] and not NUMBERED.match(row[0]) and out:
            out[-1] = [f"{out[-1][0]} {row[0]}".strip(), *out[-1][1:]]
            continue
        if not bare(row) and out and bare(out[-1]) and not NUMBERED.match(out[-1][0]):
            row = [f"{out.pop()[0]} {row[0]}".strip(), *row[1:]]
        out.append(row)
    return out


def markdown(heads: list[str], cells: list[list[str]], notes: list[str]) -> str:
    lines = [heads, ["---"] * len(heads), *cells]
    return "\n".join(["| " + " | ".join(r) + " |" for r in lines] + (["", *(f"*{n}*" for n in notes)] if notes else []))


PAGE_BLOCKS = "doc_id string, page string, seq int, block_type string, rows int, cols int, content string"


def page_blocks(items: DataFrame) -> DataFrame:
    """(doc_id, page, seq, block_type, rows, cols, content): the text and table blocks of each page of boxes, from the top. Boxes without text or a corner are left out; text under ten characters gives no block."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, rows in segments(rows_of(pieces(pdf))):
            if kind == "table":
                heads, cells, notes = table_of(rows)
                out.append((kind, len(cells), len(heads), markdown(heads, cells, notes)))
            else:
                text = "\n".join(" ".join(b.text for b in r) for r in rows).strip()
                if len(text) >= 10:
                    out.append((kind, None, None, text))
        columns = [c.split()[0] for c in PAGE_BLOCKS.split(", ")]
        return pd.DataFrame([(pdf.doc_id.iloc[0], pdf.page.iloc[0], k, *r) for k, r in enumerate(out)], columns=columns).astype({"rows": "Int32", "cols": "Int32"})

    return items.select(*[c.split()[0] for c in ITEM.split(", ")]).groupBy("doc_id", "page").applyInPandas(page, PAGE_BLOCKS)


def page_grid(items: pd.DataFrame) -> list[list[str]]:
    """The grid of all boxes of a page, whatever they hold."""
    rows = rows_of(pieces(items))
    if not rows:
        return []
    columns = iter(clusters([b.x1 for r in rows for b in r], COLUMN_GAP))
    placed = [[(next(columns), b.text) for b in r] for r in rows]
    width = max(c for r in placed for c, _ in r) + 1
    return [[" ".join(t for c, t in r if c == k) for k in range(width)] for r in placed]


def rebuilt(items: DataFrame) -> DataFrame:
    """(doc_id, page, rows, cols, content): one Markdown table for each page of boxes, for pages known to be tables."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = page_grid(pdf)
        content = [[pdf.doc_id.iloc[0], pdf.page.iloc[0], len(cells), len(cells[0]), markdown(cells[0], cells[1:], [])]] if cells else []
        return pd.DataFrame(content, columns=["doc_id", "page", "rows", "cols", "content"])

    return items.select(*[c.split()[0] for c in ITEM.split(", ")]).groupBy("doc_id", "page").applyInPandas(page, "doc_id string, page string, rows int, cols int, content string")


def routed(items: DataFrame, smallest: float = 8.0) -> DataFrame:
    """Items large enough to read, with `numeric`: whether the detector's text stays (figures, dashes, currencies) or the box is to be recognised again."""
    t = F.trim("text")
    large = (F.col("x1") - F.col("x0") >= smallest) & (F.col("y1") - F.col("y0") >= smallest)
    numeric = t.rlike(GROUPED.pattern) | t.rlike(BRACKETED.pattern) | t.isin(sorted(DASHES | {"VND", "USD"}))
    return items.where(large).withColumn("numeric", F.coalesce(numeric, F.lit(False)))


def is_landscape(items: DataFrame) -> DataFrame:
    """(doc_id, page, landscape): over 15 upright boxes, and more than twice the level ones."""
    tall = (F.col("y1") - F.col("y0")) > 1.5 * (F.col("x1") - F.col("x0"))
    return items.groupBy("doc_id", "page").agg(F.count_if(tall).alias("_t"), F.count_if(~tall).alias("_f")).select("doc_id", "page", ((F.col("_t") > 15) & (F.col("_t") > 2 * F.col("_f"))).alias("landscape"))


def boxes_of_tables(blocks: DataFrame) -> DataFrame:
    """Boxes as a reader would give them for the cells of table blocks: right edges a column apart, lines 20 points apart, one page per block."""
    cells = blocks.select("doc_id", F.col("block_id").alias("page"), F.posexplode(grid(F.col("content"))).alias("r", "c")).select("doc_id", "page", "r", F.posexplode("c").alias("k", "text"))
    right = 300.0 + 150.0 * F.col("k")
    return cells.where("text <> ''").select("doc_id", "page", (right - F.least(F.lit(140.0), 4.0 * F.length("text"))).alias("x0"), (20.0 * F.col("r")).alias("y0"), right.alias("x1"), (20.0 * F.col("r") + 12).alias("y1"), "text")


def tables_from_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Table blocks taken apart into boxes and rebuilt: whether every cell is back in its place."""
    b = once(table(spark, d, "blocks")).where("block_type = 'table' and content is not null")
    full = b.select("doc_id", F.col("block_id").alias("page"), grid(F.col("content")).alias("_g"))
    out = rebuilt(boxes_of_tables(b))
    return out.join(full, ["doc_id", "page"]).select("doc_id", F.col("page").alias("block_id"), "rows", "cols", (grid(F.col("content")) == F.col("_g")).alias("same"))


def boxes_of_pages(blocks: DataFrame) -> DataFrame:
    """Boxes for whole pages: a table block's cells as in boxes_of_tables, a text block's lines a row each, one block under the other."""
    b = blocks.where("content is not null and trim(content) <> ''").withColumn("_lines", F.when(F.col("block_type") == "table", grid(F.col("content"))).otherwise(F.transform(F.split("content", "\n"), lambda x: F.array(x))))
    above = W.partitionBy("doc_id", "page").orderBy("seq", "block_id").rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("_top", F.coalesce(F.sum(F.size("_lines") + 2).over(above), F.lit(0)))
    cells = b.select("doc_id", F.col("page").cast("string").alias("page"), "block_type", "_top", F.posexplode("_lines").alias("r", "c")).select("doc_id", "page", "block_type", (F.col("_top") + F.col("r")).alias("r"), F.posexplode("c").alias("k", "text")).where("trim(text) <> ''")
    wide = F.least(F.lit(140.0), 4.0 * F.length("text"))
    right = F.when(F.col("block_type") == "table", 300.0 + 150.0 * F.col("k")).otherwise(160.0 + wide)
    return cells.select("doc_id", "page", (right - wide).alias("x0"), (20.0 * F.col("r")).alias("y0"), right.alias("x1"), (20.0 * F.col("r") + 12).alias("y1"), "text")


def blocks_from_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Pages of blocks taken apart into boxes and rebuilt: text and table blocks of each page, their rows and characters."""
    made = page_blocks(boxes_of_pages(once(table(spark, d, "blocks"))))
    return made.groupBy("doc_id", "page").agg(F.count_if(F.col("block_type") == "table").alias("tables"), F.count_if(F.col("block_type") == "text").alias("texts"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum(F.length("content")).alias("characters"))


def routed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Cells of table blocks as boxes: by column, how many keep the detector's text and how many are to be recognised again."""
    b = once(table(spark, d, "blocks")).where("block_type = 'table' and content is not null")
    return routed(boxes_of_tables(b)).groupBy("x1").agg(F.count("*").alias("boxes"), F.count_if("numeric").alias("numeric"))


QUERIES = {f.__name__: f for f in (tables_from_boxes, blocks_from_boxes, routed_boxes)}
