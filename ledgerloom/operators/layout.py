"""Geometry and order on pages: paragraphs by gaps, header rows, nearest columns, rows of a concept, contents tables and the titles they announce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.markdown import table_cells
from ledgerloom.functions.numbers import is_numeric, let
from ledgerloom.functions.text import toc_pages, tokens, unaccented
from ledgerloom.operators.blocks import ONCE, once, reading_order
from ledgerloom.operators.sections import clean_title
from ledgerloom.tables import table

# Words of the header row of a statement table, by pattern.
HEADER_PATTERNS = ["chỉ tiêu|item", "mã|code", "thuyết minh|note", "cuối kỳ|cuối năm|năm nay|this year", "đầu kỳ|đầu năm|năm trước|last year"]


def paragraphs(boxes: DataFrame, gap: float = 30.0) -> DataFrame:
    """Boxes (doc_id, page, top, bottom) with `paragraph`: a distance over `gap` below the lowest edge so far starts the next."""
    w = W.partitionBy("doc_id", "page").orderBy("top", "bottom")
    low = F.max("bottom").over(w.rowsBetween(W.unboundedPreceding, -1))
    b = boxes.withColumn("_new", F.when(F.coalesce(F.col("top") - low > gap, F.lit(True)), 1).otherwise(0))
    return b.withColumn("paragraph", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def nearest_column(x: Column, columns: Column) -> Column:
    """The place (from 0) of the column nearest to x; of equally near ones the first."""
    return F.get(F.array_sort(F.transform(columns, lambda c, k: F.struct(F.abs(x - c).alias("d"), k.alias("k")))), F.lit(0))["k"]


def header_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, block_id, row, hits): the row of each table that most header patterns match, at least one; of equal ones the first."""
    low = F.lower("cell")
    c = cells.withColumn("_h", F.array_compact(F.array(*[F.when(low.rlike(p), k) for k, p in enumerate(HEADER_PATTERNS)])))
    g = c.groupBy("doc_id", "block_id", "row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_h")))).alias("hits"))  # a row of a table
    return g.where("hits > 0").groupBy("doc_id", "block_id").agg(F.max_by(F.struct("row", "hits"), F.struct("hits", -F.col("row"))).alias("b")).select("doc_id", "block_id", "b.row", "b.hits")


def located_rows(cells: DataFrame, wanted: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, block_id, concept, row, how): where a table has the row of a concept: by its code in a cell, else by the label that shares the largest part of its words, at least `least`.

    wanted: doc_id, block_id, concept, code, name. Both ways are equality joins within a table.
    """
    code = cells.where(F.col("col") > 0).select("doc_id", "block_id", F.col("cell").alias("code"), "row").where("code <> ''")
    by_code = wanted.join(code, ["doc_id", "block_id", "code"]).groupBy("doc_id", "block_id", "concept").agg(F.min("row").alias("_row_code"))
    label = cells.where("col = 0").select("doc_id", "block_id", "row", F.explode(tokens(unaccented(F.col("cell")))).alias("_t"))
    words = wanted.select("doc_id", "block_id", "concept", tokens(unaccented(F.col("name"))).alias("_w"))
    shared = words.select("doc_id", "block_id", "concept", F.size("_w").alias("_n"), F.explode("_w").alias("_t")).join(label, ["doc_id", "block_id", "_t"])
    s = shared.groupBy("doc_id", "block_id", "concept", "row").agg((F.count("*") / F.max("_n")).alias("_s")).where(F.col("_s") >= least)
    by_label = s.groupBy("doc_id", "block_id", "concept").agg(F.max_by("row", F.struct("_s", -F.col("row"))).alias("_row_label"))
    out = wanted.select("doc_id", "block_id", "concept").join(by_code, ["doc_id", "block_id", "concept"], "left").join(by_label, ["doc_id", "block_id", "concept"], "left")
    return out.select("doc_id", "block_id", "concept", F.coalesce("_row_code", "_row_label").alias("row"), F.when(F.col("_row_code").isNotNull(), "code").when(F.col("_row_label").isNotNull(), "label").alias("how"))


def contents_lines(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, first, last): lines of a contents table: a title, dots or blanks, and a page token."""
    t = F.trim(F.col(text))
    title, token = F.regexp_extract(t, "^\\|?\\s*(\\S.*?\\S)\\s*(?:\\||\\.{3,}|\\s{3,}|…)\\s*([0-9]{1,4}(?:\\s*-\\s*[0-9]{1,4})?)\\s*\\|?$", 1), F.regexp_extract(t, "^\\|?\\s*(\\S.*?\\S)\\s*(?:\\||\\.{3,}|\\s{3,}|…)\\s*([0-9]{1,4}(?:\\s*-\\s*[0-9]{1,4})?)\\s*\\|?$", 2)
    return lines.where(title != "").select(key, title.alias("title"), toc_pages(token).alias("p")).select(key, "title", "p.first", "p.last")


def announced_pages(titles: DataFrame, pages: DataFrame, ahead: int = 6, share: float = 0.7, head: int = 800) -> DataFrame:
    """(doc_id, id, page): the first of the next pages whose head holds enough of the words of a title.

    titles: doc_id, id, title, page (where it is announced); pages: doc_id, page, text. The pages ahead
    are spread, so titles meet pages by equality.
    """
    t = titles.select("doc_id", "id", tokens(F.col("title")).alias("_w"), F.explode(F.sequence(F.col("page"), F.col("page") + ahead)).alias("page")).where(F.size("_w") > 0)
    p = pages.select("doc_id", "page", tokens(F.substring("text", 1, head)).alias("_h"))
    hit = F.size(F.array_intersect("_w", "_h")) >= share * F.size("_w")
    return t.join(p, ["doc_id", "page"]).where(hit).groupBy("doc_id", "id").agg(F.min("page").alias("page"))


# ---- Queries ----------------------------------------------------------------------------------------


def block_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of each page by the gaps between its boxes."""
    b = once(table(spark, d, "blocks")).where("bbox is not null").select("doc_id", "page", F.col("bbox.top").alias("top"), F.col("bbox.bottom").alias("bottom"))
    return paragraphs(b).groupBy("doc_id", "page").agg(F.count("*").alias("boxes"), F.max("paragraph").alias("paragraphs"))


def box_columns(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by the nearest of three columns to their middle."""
    b = once(table(spark, d, "blocks")).where("bbox is not null")
    middle = let((F.col("bbox.x0") + F.col("bbox.x1")) / 2, lambda x: nearest_column(x, F.array(F.lit(100.0), F.lit(300.0), F.lit(500.0))))
    return b.groupBy(middle.alias("column"), "block_type").agg(F.count("*").alias("blocks"))


def table_header_rows(spark: SparkSession, d: str) -> DataFrame:
    return header_rows(table_cells(once(table(spark, d, "blocks")).where("block_type = 'table'")))


def concept_rows(spark: SparkSession, d: str) -> DataFrame:
    """Where the table of each fact has the row of its concept."""
    f = table(spark, d, "financial_facts").select("doc_id", F.col("table_id").alias("block_id"), "concept").where("table_id is not null").distinct()
    c = table(spark, d, "concept_definitions").select("concept", "code", F.col("standard_name").alias("name"))
    cells = table_cells(once(table(spark, d, "blocks")).where("block_type = 'table'"))
    return located_rows(cells, f.join(c, "concept")).groupBy("concept", "how").agg(F.count("*").alias("tables"))


def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of tables that are to be set flush right: six in ten of their filled cells below the header are numbers."""
    cells = table_cells(once(table(spark, d, "blocks")).where("block_type = 'table'")).where("row > 0 and cell <> ''")
    return cells.groupBy("doc_id", "block_id", "col").agg((F.count_if(is_numeric(F.col("cell"))) / F.count("*") >= 0.6).alias("right"))


def announced_sections(spark: SparkSession, d: str) -> DataFrame:
    """The first page, from its own on, whose head has the words of each section's title."""
    s = table(spark, d, "sections").where("title is not null and page_start is not null").select("doc_id", "id", clean_title("title").alias("title"), F.col("page_start").alias("page"))
    b = reading_order(once(table(spark, d, "blocks"))).where("content is not null")
    pages = b.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("content", 1, 800).alias("x")))), lambda x: x["x"]), "\n").alias("text"))
    return announced_pages(s, pages)


QUERIES = {f.__name__: f for f in (block_paragraphs, box_columns, table_header_rows, concept_rows, numeric_columns, announced_sections)}
_CELLS = """lines AS (SELECT doc_id, block_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM b WHERE block_type = 'table' AND content IS NOT NULL),
grid AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY n) AS r, regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', '') AS x FROM lines WHERE trim(line) LIKE '|%' AND NOT regexp_matches(trim(line), '^\\|[-: |]+\\|$')),
cell AS (SELECT doc_id, block_id, r, trim(unnest(string_split(x, '|'))) AS cell, generate_subscripts(string_split(x, '|'), 1) AS col FROM grid)"""
ORACLES = {
    "numeric_columns": f"""
WITH {ONCE}, {_CELLS}
SELECT doc_id, block_id, (col - 1)::int AS col, avg((regexp_matches(regexp_replace(cell, '^\\(\\s*(.*?)\\s*\\)$', '\\1'), '^-?\\s*[0-9]{{1,3}}([.,][0-9]{{3}})*([.,][0-9]+)?$|^-?\\s*[0-9]+([.,][0-9]+)?$'))::int) >= 0.6 AS right
FROM cell WHERE r > 1 AND cell <> '' GROUP BY ALL
""",
    "table_header_rows": f"""
WITH {ONCE}, {_CELLS}, h AS (SELECT doc_id, block_id, r, {" + ".join(f"max(regexp_matches(lower(cell), '{p}')::int)" for p in HEADER_PATTERNS)} AS hits FROM cell GROUP BY ALL)
SELECT doc_id, block_id, (r - 1)::int AS row, hits::int AS hits FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, block_id ORDER BY hits DESC, r) = 1
""",
    "block_paragraphs": f"""
WITH {ONCE}, x AS (SELECT doc_id, page, bbox.top AS t, bbox.bottom AS u FROM b WHERE bbox IS NOT NULL),
g AS (SELECT *, CASE WHEN coalesce(t - max(u) OVER (PARTITION BY doc_id, page ORDER BY t, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 30, true) THEN 1 ELSE 0 END AS n FROM x)
SELECT doc_id, page, count(*) AS boxes, sum(n)::BIGINT AS paragraphs FROM g GROUP BY ALL
""",
    "box_columns": f"""
WITH {ONCE}, x AS (SELECT block_type, (bbox.x0 + bbox.x1) / 2 AS m FROM b WHERE bbox IS NOT NULL)
SELECT CASE WHEN abs(m - 100) <= abs(m - 300) AND abs(m - 100) <= abs(m - 500) THEN 0 WHEN abs(m - 300) <= abs(m - 500) THEN 1 ELSE 2 END AS column, block_type, count(*) AS blocks FROM x GROUP BY ALL
""",
}
