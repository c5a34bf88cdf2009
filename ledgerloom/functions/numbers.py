"""Numbers in statement cells, as column expressions: parsing, formatting, tolerant comparison, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.markdown import table_cells
from ledgerloom.tables import table

DASHES = "-–—−"


def let(c: Column, body) -> Column:
    """body(c), with c computed once: an expression that uses its input many times stays small."""
    return F.element_at(F.transform(F.array(c), lambda x: body(x)), 1)


def _separated(t: Column) -> Column:
    """Digits with separators as a double: of two kinds the last is decimal; several of one kind, or one before exactly three digits (and no leading 0), group thousands."""

    def cleaned(x: Column) -> Column:
        dots, commas = F.length(F.regexp_replace(x, "[^.]", "")), F.length(F.regexp_replace(x, "[^,]", ""))
        last_is_dot = x.rlike("[.][^.,]*$")
        grouped = x.rlike("^-?[0-9]*[.,][0-9]{3}$") & ~x.rlike("^0[.,]")
        return (
            F.when((dots > 0) & (commas > 0), F.when(last_is_dot, F.translate(x, ",", "")).otherwise(F.translate(F.translate(x, ".", ""), ",", ".")))
            .when((dots > 1) | (commas > 1) | grouped, F.translate(x, ".,", ""))
            .otherwise(F.translate(x, ",", "."))
        )

    return let(let(t, cleaned), lambda x: F.when(x.rlike("^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), x.try_cast("double")))


def ocr_number(c: Column) -> Column:
    """A number read from a scanned cell, or null. Brackets or a leading minus make it negative, a lone dash is 0, O and l count as 0 and 1, any other letter gives null."""

    def parsed(s: Column) -> Column:
        negative = s.rlike(f"^(\\(.*\\)|[{DASHES}].*)$")
        body = F.regexp_replace(F.regexp_replace(s, "^\\((.*)\\)$", "$1"), f"^[{DASHES}]", "")
        t = F.regexp_replace(F.translate(body, "OolI|", "00111"), "[^0-9.,-]", "")
        value = let(_separated(t), lambda v: F.when(negative, -F.abs(v)).otherwise(v))
        nothing = (s == "") | body.rlike("[A-HJ-NP-Za-kmnp-zÀ-ỹ]") | (t == "")
        return F.when(s.rlike(f"^[{DASHES}]$"), F.lit(0.0)).when(~nothing, value)

    return let(F.trim(F.regexp_replace(F.translate(c, "（）", "()"), "^\\s+|\\s+$", "")), parsed)


def table_number(c: Column) -> Column:
    """(value, negative) of a table cell that is nothing but a number; no repairs of scanned signs."""

    def parsed(s: Column) -> Column:
        negative = s.rlike("^(\\(\\s*[0-9\\s.,]+\\s*\\)|-.*)$")
        t = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^\\((\\s*[0-9\\s.,]+\\s*)\\)$", "$1"), "\\s", ""), "^-", "")
        value = let(t, lambda x: F.when(x.rlike("^[0-9][0-9.,]*$"), _separated(x)))
        signed = let(F.when(s.rlike(f"^[{DASHES}]$"), F.lit(0.0)).otherwise(value), lambda v: F.struct(F.when(negative, -F.abs(v)).otherwise(v).alias("value"), F.coalesce(negative & (v != 0), F.lit(False)).alias("negative")))
        return signed

    return let(F.regexp_replace(c, "^\\s+|\\s+$", ""), parsed)


def is_numeric(c: Column) -> Column:
    """Whether a cell counts as numeric for a table's density."""
    s = F.regexp_replace(F.regexp_replace(c, "^\\s+|\\s+$", ""), "^\\(\\s*(.*?)\\s*\\)$", "$1")
    return s.rlike("^-?\\s*[0-9]{1,3}([.,][0-9]{3})*([.,][0-9]+)?$|^-?\\s*[0-9]+([.,][0-9]+)?$")


def clean_cell(c: Column) -> Column:
    """A cell without the words for nothing, with plain dashes and single spaces; null becomes empty."""
    t = F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "–—\n\r", "--  "), "\\s+", " "))
    return F.when(F.lower(t).isin("none", "nan", "null"), F.lit("")).otherwise(t)


def markdown_cell(c: Column) -> Column:
    """A cell safe for Markdown: bracketed numbers with a minus, pipes escaped."""
    t = clean_cell(c)
    return F.regexp_replace(F.regexp_replace(t, "^\\(\\s*([0-9\\s.,]+?)\\s*\\)$", "-$1"), "\\|", "\\\\|")


# Patterns of currency units in captions, the first that matches counts.
CURRENCY = [
    (r"đơn\s*vị\s*tính\s*:\s*tỷ\s*(đồng|vnd)", "TY_VND"),
    (r"đơn\s*vị\s*tính\s*:\s*triệu\s*(đồng|vnd)", "TRIEU_VND"),
    (r"đơn\s*vị\s*tính\s*:\s*nghìn\s*(đồng|vnd)", "NGHIN_VND"),
    (r"đơn\s*vị\s*tính\s*:\s*(đồng|vnd)", "VND"),
    (r"đơn\s*vị\s*tính\s*:\s*usd", "USD"),
    (r"(^|[^\p{L}0-9_])(tỷ\s*đồng|tỷ\s*vnd)($|[^\p{L}0-9_])", "TY_VND"),
    (r"(^|[^\p{L}0-9_])(triệu\s*đồng|triệu\s*vnd)($|[^\p{L}0-9_])", "TRIEU_VND"),
    (r"(^|[^\p{L}0-9_])(đồng\s*việt\s*nam|vnd)($|[^\p{L}0-9_])", "VND"),
]


def currency_unit(c: Column) -> Column:
    """The currency unit a text names, by the first pattern that matches, or null."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(u)) for p, u in CURRENCY])


def approx_equal(a: Column, b: Column, absolute: float = 2.0, relative: float = 1e-4) -> Column:
    """Whether two amounts agree within an absolute or a relative tolerance; two zeros do."""
    d, largest = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    return (d <= absolute) | F.when(largest == 0, F.lit(True)).otherwise(d / F.nullif(largest, F.lit(0.0)) <= relative)


def ratio(numerator: Column, denominator: Column, places: int = 4) -> Column:
    """A rounded ratio, only over a positive denominator."""
    return F.round(F.when(denominator > 0, numerator / denominator), places)


def growth(current: Column, previous: Column) -> Column:
    """Percentage of change against the size of the previous value; null over zero."""
    return F.round((current - previous) * 100 / F.nullif(F.abs(previous), F.lit(0.0)), 2)


def overlap(a: Column, b: Column) -> Column:
    """Shared area of two inclusive cell rectangles (r1, c1, r2, c2) over the area of either; 0 without any."""
    side = lambda x, lo, hi: F.get(x, F.lit(hi)) - F.get(x, F.lit(lo)) + 1
    span = lambda lo, hi: F.greatest(F.lit(0), F.least(F.get(a, F.lit(hi)), F.get(b, F.lit(hi))) - F.greatest(F.get(a, F.lit(lo)), F.get(b, F.lit(lo))) + 1)
    both = span(0, 2) * span(1, 3)
    return both / (side(a, 0, 2) * side(a, 1, 3) + side(b, 0, 2) * side(b, 1, 3) - both)


def display(c: Column) -> Column:
    """A number for people: thousands separated, up to four decimals without trailing zeros."""
    text = F.format_number(c, 4)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")


# ---- Queries ----------------------------------------------------------------------------------------


def cell_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every table cell that is a number, scanned or clean, summed by document and column."""
    cells = table_cells(table(spark, d, "blocks").where("block_type = 'table'"))
    n = cells.select("doc_id", "col", "cell", ocr_number(F.col("cell")).alias("ocr"), table_number(F.col("cell")).alias("t"))
    return n.groupBy("doc_id", "col").agg(
        F.count("*").alias("cells"), F.count("ocr").alias("ocr_numbers"), F.count("t.value").alias("numbers"),
        F.count_if("t.negative").alias("negatives"), F.sum(F.col("t.value").cast("decimal(38,4)")).cast("double").alias("total"),
    )


def cell_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cells with their clean and Markdown forms and how often they occur."""
    cells = table_cells(table(spark, d, "blocks").where("block_type = 'table'"))
    return cells.groupBy("cell").agg(F.count("*").alias("n")).select("cell", clean_cell(F.col("cell")).alias("clean"), markdown_cell(F.col("cell")).alias("markdown"), "n")


def caption_units(spark: SparkSession, d: str) -> DataFrame:
    """Table blocks by the unit in their unit field and the unit their content names."""
    b = table(spark, d, "blocks").where("block_type = 'table'")
    return b.groupBy("unit", currency_unit(F.col("content")).alias("named")).agg(F.count("*").alias("blocks"))


def fact_growth(spark: SparkSession, d: str) -> DataFrame:
    """Change of the largest current against the largest previous value of each concept of a document."""
    f = table(spark, d, "financial_facts").where("concept is not null and value is not null")
    g = f.groupBy("doc_id", "concept").agg(F.max(F.when(F.col("period_type") == "current", F.col("value"))).alias("current"), F.max(F.when(F.col("period_type") == "previous", F.col("value"))).alias("previous"))
    return g.where("current is not null and previous is not null").select("doc_id", "concept", "current", "previous", growth(F.col("current"), F.col("previous")).alias("growth"), approx_equal(F.col("current"), F.col("previous")).alias("same"))


QUERIES = {"cell_numbers": cell_numbers, "cell_cleaning": cell_cleaning, "caption_units": caption_units, "fact_growth": fact_growth}

CELLS = """
lines AS (SELECT doc_id, block_id, page, seq, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS row
  FROM blocks WHERE block_type = 'table' AND content IS NOT NULL),
grid AS (SELECT *, regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', '') AS inner_line FROM lines WHERE trim(line) LIKE '|%' AND NOT regexp_matches(trim(line), '^\\|[-: |]+\\|$')),
cells AS (SELECT doc_id, block_id, row, unnest(string_split(inner_line, '|')) AS raw, generate_subscripts(string_split(inner_line, '|'), 1) AS col FROM grid),
cell AS (SELECT doc_id, block_id, row, col, trim(raw) AS cell FROM cells)
"""
_SEPARATED = """CASE WHEN NOT regexp_matches({c}, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN NULL ELSE try_cast({c} AS DOUBLE) END"""
_CLEANED = """CASE WHEN length(regexp_replace({t}, '[^.]', '', 'g')) > 0 AND length(regexp_replace({t}, '[^,]', '', 'g')) > 0
  THEN CASE WHEN strpos(reverse({t}), '.') < strpos(reverse({t}), ',') THEN replace({t}, ',', '') ELSE replace(replace({t}, '.', ''), ',', '.') END
  WHEN length(regexp_replace({t}, '[^.]', '', 'g')) > 1 OR length(regexp_replace({t}, '[^,]', '', 'g')) > 1 OR (regexp_matches({t}, '^-?[0-9]*[.,][0-9]{{3}}$') AND NOT regexp_matches({t}, '^0[.,]'))
  THEN replace(replace({t}, '.', ''), ',', '') ELSE replace({t}, ',', '.') END"""
ORACLES = {
    "cell_numbers": f"""
WITH {CELLS},
o1 AS (SELECT *, regexp_matches(cell, '^\\(.*\\)$') AS br, CASE WHEN regexp_matches(cell, '^\\(.*\\)$') THEN cell[2:-2] ELSE cell END AS inn FROM cell),
o2 AS (SELECT *, NOT br AND regexp_matches(inn, '^[-–—−]') AS mi FROM o1),
o3 AS (SELECT *, CASE WHEN mi THEN substr(inn, 2) ELSE inn END AS body FROM o2),
o4 AS (SELECT *, regexp_replace(translate(body, 'OolI|', '00111'), '[^0-9.,-]', '', 'g') AS t, regexp_matches(body, '[A-HJ-NP-Za-kmnp-zÀ-ỹ]') AS letters FROM o3),
o5 AS (SELECT *, {_CLEANED.format(t="t")} AS cl FROM o4),
o6 AS (SELECT *, {_SEPARATED.format(c="cl")} AS v FROM o5),
n1 AS (SELECT *, CASE WHEN regexp_matches(cell, '^[-–—−]$') THEN 0.0 WHEN cell = '' OR letters OR t = '' THEN NULL WHEN br OR mi THEN -abs(v) ELSE v END AS ocr,
  regexp_matches(cell, '^\\(\\s*[0-9\\s.,]+\\s*\\)$') AS tb FROM o6),
n2 AS (SELECT *, regexp_replace(CASE WHEN tb THEN cell[2:-2] ELSE cell END, '\\s', '', 'g') AS tbody FROM n1),
n3 AS (SELECT *, starts_with(tbody, '-') AS tm, CASE WHEN starts_with(tbody, '-') THEN substr(tbody, 2) ELSE tbody END AS tt FROM n2),
n4 AS (SELECT *, {_CLEANED.format(t="tt")} AS tcl FROM n3),
n5 AS (SELECT *, CASE WHEN regexp_matches(cell, '^[-–—−]$') THEN 0.0 WHEN regexp_matches(tt, '^[0-9][0-9.,]*$') THEN {_SEPARATED.format(c="tcl")} END AS tv FROM n4),
n6 AS (SELECT *, coalesce((tb OR tm) AND tv IS NOT NULL AND tv <> 0, false) AS neg FROM n5)
SELECT doc_id, (col - 1)::int AS col, count(*) AS cells, count(ocr) AS ocr_numbers, count(tv) AS numbers, count(*) FILTER (WHERE neg) AS negatives,
  sum((CASE WHEN neg THEN -abs(tv) ELSE tv END)::DECIMAL(38,4))::DOUBLE AS total
FROM n6 GROUP BY ALL
""",
    "cell_cleaning": f"""
WITH {CELLS},
c AS (SELECT cell, count(*) AS n FROM cell GROUP BY cell),
k AS (SELECT cell, n, trim(regexp_replace(translate(cell, '–—', '--'), '\\s+', ' ', 'g')) AS t FROM c),
m AS (SELECT cell, n, CASE WHEN lower(t) IN ('none', 'nan', 'null') THEN '' ELSE t END AS clean FROM k)
SELECT cell, clean, replace(regexp_replace(clean, '^\\(\\s*([0-9\\s.,]+?)\\s*\\)$', '-\\1'), '|', '\\|') AS markdown, n FROM m
""",
    "caption_units": """
WITH l AS (SELECT unit, lower(content) AS c FROM blocks WHERE block_type = 'table')
SELECT unit, CASE
  WHEN regexp_matches(c, 'đơn\\s*vị\\s*tính\\s*:\\s*tỷ\\s*(đồng|vnd)') THEN 'TY_VND'
  WHEN regexp_matches(c, 'đơn\\s*vị\\s*tính\\s*:\\s*triệu\\s*(đồng|vnd)') THEN 'TRIEU_VND'
  WHEN regexp_matches(c, 'đơn\\s*vị\\s*tính\\s*:\\s*nghìn\\s*(đồng|vnd)') THEN 'NGHIN_VND'
  WHEN regexp_matches(c, 'đơn\\s*vị\\s*tính\\s*:\\s*(đồng|vnd)') THEN 'VND'
  WHEN regexp_matches(c, 'đơn\\s*vị\\s*tính\\s*:\\s*usd') THEN 'USD'
  WHEN regexp_matches(c, '(^|[^\\pL0-9_])(tỷ\\s*đồng|tỷ\\s*vnd)($|[^\\pL0-9_])') THEN 'TY_VND'
  WHEN regexp_matches(c, '(^|[^\\pL0-9_])(triệu\\s*đồng|triệu\\s*vnd)($|[^\\pL0-9_])') THEN 'TRIEU_VND'
  WHEN regexp_matches(c, '(^|[^\\pL0-9_])(đồng\\s*việt\\s*nam|vnd)($|[^\\pL0-9_])') THEN 'VND' END AS named, count(*) AS blocks
FROM l GROUP BY ALL
""",
    "fact_growth": """
WITH g AS (SELECT doc_id, concept, max(CASE WHEN period_type = 'current' THEN value END) AS current, max(CASE WHEN period_type = 'previous' THEN value END) AS previous
  FROM financial_facts WHERE concept IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
SELECT *, round((current - previous) * 100 / nullif(abs(previous), 0), 2) AS growth,
  abs(current - previous) <= 2 OR coalesce(abs(current - previous) / nullif(greatest(abs(current), abs(previous)), 0) <= 1e-4, true) AS same
FROM g WHERE current IS NOT NULL AND previous IS NOT NULL
""",
}
