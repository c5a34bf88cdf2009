"""Markdown tables as arrays: grids from text, text from grids, and the repairs between; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.tables import table

SEPARATOR = "^\\|[-: |]+\\|$"


def table_lines(content: Column) -> Column:
    """The lines of a text that are table rows (beginning with a pipe), trimmed."""
    return F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))


def cells_of(line: Column) -> Column:
    """The trimmed cells of a table row."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), "^\\|", ""), "\\|$", "")
    return F.transform(F.split(inner, "\\|", -1), lambda x: F.trim(x))


def grid(content: Column) -> Column:
    """Rows of cells, without separator rows."""
    return F.transform(F.filter(table_lines(content), lambda x: ~x.rlike(SEPARATOR)), cells_of)


def padded(rows: Column) -> Column:
    """Rows filled with empty cells to the widest."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def density(rows: Column) -> Column:
    """The share of numeric cells among the non-empty ones below the header; 0 without any."""
    from ledgerloom.functions.numbers import is_numeric

    body = F.flatten(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))))
    filled = F.filter(body, lambda c: c != "")
    return F.coalesce(F.size(F.filter(filled, lambda c: is_numeric(c))) / F.nullif(F.size(filled), F.lit(0)), F.lit(0.0))


def merged_header(first: Column, second: Column) -> Column:
    """Two header rows as one: the upper cells filled forward, joined with the lower by ' - '; nameless columns get a number."""
    filled = F.aggregate(first, F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.array(F.when(x != "", x).otherwise(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))))))
    pairs = F.arrays_zip(filled.alias("a"), second.alias("b"))
    return F.transform(
        pairs,
        lambda p, k: F.when((p["a"] != "") & (p["b"] != "") & (p["a"] != p["b"]), F.concat(p["a"], F.lit(" - "), p["b"]))
        .when(F.coalesce(p["b"], F.lit("")) != "", p["b"]).when(p["a"] != "", p["a"]).otherwise(F.concat(F.lit("Cột_"), (k + 1).cast("string"))),
    )


def to_markdown(rows: Column) -> Column:
    """A grid as a Markdown table; the first row is the header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    full = padded(rows)
    head = F.element_at(full, 1)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(head), rule), F.transform(F.slice(full, 2, F.greatest(F.size(full), F.lit(1))), line)), "\n"))


def aligned(content: Column) -> Column:
    """A Markdown table whose rows all have the width of the widest; other lines stay."""
    lines = F.split(content, "\n")
    width = F.array_max(F.transform(F.filter(lines, lambda x: F.trim(x).startswith("|")), lambda x: F.size(cells_of(x))))

    def fill(x: Column) -> Column:
        c = cells_of(x)
        pad = F.when(F.trim(x).rlike(SEPARATOR), F.lit("---")).otherwise(F.lit(""))
        return F.when(F.trim(x).startswith("|") & (F.size(c) < width), F.concat(F.lit("| "), F.array_join(F.concat(c, F.array_repeat(pad, width - F.size(c))), " | "), F.lit(" |"))).otherwise(x)

    return F.array_join(F.transform(lines, fill), "\n")


def clean_numeric_cells(content: Column) -> Column:
    """Table text with runs of dashes as one, no blanks inside brackets, and no blanks between digits; separator rows stay."""
    def fix(x: Column) -> Column:
        t = F.regexp_replace(x, "\\|\\s*[-–—]{2,}\\s*(?=\\|)", "| - ")
        t = F.regexp_replace(t, "\\(\\s+([0-9.,]+)\\s*\\)|\\(\\s*([0-9.,]+)\\s+\\)", "($1$2)")
        t = F.regexp_replace(t, "(?<=[0-9])\\s+(?=[.,][0-9])|(?<=[0-9][.,])\\s+(?=[0-9])", "")
        return F.when(F.trim(x).startswith("|") & ~F.trim(x).rlike(SEPARATOR), t).otherwise(x)

    return F.array_join(F.transform(F.split(content, "\n"), fix), "\n")


def embedded_heading(content: Column) -> Column:
    """(heading, rest): a heading that stands in the first row of a table alone, split from it."""
    first = F.regexp_extract(content, "^\\s*\\|?\\s*([^|\\n]+?)\\s*(\\|[\\s|]*)?\\n", 1)
    is_heading = first.rlike("^(([IVX]+|[0-9]{1,2}(\\.[0-9]+)*)[.)]\\s+\\S|[a-z]\\)\\s+\\S)") & ~F.regexp_extract(content, "^\\s*([^\\n]*)\\n", 1).rlike("\\|[^|\\n]*\\S[^|\\n]*\\|[^|\\n]*\\S")
    return F.struct(F.when(is_heading, first).alias("heading"), F.when(is_heading, F.regexp_replace(content, "^\\s*[^\\n]*\\n", "")).otherwise(content).alias("rest"))


def repaired(content: Column) -> Column:
    """A table as it comes from a recogniser, made regular: an embedded heading split off, rows of one width, numeric cells clean."""
    return clean_numeric_cells(aligned(embedded_heading(content)["rest"]))


def stitched_header(content: Column) -> Column:
    """A table whose first two rows are both heads (no cell with two digits in a row, the second no separator) with one head: the upper cells filled forward and joined with the lower."""
    lines = F.filter(F.split(F.trim(content), "\n"), lambda x: F.lit(True))
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    heads = (F.size(lines) >= 3) & ~first.rlike("[0-9]{2,}") & ~second.rlike("[0-9]{2,}") & ~F.trim(second).rlike("^\\|[\\s|:-]+\\|$")
    filled = F.aggregate(cells_of(first), F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.array(F.when(x != "", x).otherwise(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))))))
    joined = F.zip_with(filled, cells_of(second), lambda a, b: F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit(" - "), b)).when(F.coalesce(b, F.lit("")) != "", b).otherwise(F.coalesce(a, F.lit(""))))
    head = F.concat(F.lit("| "), F.array_join(joined, " | "), F.lit(" |"))
    return F.when(heads, F.array_join(F.concat(F.array(head), F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1)))), "\n")).otherwise(content)


# Words that a long head may hold.
HEAD_WORDS = "(?iu)31/12|1/1|nguyên giá|khấu hao|dự phòng|vốn"


def polished_heads(heads: Column, year: Column) -> Column:
    """Heads of a table of notes: long prose is dropped, a doubled currency is one; heads that say nothing get the usual periods for three columns, those of cost and provision for five, and numbered ones else."""
    y = year.cast("string")
    clean = F.transform(heads, lambda h: F.regexp_replace(F.trim(h), "(?iu)\\b(VND)\\s+\\1\\b", "$1"))
    clean = F.transform(clean, lambda h, k: F.when((k > 0) & (F.length(h) > 40) & ~h.rlike(HEAD_WORDS), F.lit("")).when(k > 0, h).otherwise(F.get(heads, F.lit(0))))
    empty = lambda h: F.coalesce((h == "") | h.contains("Cột ") | (h == "VND"), F.lit(True))
    n, at = F.size(heads), lambda k: F.get(clean, F.lit(k))
    money = lambda h: F.coalesce(h.rlike("(?i)VND|USD"), F.lit(False))
    same = money(at(1)) & money(at(2)) & (at(1) == at(2))
    period = lambda day: F.concat(F.lit(f"{day}/"), y)
    three = F.array(at(0), F.when(empty(at(1)) | same, F.concat(period("31/12"), F.lit(" VND"))).otherwise(at(1)), F.when(empty(at(2)), F.concat(period("1/1"), F.lit(" VND"))).otherwise(at(2)))
    # Of two equal heads with a currency the first is renamed before the second is looked at, so that one stays.
    rest = F.slice(clean, 2, F.greatest(n, F.lit(1)))
    vague = F.exists(clean, lambda h: h.contains("Cột ")) | F.forall(rest, lambda h: h.isin("", "VND"))
    five = F.array(at(0), *[F.concat(period(day), F.lit(f" {what}")) for day in ("31/12", "1/1") for what in ("Giá gốc", "Dự phòng / Khả dụng")])
    usual = F.transform(clean, lambda h, k: F.when((k == 0) | ~empty(h), h).when(k == 1, F.concat(F.lit("Số cuối kỳ ("), y, F.lit(") VND"))).when(k == 2, F.concat(F.lit("Số đầu kỳ ("), y, F.lit(") VND"))).otherwise(F.concat(F.lit("Chỉ tiêu "), k.cast("string"))))
    return F.when(n == 3, three).when((n == 5) & vague, five).when(n == 5, clean).otherwise(usual)


def is_pseudo_table(content: Column, heads: Column, num_rows: Column, dens: Column) -> Column:
    """Whether a table is none: without any number, of fewer than three lines, or of one row under no, long or nameless heads."""
    lines = F.size(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != ""))
    heads = F.coalesce(heads, F.array().cast("array<string>"))
    poor = (F.size(heads) == 0) | F.exists(heads, lambda h: F.length(h) > 40) | F.exists(heads, lambda h: h.contains("Cột 1"))
    return F.coalesce(dens == 0.0, F.lit(False)) | (lines < 3) | ((F.coalesce(num_rows, F.lit(0)) <= 1) & poor)


def demoted_table(content: Column, heads: Column) -> Column:
    """A table that is none as text: its long heads and the cells of its rows; null when that is under ten characters."""
    long_ = F.filter(F.slice(F.coalesce(heads, F.array().cast("array<string>")), 2, F.greatest(F.size(heads), F.lit(1))), lambda h: (F.length(h) > 20) & ~h.startswith("Cột "))
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    rows = F.transform(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), lambda x: F.array_join(F.filter(cells_of(x), lambda c: c != ""), " "))
    text = F.trim(F.array_join(F.filter(F.concat(F.coalesce(long_, F.array().cast("array<string>")), rows), lambda x: x != ""), " "))
    return F.when(F.length(text) >= 10, text)


def format_of(content: Column) -> Column:
    """What a table is written in: json, html, markdown, or null for a text that holds none."""
    t = F.trim(content)
    return F.when(t.rlike("^[\\[{]") & F.try_parse_json(t).isNotNull(), "json").when(F.lower(t).contains("<table"), "html").when(t.rlike("(?m)^\\s*\\|"), "markdown")


def fixed_width(rows: Column, right: Column, centre: Column | None = None) -> Column:
    """A grid as lines of columns of one width; `right` and `centre` say for each column whether it is set flush right or in the middle, others flush left."""
    full = padded(rows)
    widths = F.transform(F.element_at(full, 1), lambda _, k: F.array_max(F.transform(full, lambda r: F.length(F.get(r, k)))))
    says = lambda c, k: F.lit(False) if c is None else F.coalesce(F.get(c, k), F.lit(False))
    blanks = lambda n: F.repeat(F.lit(" "), n.cast("int"))

    def cell(x: Column, k: Column) -> Column:
        room = F.get(widths, k) - F.length(x)
        before = F.when(says(right, k), room).when(says(centre, k), F.floor(room / 2)).otherwise(F.lit(0))
        return F.concat(blanks(before), x, blanks(room - before))

    return F.array_join(F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))), "\n")


def column_roles(headers: Column) -> Column:
    """(label, code, note, current, previous): places (from 0) of the columns of a statement table, by their headers, else by the usual layouts of three to five columns."""
    low = F.transform(headers, lambda x: F.lower(x))
    where = lambda words, none=None: F.coalesce(*[F.get(F.filter(F.transform(low, lambda x, k: F.when(_any(x, words), k)), lambda v: v.isNotNull()), F.lit(0)), *([F.lit(none)] if none is not None else [])])
    label, code, note = where(LABEL_WORDS, 0), where(CODE_WORDS), where(NOTE_WORDS)
    n = F.size(headers)
    rest = F.filter(F.transform(low, lambda x, k: k), lambda k: (k != label) & ~F.coalesce(k == code, F.lit(False)) & ~F.coalesce(k == note, F.lit(False)))
    a, b = F.get(rest, F.lit(0)), F.get(rest, F.lit(1))
    opening = F.coalesce(_any(F.get(low, a), OPENING_WORDS) | F.get(low, a).rlike("(^|[^0-9])0?1/0?1([^0-9]|$)"), F.lit(False))
    usual = code.isNull() & n.isin(3, 4, 5)
    lay = lambda five, four, three: F.when(n == 5, F.lit(five)).when(n == 4, F.lit(four)).otherwise(F.lit(three))
    return F.struct(
        F.when(usual, F.lit(0)).otherwise(label).cast("int").alias("label"), F.when(usual, lay(1, 1, None)).otherwise(code).cast("int").alias("code"), F.when(usual, lay(2, None, None)).otherwise(note).cast("int").alias("note"),
        F.when(usual, lay(3, 2, 1)).when(opening & b.isNotNull(), b).otherwise(a).cast("int").alias("current"), F.when(usual, lay(4, 3, 2)).when(opening & b.isNotNull(), a).otherwise(b).cast("int").alias("previous"),
    )


# Words of header cells, by role.
LABEL_WORDS = ["chỉ tiêu", "chi tieu", "tài sản", "nguồn vốn", "nội dung", "khoản mục", "item"]
CODE_WORDS = ["mã số", "ma so", "mã", "code"]
NOTE_WORDS = ["thuyết minh", "thuyet minh", "tm", "note"]
OPENING_WORDS = ["đầu năm", "dau nam", "năm trước", "nam truoc", "đầu kỳ", "last year"]


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def table_cells(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, page, seq, row, col, cell): every cell of the Markdown tables of blocks, rows and columns from 0."""
    rows = blocks.select("doc_id", "block_id", "page", "seq", F.posexplode(grid(F.col("content"))).alias("row", "cells"))
    return rows.select("doc_id", "block_id", "page", "seq", "row", F.posexplode("cells").alias("col", "cell"))


# ---- Queries ----------------------------------------------------------------------------------------


def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Table blocks: rows and columns found and stated, numeric density found and stated."""
    b = table(spark, d, "blocks").where("block_type = 'table'").withColumn("g", grid(F.col("content")))
    return b.select(
        "doc_id", "block_id", "num_rows", "num_cols", F.size("g").alias("rows"), F.array_max(F.transform("g", lambda r: F.size(r))).alias("cols"), F.round(density(F.col("g")), 4).alias("density"),
    )


def table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether a grid written as Markdown reads back as the padded grid, and how long the text is."""
    b = table(spark, d, "blocks").where("block_type = 'table'").withColumn("g", grid(F.col("content")))
    m = to_markdown(F.col("g"))
    return b.select("doc_id", "block_id", F.length(m).alias("length"), (grid(m) == padded(F.col("g"))).alias("same"), F.length(clean_numeric_cells(aligned(F.col("content")))).alias("cleaned_length"))


def table_column_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of the columns of statement tables, counted by headers."""
    b = table(spark, d, "blocks").where("block_type = 'table' and headers is not null")
    return b.groupBy("headers").agg(F.count("*").alias("blocks")).select(F.array_join("headers", " | ").alias("header"), column_roles(F.col("headers")).alias("r"), "blocks").select("header", "r.*", "blocks")


def table_heads(spark: SparkSession, d: str) -> DataFrame:
    """Table blocks: what they are written in, and whether they are none."""
    b = table(spark, d, "blocks").where("block_type = 'table' and content is not null")
    return b.select("doc_id", "block_id", format_of(F.col("content")).alias("format"), is_pseudo_table(F.col("content"), F.col("headers"), F.col("num_rows"), F.col("numeric_density")).alias("pseudo"))


QUERIES = {"table_heads": table_heads, "table_shapes": table_shapes, "table_roundtrip": table_roundtrip, "table_column_roles": table_column_roles}
_LINES = "list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '|')), lambda x: x)"
_GRID = f"list_transform(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^\\|[-: |]+\\|$')), lambda x: list_transform(string_split(regexp_replace(regexp_replace(x, '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c)))"
_NUM = "regexp_matches(regexp_replace(c, '^\\(\\s*(.*?)\\s*\\)$', '\\1'), '^-?\\s*[0-9]{1,3}([.,][0-9]{3})*([.,][0-9]+)?$|^-?\\s*[0-9]+([.,][0-9]+)?$')"
ORACLES = {
    "table_heads": f"""
WITH g AS (SELECT doc_id, block_id, content, headers, num_rows, numeric_density, year, {_GRID} AS g FROM blocks WHERE block_type = 'table' AND content IS NOT NULL),
h AS (SELECT *, headers[1] AS h0, headers[2] AS h1, headers[3] AS h2, len(headers) AS n FROM g)
SELECT doc_id, block_id, CASE WHEN regexp_matches(trim(content), '^[\\[{{]') AND json_valid(content) THEN 'json' WHEN contains(lower(content), '<table') THEN 'html' WHEN regexp_matches(content, '(?m)^\\s*\\|') THEN 'markdown' END AS format,
  coalesce(numeric_density = 0, false) OR len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')) < 3 OR (coalesce(num_rows, 0) <= 1 AND (coalesce(len(headers), 0) = 0 OR len(list_filter(headers, lambda x: length(x) > 40 OR contains(x, 'Cột 1'))) > 0)) AS pseudo FROM h
""",
    "table_shapes": f"""
WITH g AS (SELECT *, {_GRID} AS g FROM blocks WHERE block_type = 'table'),
f AS (SELECT *, list_filter(flatten(g[2:]), lambda c: c <> '') AS filled FROM g)
SELECT doc_id, block_id, num_rows, num_cols, len(g)::int AS rows, list_max(list_transform(g, lambda r: len(r)))::int AS cols,
  round(coalesce(len(list_filter(filled, lambda c: {_NUM}))::DOUBLE / nullif(len(filled), 0), 0), 4) AS density FROM f
""",
    "table_column_roles": """
WITH h AS (SELECT headers, count(*) AS blocks FROM blocks WHERE block_type = 'table' AND headers IS NOT NULL GROUP BY headers),
w AS (SELECT *, len(headers) AS n,
  list_position(list_transform(headers, lambda x: regexp_matches(lower(x), 'chỉ tiêu|chi tieu|tài sản|nguồn vốn|nội dung|khoản mục|item')), true) - 1 AS l0,
  list_position(list_transform(headers, lambda x: regexp_matches(lower(x), 'mã số|ma so|mã|code')), true) - 1 AS c0,
  list_position(list_transform(headers, lambda x: regexp_matches(lower(x), 'thuyết minh|thuyet minh|tm|note')), true) - 1 AS t0 FROM h),
r AS (SELECT *, CASE WHEN coalesce(l0, -1) < 0 THEN 0 ELSE l0 END AS l, CASE WHEN c0 >= 0 THEN c0 END AS c, CASE WHEN t0 >= 0 THEN t0 END AS t FROM w),
v AS (SELECT *, list_filter(range(n), lambda k: k <> l AND k <> coalesce(c, -1) AND k <> coalesce(t, -1)) AS rest FROM r),
o AS (SELECT *, rest[1] AS a, rest[2] AS b, coalesce(regexp_matches(lower(headers[rest[1] + 1]), 'đầu năm|dau nam|năm trước|nam truoc|đầu kỳ|last year|(^|[^0-9])0?1/0?1([^0-9]|$)'), false) AS opening, c IS NULL AND n IN (3, 4, 5) AS usual FROM v)
SELECT array_to_string(headers, ' | ') AS header, CASE WHEN usual THEN 0 ELSE l END::INT AS label, CASE WHEN usual THEN CASE n WHEN 3 THEN NULL ELSE 1 END ELSE c END::INT AS code, CASE WHEN usual THEN CASE n WHEN 5 THEN 2 END ELSE t END::INT AS note,
  CASE WHEN usual THEN n - 2 WHEN opening AND b IS NOT NULL THEN b ELSE a END::INT AS current, CASE WHEN usual THEN n - 1 WHEN opening AND b IS NOT NULL THEN a ELSE b END::INT AS previous, blocks FROM o
""",
}
