"""Sections and chunks: headings, hierarchy by forward fill, extents, page ranges, chunk building, runs of table lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.markdown import SEPARATOR, cells_of
from ledgerloom.functions.text import ACCENTED, PLAIN, slug
from ledgerloom.operators.blocks import ONCE, once, reading_order
from ledgerloom.tables import table

NUMBERING = "^\\s*(?:[IVXLC]+|[0-9]{1,2}(?:\\.[0-9]+)*|[a-zA-Z])\\s*[.)]\\s+"


def clean_title(c: Column) -> Column:
    """A title without its numbering and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, NUMBERING, ""), "\\s+", " "))


def heading_kind(line: Column) -> Column:
    """What kind of heading a line is, or null: of roman numbers, numbers, decimals, letters, or all in capitals; sentences are none."""
    t = F.trim(line)
    short = (F.length(t) <= 90) & ~t.rlike("[.;,:]$") & ~t.rlike("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}")
    return F.when(
        short,
        F.when(t.rlike("^#{1,6}\\s+\\S"), "markdown").when(t.rlike("^[IVX]+\\s*[.)]\\s+\\S"), "roman").when(t.rlike("^[0-9]{1,2}\\.[0-9]+(\\.[0-9]+)*\\.?\\s+\\p{L}"), "decimal").when(t.rlike("^[0-9]{1,2}\\s*[.)]\\s+\\p{L}"), "number")
        .when(t.rlike("^[a-zđ]\\s*\\)\\s+\\p{L}"), "letter").when((F.upper(t) == t) & t.rlike("\\p{L}.*\\p{L}") & ~t.rlike("[0-9|<>{}\\\\]"), "capitals"),
    )


def with_path(sections: DataFrame) -> DataFrame:
    """Sections in order of their ids with `path`: the clean titles of the last section of each higher level, cut off by a new one above."""
    w = W.partitionBy("doc_id").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    s = sections.withColumn("_t", clean_title(F.coalesce("title", F.lit(""))))
    for level in (3, 4):
        place = F.max(F.when(F.col("level") <= level, F.col("id"))).over(w)  # ids grow in document order
        s = s.withColumn(f"_p{level}", place)
    names = {level: F.last(F.when(F.col("level") == level, F.struct("id", "_t")), ignorenulls=True).over(w) for level in (3, 4)}
    s = s.withColumns({f"_n{k}": v for k, v in names.items()})
    first = F.when((F.col("level") > 3) & F.col("_n3").isNotNull(), F.col("_n3._t"))
    second = F.when((F.col("level") > 4) & F.col("_n4").isNotNull() & (F.col("_n4.id") > F.coalesce("_n3.id", F.lit(""))), F.col("_n4._t"))
    return s.withColumn("path", F.array_compact(F.array(first, second, F.col("_t")))).drop("_t", "_p3", "_p4", "_n3", "_n4")


def chunks_of(sections: DataFrame) -> DataFrame:
    """A chunk per section: clean title, content, counts, tables and their headers (twelve at most), snippet, page hint, reference code."""
    content = F.array_join(F.filter("blocks.content", lambda x: x.isNotNull()), "\n\n")
    tables = F.filter("blocks", lambda b: b["block_type"] == "table")
    head = F.transform(tables, lambda b: cells_of(F.regexp_extract(F.coalesce(b["content"], F.lit("")), "(?m)^(\\|[^\\n]*)$", 1)))
    s = with_path(sections).withColumn("_c", content)
    return s.select(
        "id", "doc_id", "level", clean_title("title").alias("clean_title"), F.array_join("path", " > ").alias("breadcrumb"), F.length("_c").alias("chars"),
        F.size(F.filter(F.split("_c", "\\s+"), lambda x: x != "")).alias("words"), F.size(tables).alias("tables"), F.array_join(F.slice(F.filter(F.array_distinct(F.flatten(head)), lambda x: x != ""), 1, 12), "|").alias("headers"),
        F.substring(F.regexp_replace(F.col("_c"), "\\s+", " "), 1, 350).alias("snippet"), F.concat(F.lit("Trang "), F.col("page_start")).alias("page_hint"),
    )


def with_codes(sections: DataFrame) -> DataFrame:
    """Sections with `code` (a core statement's own or a roman number; V.n for notes; V.n(x) below, of the note above) and `chunk_id`, made of document, level, code or title, and place."""
    w = W.partitionBy("doc_id").orderBy("id")
    part = lambda p: F.nullif(F.regexp_extract("title", p, 1), F.lit(""))
    s = sections.withColumn("_n", part("^\\s*([0-9]{1,2})\\s*[.)]")).withColumn("_note", F.last(F.when(F.col("level") == 4, F.col("_n")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    core = F.when(F.col("canonical_code").startswith("CORE_"), F.col("canonical_code"))
    letter = part("^\\s*([a-zđ])\\s*[.)]\\s")
    code = F.when(F.col("level") == 3, F.coalesce(core, part("^\\s*([IVX]+)\\s*[.)]"))).when(F.col("level") == 4, F.concat(F.lit("V."), F.col("_n"))).when(F.col("level") == 5, F.concat(F.lit("V."), F.col("_note"), F.lit("("), letter, F.lit(")")))
    s = s.withColumn("code", code).withColumn("_k", F.row_number().over(w))
    tail = F.coalesce("code", slug(clean_title(F.coalesce("title", F.lit(""))), 30))
    return s.withColumn("chunk_id", F.concat(F.col("doc_id"), F.lit("_c_h"), F.col("level"), F.lit("_"), tail, F.lit("_"), F.lpad(F.col("_k").cast("string"), 3, "0"))).drop("_n", "_note", "_k")


def table_runs(texts: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """(key, run, begin, lines, rows): runs of contiguous table lines of a text, of `least` lines or more; lines from 0."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "_x")).withColumn("_pipe", F.trim("_x").startswith("|"))
    w = W.partitionBy(key).orderBy("line")
    new = F.when(F.col("_pipe") & ~F.coalesce(F.lag("_pipe").over(w), F.lit(False)), 1).otherwise(0)
    runs = lines.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_pipe")
    return runs.groupBy(key, "run").agg(F.min("line").alias("begin"), F.count("*").alias("lines"), F.count_if(~F.trim("_x").rlike(SEPARATOR)).alias("rows")).where(F.col("lines") >= least)


def pages_to_sections(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks with the section that covers their page, the last one in order where several do. The ranges are spread to pages, so the join is on equality."""
    spread = sections.where("page_start is not null and page_end >= page_start").select("doc_id", "id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    last = spread.groupBy("doc_id", "page").agg(F.max("id").alias("section_id"))
    return blocks.join(last, ["doc_id", "page"], "left")


def body_under_headings(blocks: DataFrame) -> DataFrame:
    """Blocks in reading order with the block that holds the heading above them; blocks before any have none."""
    w = W.partitionBy("doc_id").orderBy("page", "place").rowsBetween(W.unboundedPreceding, 0)
    first = F.get(F.split("content", "\n"), F.lit(0))
    b = blocks.withColumn("heading", F.when(F.col("block_type") == "text", F.when(heading_kind(first).isNotNull(), first)))
    return b.withColumn("under", F.last(F.when(F.col("heading").isNotNull(), F.col("block_id")), ignorenulls=True).over(w))


def accepted_numbers(df: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """(key, accepted): the note numbers of a document that go on from the last accepted one; from 20 on, a number of 5 or less begins anew.

    The fold runs over a sorted array within the JVM; a document's headings bound it.
    """
    g = df.where(F.col(number).isNotNull()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, number))), lambda x: x[number]).alias("_n"))
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
    fold = F.aggregate("_n", F.array().cast("array<int>"), lambda acc, x: F.when((x > last(acc)) | ((last(acc) >= 20) & (x <= 5)), F.concat(acc, F.array(x))).otherwise(acc))
    return g.select(key, F.size("_n").alias("numbers"), fold.alias("accepted"))


# ---- Queries ----------------------------------------------------------------------------------------


def section_paths(spark: SparkSession, d: str) -> DataFrame:
    return with_path(table(spark, d, "sections").drop("blocks")).select("id", F.array_join("path", " > ").alias("path"))


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(table(spark, d, "sections")).select("id", "clean_title", "chars", "words", "tables", "headers", F.length("snippet").alias("snippet_length"), "page_hint")


def section_codes(spark: SparkSession, d: str) -> DataFrame:
    return with_codes(table(spark, d, "sections").drop("blocks")).select("id", "code", "chunk_id")


def section_spans(spark: SparkSession, d: str) -> DataFrame:
    """Pages, blocks and tables of the sections of each document and type."""
    s = table(spark, d, "sections")
    return s.groupBy("doc_id", "section_type").agg(F.min("page_start").alias("first"), F.max("page_end").alias("last"), F.sum(F.size("blocks")).alias("blocks"), F.bool_or(F.exists("blocks", lambda b: b["block_type"] == "table")).alias("has_table"))


def chunk_table_runs(spark: SparkSession, d: str) -> DataFrame:
    return table_runs(table(spark, d, "chunks").where("full_content is not null"), "chunk_id", "full_content")


def chunk_headings(spark: SparkSession, d: str) -> DataFrame:
    """Markdown headings of chunk contents with the line after which the next one begins."""
    lines = table(spark, d, "chunks").select("chunk_id", F.posexplode(F.split("full_content", "\n")).alias("line", "x"))
    h = lines.where(F.col("x").rlike("^#{1,6}\\s+\\S"))
    w = W.partitionBy("chunk_id").orderBy("line")
    return h.select("chunk_id", "line", F.length(F.regexp_extract("x", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("x", "^#+\\s+", "")).alias("title"), F.lead("line").over(w).alias("next_line"))


def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.groupBy("level").agg(F.count("*").alias("chunks"), F.count_if("has_table").alias("with_table"), F.sum("table_count").alias("tables"), F.count_if("needs_spellcheck").alias("spellcheck"))


def block_sections(spark: SparkSession, d: str) -> DataFrame:
    return pages_to_sections(once(table(spark, d, "blocks")).select("doc_id", "block_id", "page"), table(spark, d, "sections")).select("doc_id", "block_id", "section_id")


def block_headings(spark: SparkSession, d: str) -> DataFrame:
    b = body_under_headings(reading_order(once(table(spark, d, "blocks"))))
    return b.groupBy("doc_id", "under").agg(F.count("*").alias("blocks"), F.max("heading").alias("heading"))


def section_page_sets(spark: SparkSession, d: str) -> DataFrame:
    """The pages of core statements and of notes of each document, shifted by a page, within its pages, each once."""
    s = table(spark, d, "sections").where("page_start is not null and page_end >= page_start")
    total = s.groupBy("doc_id").agg(F.max("page_end").alias("_total"))
    p = s.select("doc_id", "section_type", F.explode(F.transform(F.sequence("page_start", "page_end"), lambda x: x + 1)).alias("p")).join(total, "doc_id").where("p between 1 and _total")
    return p.groupBy("doc_id", "section_type").agg(F.array_join(F.transform(F.array_sort(F.collect_set("p")), lambda x: x.cast("string")), ",").alias("pages"))


def note_numbers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select("doc_id", "id", F.regexp_extract("title", "^\\s*([0-9]{1,2})\\s*[.)]", 1).try_cast("int").alias("n"))
    return accepted_numbers(s, "doc_id", "id", "n").select("doc_id", "numbers", F.array_join(F.col("accepted").cast("array<string>"), ",").alias("accepted"))


QUERIES = {f.__name__: f for f in (section_paths, section_chunks, section_codes, section_spans, chunk_table_runs, chunk_headings, chunk_summary, block_sections, block_headings, section_page_sets, note_numbers)}
_NUMBERING = "^\\s*(?:[IVXLC]+|[0-9]{1,2}(?:\\.[0-9]+)*|[a-zA-Z])\\s*[.)]\\s+"
_TITLE = lambda c: f"trim(regexp_replace(regexp_replace({c}, '{_NUMBERING}', ''), '\\s+', ' ', 'g'))"
ORACLES = {
    "section_chunks": f"""
WITH c AS (SELECT id, title, page_start, blocks, array_to_string(list_filter(list_transform(blocks, lambda b: b.content), lambda x: x IS NOT NULL), chr(10) || chr(10)) AS c FROM sections),
t AS (SELECT *, list_filter(blocks, lambda b: b.block_type = 'table') AS t FROM c),
h AS (SELECT *, list_filter(flatten(list_transform(t, lambda b: list_transform(string_split(regexp_replace(regexp_replace(trim(regexp_extract(coalesce(b.content, ''), '(?m)^(\\|[^\\n]*)$', 1)), '^\\|', ''), '\\|$', ''), '|'), lambda x: trim(x)))), lambda x: x <> '') AS h FROM t)
SELECT id, {_TITLE("title")} AS clean_title, length(c)::int AS chars, len(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: x <> ''))::int AS words, len(t)::int AS tables,
  array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i)[1:12], '|') AS headers, least(350, length(regexp_replace(c, '\\s+', ' ', 'g')))::int AS snippet_length, 'Trang ' || page_start AS page_hint
FROM h
""",
    "section_paths": f"""
WITH s AS (SELECT id, doc_id, level, {_TITLE("coalesce(title, '')")} AS t FROM sections),
n AS (SELECT *, last_value(CASE WHEN level = 3 THEN t END IGNORE NULLS) OVER w AS t3, last_value(CASE WHEN level = 3 THEN id END IGNORE NULLS) OVER w AS i3,
  last_value(CASE WHEN level = 4 THEN t END IGNORE NULLS) OVER w AS t4, last_value(CASE WHEN level = 4 THEN id END IGNORE NULLS) OVER w AS i4 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY id ROWS UNBOUNDED PRECEDING))
SELECT id, array_to_string(list_filter([CASE WHEN level > 3 THEN t3 END, CASE WHEN level > 4 AND i4 > coalesce(i3, '') THEN t4 END, t], lambda x: x IS NOT NULL), ' > ') AS path FROM n
""",
    "section_codes": f"""
WITH n AS (SELECT *, nullif(regexp_extract(title, '^\\s*([0-9]{{1,2}})\\s*[.)]', 1), '') AS n, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS k, {_TITLE("coalesce(title, '')")} AS t FROM sections),
m AS (SELECT *, last_value(CASE WHEN level = 4 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS note,
  regexp_replace(substr(regexp_replace(trim(regexp_replace(translate(lower(t), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9_\\s-]', '', 'g')), '[\\s_-]+', '-', 'g'), 1, 30), '^-+|-+$', '', 'g') AS s FROM n),
c AS (SELECT *, CASE level WHEN 3 THEN coalesce(CASE WHEN canonical_code LIKE 'CORE\\_%' ESCAPE '\\' THEN canonical_code END, nullif(regexp_extract(title, '^\\s*([IVX]+)\\s*[.)]', 1), ''))
  WHEN 4 THEN 'V.' || n WHEN 5 THEN 'V.' || note || '(' || nullif(regexp_extract(title, '^\\s*([a-zđ])\\s*[.)]\\s', 1), '') || ')' END AS code FROM m)
SELECT id, code, doc_id || '_c_h' || level || '_' || coalesce(code, CASE WHEN s <> '' THEN s ELSE 'section' END) || '_' || lpad(k::VARCHAR, 3, '0') AS chunk_id FROM c
""",
    "section_spans": "SELECT doc_id, section_type, min(page_start) AS first, max(page_end) AS last, sum(len(blocks))::BIGINT AS blocks, bool_or(len(list_filter(blocks, lambda b: b.block_type = 'table')) > 0) AS has_table FROM sections GROUP BY ALL",
    "chunk_table_runs": """
WITH l AS (SELECT chunk_id, unnest(string_split(full_content, chr(10))) AS x, generate_subscripts(string_split(full_content, chr(10)), 1) - 1 AS line FROM chunks WHERE full_content IS NOT NULL),
p AS (SELECT *, starts_with(trim(x), '|') AS pipe FROM l), q AS (SELECT *, CASE WHEN pipe AND NOT coalesce(lag(pipe) OVER (PARTITION BY chunk_id ORDER BY line), false) THEN 1 ELSE 0 END AS n FROM p),
r AS (SELECT *, sum(n) OVER (PARTITION BY chunk_id ORDER BY line ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM q)
SELECT chunk_id, run, min(line)::int AS begin, count(*) AS lines, count(*) FILTER (WHERE NOT regexp_matches(trim(x), '^\\|[-: |]+\\|$')) AS rows FROM r WHERE pipe GROUP BY ALL HAVING count(*) >= 2
""",
    "chunk_headings": """
WITH l AS (SELECT chunk_id, unnest(string_split(full_content, chr(10))) AS x, (generate_subscripts(string_split(full_content, chr(10)), 1) - 1)::int AS line FROM chunks)
SELECT chunk_id, line, length(regexp_extract(x, '^(#+)', 1))::int AS level, trim(regexp_replace(x, '^#+\\s+', '')) AS title, lead(line) OVER (PARTITION BY chunk_id ORDER BY line) AS next_line FROM l WHERE regexp_matches(x, '^#{1,6}\\s+\\S')
""",
    "chunk_summary": "SELECT level, count(*) AS chunks, count(*) FILTER (WHERE has_table) AS with_table, sum(table_count)::BIGINT AS tables, count(*) FILTER (WHERE needs_spellcheck) AS spellcheck FROM chunks GROUP BY level",
    "block_sections": f"WITH {ONCE}, s AS (SELECT doc_id, id, unnest(range(page_start, page_end + 1)) AS page FROM sections WHERE page_end >= page_start), l AS (SELECT doc_id, page, max(id) AS section_id FROM s GROUP BY ALL) SELECT b.doc_id, b.block_id, section_id FROM b LEFT JOIN l ON b.doc_id = l.doc_id AND b.page = l.page",
    "section_page_sets": "WITH t AS (SELECT doc_id, max(page_end) AS total FROM sections WHERE page_end >= page_start GROUP BY 1), p AS (SELECT DISTINCT doc_id, section_type, unnest(range(page_start, page_end + 1)) + 1 AS p FROM sections WHERE page_end >= page_start) SELECT doc_id, section_type, string_agg(p::VARCHAR, ',' ORDER BY p) AS pages FROM p JOIN t USING (doc_id) WHERE p BETWEEN 1 AND total GROUP BY ALL",
}
