"""Documents and results as text: Markdown of documents and sections, JSON of chunks and manifests, reports of evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import demoted, without_images
from ledgerloom.operators import evaluate
from ledgerloom.operators.blocks import ONCE, classified, document_kinds, once, page_kinds, reading_order
from ledgerloom.tables import table


def markdown_of(blocks: DataFrame, title: str = "doc_id") -> DataFrame:
    """(doc_id, markdown): the blocks of a document in reading order under its title, headings one level down, blocks that only repeat the title left out.

    One document is one text, so a group is as large as a document.
    """
    text = demoted(without_images(F.coalesce("content", F.lit(""))))
    b = blocks.withColumn("_x", text).where(F.col("_x") != "").where(F.lower(F.trim("_x")) != F.lower(F.trim(F.col(title))))
    g = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "place", "_x"))).alias("_b"))
    return g.select("doc_id", F.concat(F.lit("# "), F.col("doc_id"), F.lit("\n\n"), F.array_join(F.transform("_b", lambda x: x["_x"]), "\n\n")).alias("markdown"))


def chunk_json(chunks: DataFrame) -> DataFrame:
    """(chunk_id, json): each chunk with its place in the hierarchy and its table summary."""
    body = F.to_json(F.struct("chunk_id", "doc_id", "level", F.col("clean_title").alias("title"), "reference_code", F.struct("breadcrumb", "breadcrumb_path", "parent_id").alias("hierarchy"), F.struct("has_table", "table_count", "table_headers").alias("tables")))
    return chunks.select("chunk_id", body.alias("json"))


def manifest(blocks: DataFrame) -> DataFrame:
    """(doc_id, json): what was read of each document: its kind, pages, blocks by source and class, and the tables without unit."""
    pages = document_kinds(page_kinds(blocks)).select("doc_id", "kind", (F.col("text_pages") + F.col("scanned_pages")).alias("pages"))
    c = classified(blocks).groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("source") == "pdfplumber").alias("text_blocks"), F.count_if(F.col("source").isin("ocr", "local_ocr")).alias("scanned_blocks"),
        F.count_if(F.col("label") == "FINANCIAL_STATEMENT").alias("statements"), F.count_if((F.col("block_type") == "table") & F.col("unit").isNull()).alias("tables_without_unit"),
    )
    j = pages.join(c, "doc_id")
    return j.select("doc_id", F.to_json(F.struct(*[x for x in j.columns if x != "doc_id"])).alias("json"))


def evaluation_report(results: DataFrame) -> str:
    """A Markdown report of scored pairs, from two small aggregates."""
    s = evaluate.summary(results).first().asDict()
    kinds = results.select(F.explode("errors").alias("e")).groupBy("e").count().orderBy(F.desc("count"), "e").collect()
    lines = ["# Table structure", "", "| measure | value |", "|---|---|", *[f"| {k} | {v} |" for k, v in s.items()], "", "| error | tables |", "|---|---|", *[f"| {r['e']} | {r['count']} |" for r in kinds]]
    return "\n".join(lines)


# ---- Queries ----------------------------------------------------------------------------------------


def document_markdown(spark: SparkSession, d: str) -> DataFrame:
    m = markdown_of(reading_order(once(table(spark, d, "blocks"))))
    return m.select("doc_id", F.length("markdown").alias("length"), F.size(F.split("markdown", "\n")).alias("lines"))


def chunks_as_json(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_json(table(spark, d, "chunks"))
    back = F.from_json("json", "chunk_id string, level int, title string, reference_code string, hierarchy struct<breadcrumb:string,breadcrumb_path:array<string>,parent_id:string>, tables struct<has_table:boolean,table_count:int,table_headers:array<string>>")
    return c.select(back.alias("b")).select("b.chunk_id", "b.level", "b.title", "b.reference_code", "b.hierarchy.breadcrumb", F.array_join("b.hierarchy.breadcrumb_path", ">").alias("path"), "b.hierarchy.parent_id", "b.tables.table_count", F.size("b.tables.table_headers").alias("headers"))


def document_manifests(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(once(table(spark, d, "blocks")))
    return m.select("doc_id", F.from_json("json", "kind string, pages bigint, blocks bigint, text_blocks bigint, scanned_blocks bigint, statements bigint, tables_without_unit bigint").alias("j")).select("doc_id", "j.*")


QUERIES = {f.__name__: f for f in (document_markdown, chunks_as_json, document_manifests)}
ORACLES = {
    "chunks_as_json": "SELECT chunk_id, level, clean_title AS title, reference_code, breadcrumb, array_to_string(breadcrumb_path, '>') AS path, parent_id, table_count, len(table_headers)::INT AS headers FROM chunks",
    "document_manifests": f"""
WITH {ONCE}, p AS (SELECT doc_id, page, CASE WHEN bool_or(block_type = 'table') OR (coalesce(sum(length(trim(content))), 0) >= 50 AND NOT bool_or(coalesce(meta['is_scanned'] = 'true', false))) THEN 1 ELSE 0 END AS t FROM b GROUP BY ALL),
k AS (SELECT doc_id, count(*) AS pages, CASE WHEN sum(t) = count(*) THEN 'native' WHEN sum(t) = 0 THEN 'scanned' WHEN sum(t) / count(*) >= 0.75 THEN 'native' ELSE 'hybrid' END AS kind FROM p GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE source = 'pdfplumber') AS text_blocks, count(*) FILTER (WHERE source IN ('ocr', 'local_ocr')) AS scanned_blocks,
  count(*) FILTER (WHERE block_type = 'table' AND unit IS NULL) AS tables_without_unit FROM b GROUP BY doc_id),
s AS (SELECT doc_id, count(*) FILTER (WHERE label = 'FINANCIAL_STATEMENT') AS statements FROM (BLOCK_CLASSES) GROUP BY doc_id)
SELECT doc_id, kind, pages, blocks, text_blocks, scanned_blocks, statements, tables_without_unit FROM k JOIN c USING (doc_id) JOIN s USING (doc_id)
""",
}
from ledgerloom.operators.blocks import ORACLES as _B  # noqa: E402

ORACLES["document_manifests"] = ORACLES["document_manifests"].replace("BLOCK_CLASSES", _B["block_classes"])
