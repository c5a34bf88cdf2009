"""The four stored tables: their definition, ratios and reports as they are stored, and the scan that reads ratios back."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import json_list
from ledgerloom.operators import audit
from ledgerloom.operators.upserts import upserted
from ledgerloom.tables import table

# The tables, their columns, and what they are partitioned by, in place of indexes.
TABLES = {
    "companies": ("code STRING, name STRING, industry STRING, created_at TIMESTAMP", []),
    "financial_statements": ("id STRING, period STRING, statement_type STRING, source_file STRING, is_balanced BOOLEAN, total_checks INT, passed_checks STRING, failed_checks STRING, created_at TIMESTAMP, company STRING, year INT", ["company", "year"]),
    "financial_facts": ("id STRING, prov_id STRING, period STRING, period_type STRING, concept STRING, standard_code STRING, raw_label STRING, value DOUBLE, unit STRING, page INT, table_id STRING, source STRING, confidence DOUBLE, verification_status STRING, verification_detail STRING, created_at TIMESTAMP, company STRING, year INT", ["company", "year"]),
    "financial_ratios": ("id STRING, ratio_name STRING, ratio_category STRING, value DOUBLE, formula STRING, input_prov_ids STRING, is_deterministic BOOLEAN, created_at TIMESTAMP, company STRING, year INT", ["company", "year"]),
}
# What a second report of the same id leaves as first stored.
REPORT_UPDATES = ["is_balanced", "total_checks", "passed_checks", "failed_checks"]


def create(spark: SparkSession, database: str = "default", format_: str = "parquet") -> list[str]:
    """The tables that are missing are created, the others stay as they are; their names."""
    for name, (columns, by) in TABLES.items():
        parts = f" PARTITIONED BY ({', '.join(by)})" if by else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING {format_}{parts}")
    return list(TABLES)


def default_store(folders: list[str]) -> str | None:
    """The first of some folders that exists."""
    return next((f for f in folders if os.path.isdir(f)), None)


def fact_ids(company: Column, year: Column, page: Column, table_id: Column, row: Column, period_type: Column) -> tuple[Column, Column]:
    """(prov_id, id) of a fact: where it stands, and that with the first letter of its period."""
    prov = F.concat_ws("_", company, year.cast("string"), F.concat(F.lit("p"), page.cast("string")), table_id, F.concat(F.lit("r"), row.cast("string")))
    return prov, F.concat_ws("_", prov, F.substring(period_type, 1, 1))


def ratio_rows(ratios: DataFrame, documents: DataFrame) -> DataFrame:
    """Ratios as rows of the store: id {company}_{year}_{ratio}, inputs as a JSON list. documents: doc_id, company, year."""
    r = ratios.join(documents, "doc_id")
    ident = F.concat_ws("_", "company", F.col("year").cast("string"), "ratio")
    return r.select(ident.alias("id"), F.col("ratio").alias("ratio_name"), F.col("category").alias("ratio_category"), "value", F.to_json(F.split("inputs", ",")).alias("input_prov_ids"), F.lit(True).alias("is_deterministic"), "company", "year", "doc_id")


def stored_ratios(rows: DataFrame) -> DataFrame:
    """Stored ratios by category and name, their inputs as a list; broken JSON is an empty list."""
    return rows.withColumn("inputs", json_list(F.col("input_prov_ids"))).orderBy("ratio_category", "ratio_name", "id")


def report_rows(reports: DataFrame, documents: DataFrame, kind: str = "CONSOLIDATED") -> DataFrame:
    """Reports as rows of the store: id {COMPANY}_{year}_{kind}. documents: doc_id, company, year, period, source_file."""
    r = reports.join(documents, "doc_id")
    ident = F.concat_ws("_", F.upper("company"), F.col("year").cast("string"), F.lit(kind))
    ids = F.to_json(F.filter(F.split("failed_ids", ","), lambda x: x != ""))
    return r.select(ident.alias("id"), "company", "year", "period", F.lit(kind).alias("statement_type"), "source_file", F.col("balanced").alias("is_balanced"), F.col("checks").cast("int").alias("total_checks"), ids.alias("failed_checks"), F.col("passed").cast("string").alias("passed_checks"), "doc_id")


def reports_upserted(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Reports with new ones: the outcome of a known id is taken over, its source file and period stay."""
    return upserted(old, new, "id", REPORT_UPDATES, order)


# ---- Queries ----------------------------------------------------------------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "financial_facts").groupBy("doc_id").agg(F.min("company").alias("company"), F.min("year").alias("year"))


def ratio_store(spark: SparkSession, d: str) -> DataFrame:
    """Ratios written as rows of the store and read back."""
    rows = stored_ratios(ratio_rows(audit.statement_ratios(spark, d), _documents(spark, d)))
    return rows.select("doc_id", "id", "ratio_name", "ratio_category", "value", F.size("inputs").alias("inputs"), F.element_at("inputs", 1).alias("first_input"))


def report_store(spark: SparkSession, d: str) -> DataFrame:
    """Audit reports as rows of the store; of documents of one company and year the last by document holds, the source of the first stays."""
    docs = _documents(spark, d).withColumns({"period": F.col("year").cast("string"), "source_file": F.col("doc_id")})
    rows = report_rows(audit.audit_reports(spark, d), docs).where("company is not null and year is not null")
    return reports_upserted(rows.where("false"), rows, "doc_id").select("id", "company", "year", "source_file", "is_balanced", "total_checks", "failed_checks")


QUERIES = {f.__name__: f for f in (ratio_store, report_store)}
_DOCS = "docs AS (SELECT doc_id, min(company) AS company, min(year) AS year FROM financial_facts GROUP BY doc_id)"
ORACLES = {
    "ratio_store": f"WITH {audit._WINNERS}, {_DOCS}, q AS ({audit._sql_ratios()}) SELECT q.doc_id, concat_ws('_', company, year::VARCHAR, ratio) AS id, ratio AS ratio_name, category AS ratio_category, value, len(string_split(inputs, ',')) AS inputs, string_split(inputs, ',')[1] AS first_input FROM q JOIN docs USING (doc_id)",
    "report_store": f"""WITH {audit._C}, {_DOCS}, r AS (SELECT doc_id, count(*) AS checks, string_agg('"' || check_id || '"', ',' ORDER BY check_id) FILTER (WHERE NOT passed) AS failed, bool_and(passed) AS balanced FROM ch GROUP BY doc_id),
n AS (SELECT *, upper(company) || '_' || year || '_CONSOLIDATED' AS id FROM r JOIN docs USING (doc_id) WHERE company IS NOT NULL AND year IS NOT NULL)
SELECT id, first(company ORDER BY doc_id) AS company, first(year ORDER BY doc_id) AS year, first(doc_id ORDER BY doc_id) AS source_file, last(balanced ORDER BY doc_id) AS is_balanced, last(checks ORDER BY doc_id)::INT AS total_checks, '[' || last(coalesce(failed, '') ORDER BY doc_id) || ']' AS failed_checks FROM n GROUP BY id""",
}
