"""The whole path from page blocks to audited statements, as one plan per question; Catalyst sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import audit, blocks, facts, units
from ledgerloom.tables import table


def facts_of_blocks(b: DataFrame, concepts: DataFrame) -> DataFrame:
    """Long facts of the statement tables of blocks: reading order, extraction, mapping, one row per value; unknown rows are kept with a null concept."""
    rows = facts.mapped(facts.table_rows(blocks.once(b)), concepts)
    return facts.unpivoted(rows)


def audited_documents(spark: SparkSession, d: str) -> DataFrame:
    """Per document: facts, concepts, checks, failed checks and ratios, from tables as they are; base_unit_shares has the share of facts in base units."""
    f, c = table(spark, d, "financial_facts"), table(spark, d, "concept_definitions")
    chosen = facts.winners(audit.current(f), c)
    w = audit.wide(chosen)
    counts = f.groupBy("doc_id").agg(F.count("*").alias("facts"), F.countDistinct("concept").alias("concepts"))
    reports = audit.reports(audit.checked(w)).select("doc_id", "checks", "failed")
    rs = audit.ratios(w).groupBy("doc_id").agg(F.count("*").alias("ratios"))
    out = counts.join(reports, "doc_id", "left").join(rs, "doc_id", "left")
    return out.select("doc_id", "facts", "concepts", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("checks", "failed", "ratios")])


def extracted_against_stored(spark: SparkSession, d: str) -> DataFrame:
    """Facts read anew from blocks against the stored ones, by concept: how many documents have each, and both."""
    new = facts_of_blocks(table(spark, d, "blocks"), table(spark, d, "concept_definitions")).where("concept is not null").select("doc_id", "concept").distinct()
    old = table(spark, d, "financial_facts").where("concept is not null").select("doc_id", "concept").distinct()
    both = new.withColumn("n", F.lit(1)).join(old.withColumn("o", F.lit(1)), ["doc_id", "concept"], "full_outer")
    known = table(spark, d, "concept_definitions").select("concept")
    return both.join(known, "concept", "left_semi").groupBy("concept").agg(F.count("n").alias("read"), F.count("o").alias("stored"), F.count_if(F.col("n").isNotNull() & F.col("o").isNotNull()).alias("both"))


def _converted(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "financial_facts").select("seq", "doc_id", "table_id", "raw_label", "unit", "value")
    return units.converted(f, table(spark, d, "blocks"), table(spark, d, "unit_definitions"))


def values_in_base_units(spark: SparkSession, d: str) -> DataFrame:
    """Every fact, of all concepts and periods: its value in the base unit against the recorded one."""
    return _converted(spark, d).select("seq", "doc_id", "unit_code", "value", "base_value")


def base_unit_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per document: facts and the share of them recorded in base units."""
    return _converted(spark, d).groupBy("doc_id").agg(F.count("*").alias("facts"), F.avg((F.col("unit_code") == F.col("base_unit")).cast("int")).alias("in_base_units"))


QUERIES = {f.__name__: f for f in (audited_documents, extracted_against_stored, values_in_base_units, base_unit_shares)}
ORACLES = {
    "values_in_base_units": f"{units._UNITS} SELECT seq, doc_id, unit_code, value, value * factor AS base_value FROM r JOIN financial_facts USING (seq) JOIN unit_definitions USING (unit_code)",
    "base_unit_shares": f"{units._UNITS} SELECT doc_id, count(*) AS facts, avg((unit_code = base_unit)::INT) AS in_base_units FROM r JOIN financial_facts USING (seq) JOIN unit_definitions USING (unit_code) GROUP BY doc_id",
    "audited_documents": f"""
WITH {audit._C}, n AS (SELECT doc_id, count(*) AS facts, count(DISTINCT concept) AS concepts FROM financial_facts GROUP BY 1), k AS (SELECT doc_id, count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed FROM ch GROUP BY 1),
r AS (SELECT doc_id, count(*) AS ratios FROM ({audit._sql_ratios()}) GROUP BY 1)
SELECT n.doc_id, facts, concepts, coalesce(checks, 0) AS checks, coalesce(failed, 0) AS failed, coalesce(ratios, 0) AS ratios FROM n LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
""",
}
