"""The query surface: catalog, filtered reads, counts, ad-hoc SQL, dumps, set operations, grouping sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.tables import table

# Short names of tables.
ALIASES = {"fact": "financial_facts", "facts": "financial_facts", "company": "companies", "companies": "companies", "concept": "concept_definitions", "concepts": "concept_definitions", "section": "sections", "chunk": "chunks", "block": "blocks", "unit": "unit_definitions", "document": "documents"}
TABLES = ["companies", "concept_definitions", "unit_definitions", "blocks", "sections", "chunks", "financial_facts", "documents", "eval_items"]


def named(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table by its name or a short name."""
    return table(spark, d, ALIASES.get(name.strip().lower(), name))


def filtered(df: DataFrame, company: str | None = None, year: int | None = None, status: str | None = None, order: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Rows by optional equality filters (texts without case or outer blanks), in an order (a leading minus: descending), as many as `limit`; 0 is all."""
    conditions = [F.upper(F.trim(F.col(c))) == v.strip().upper() for c, v in (("company", company), ("verification_status", status)) if v]
    if year is not None:
        conditions.append(F.col("year") == year)
    out = df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
    if order:
        out = out.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order])
    return out.limit(limit) if limit > 0 else out


def register(spark: SparkSession, d: str) -> list[str]:
    """All tables of a directory as views, for ad-hoc SQL; their names in order."""
    for t in TABLES:
        table(spark, d, t).createOrReplaceTempView(t)
    return sorted(t.name for t in spark.catalog.listTables() if t.name in TABLES)


def dumped(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, null fields left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


# ---- Queries ----------------------------------------------------------------------------------------


def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table."""
    parts = [table(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


def fact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Facts, verified ones, discrepancies and concepts by company and year, in one pass."""
    f = table(spark, d, "financial_facts")
    return f.groupBy("company", "year").agg(F.count("*").alias("facts"), F.count_if(F.col("verification_status") == "VERIFIED").alias("verified"), F.count_if(F.col("verification_status") == "DISCREPANCY").alias("discrepancies"), F.countDistinct("concept").alias("concepts"))


def facts_of_largest_company(spark: SparkSession, d: str) -> DataFrame:
    """All facts of the company with most, read with its code as a filter; typed columns with their defaults."""
    f = table(spark, d, "financial_facts")
    top = f.where("company is not null").groupBy("company").count().orderBy(F.desc("count"), "company").first()
    out = filtered(f, company=top["company"] if top else "", order=None, limit=0)
    return out.select("seq", "company", "year", F.coalesce("unit", F.lit("VND")).alias("unit"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.when(F.col("verification_status").isin("VERIFIED", "DISCREPANCY", "UNCHECKED", "VERIFIED_AFTER_ZOOM_CORRECTION"), F.col("verification_status")).otherwise("UNCHECKED").alias("status"))


def top_facts(spark: SparkSession, d: str) -> DataFrame:
    """The hundred largest facts, a top-k report."""
    f = table(spark, d, "financial_facts").where("value is not null").select("seq", "company", "year", "concept", "value")
    return filtered(f, order=["-value", "seq"], limit=100)


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Facts by source and status with subtotals and a total."""
    f = table(spark, d, "financial_facts")
    return f.rollup("source", "verification_status").agg(F.count("*").alias("facts"), F.grouping_id().cast("int").alias("level"))


def source_cube(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "financial_facts")
    return f.cube("source", "period_type").agg(F.count("*").alias("facts"), F.count("value").alias("with_value"), F.grouping_id().cast("int").alias("level"))


def adhoc_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d)
    return spark.sql("SELECT year, doc_type, count(*) AS documents FROM documents GROUP BY GROUPING SETS ((year), (doc_type), ())")


def distinct_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct concepts and companies by source."""
    return table(spark, d, "financial_facts").groupBy("source").agg(F.countDistinct("concept").alias("concepts"), F.countDistinct("company").alias("companies"))


def document_sets(spark: SparkSession, d: str) -> DataFrame:
    """Documents of blocks against those of facts: in both, in one only, and in all, with set operators."""
    b, f = table(spark, d, "blocks").select("doc_id"), table(spark, d, "financial_facts").select("doc_id")
    both, left, right, every = b.intersect(f), b.distinct().exceptAll(f.distinct()), f.subtract(b), b.union(f).distinct()
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("documents")).select(F.lit(n).alias("part"), "documents") for n, x in (("both", both), ("blocks_only", left), ("facts_only", right), ("all", every))])


def companies_json(spark: SparkSession, d: str) -> DataFrame:
    """Companies as JSON and read back: whether the round trip keeps them."""
    c = table(spark, d, "companies").select("code", "name", "industry")
    j = dumped(c)
    back = F.from_json("json", "code string, name string, industry string")
    return j.select("json", back.alias("b")).select(F.col("b.code").alias("code"), F.col("b.name").alias("name"), F.col("b.industry").alias("industry"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Events by type: JSON properties read, their sum and range."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.count("k").alias("with_k"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


QUERIES = {f.__name__: f for f in (catalog_counts, fact_counts, facts_of_largest_company, top_facts, status_rollup, source_cube, adhoc_grouping_sets, distinct_concepts, document_sets, companies_json, event_properties)}
ORACLES = {
    "catalog_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES),
    "fact_counts": "SELECT company, year, count(*) AS facts, count(*) FILTER (WHERE verification_status = 'VERIFIED') AS verified, count(*) FILTER (WHERE verification_status = 'DISCREPANCY') AS discrepancies, count(DISTINCT concept) AS concepts FROM financial_facts GROUP BY ALL",
    "facts_of_largest_company": """
SELECT seq, company, year, coalesce(unit, 'VND') AS unit, coalesce(confidence, 1.0) AS confidence, CASE WHEN verification_status IN ('VERIFIED', 'DISCREPANCY', 'UNCHECKED', 'VERIFIED_AFTER_ZOOM_CORRECTION') THEN verification_status ELSE 'UNCHECKED' END AS status
FROM financial_facts WHERE upper(trim(company)) = (SELECT upper(trim(company)) FROM financial_facts WHERE company IS NOT NULL GROUP BY company ORDER BY count(*) DESC, company LIMIT 1)
""",
    "top_facts": "SELECT seq, company, year, concept, value FROM financial_facts WHERE value IS NOT NULL ORDER BY value DESC, seq LIMIT 100",
    "status_rollup": "SELECT source, verification_status, count(*) AS facts, grouping_id(source, verification_status)::int AS level FROM financial_facts GROUP BY ROLLUP (source, verification_status)",
    "source_cube": "SELECT source, period_type, count(*) AS facts, count(value) AS with_value, grouping_id(source, period_type)::int AS level FROM financial_facts GROUP BY CUBE (source, period_type)",
    "adhoc_grouping_sets": "SELECT year, doc_type, count(*) AS documents FROM documents GROUP BY GROUPING SETS ((year), (doc_type), ())",
    "distinct_concepts": "SELECT source, count(DISTINCT concept) AS concepts, count(DISTINCT company) AS companies FROM financial_facts GROUP BY source",
    "document_sets": """
WITH b AS (SELECT DISTINCT doc_id FROM blocks), f AS (SELECT DISTINCT doc_id FROM financial_facts)
SELECT 'both' AS part, count(*) AS documents FROM b JOIN f USING (doc_id) UNION ALL SELECT 'blocks_only', count(*) FROM b ANTI JOIN f USING (doc_id) UNION ALL SELECT 'facts_only', count(*) FROM f ANTI JOIN b USING (doc_id) UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM b UNION SELECT * FROM f)
""",
    "companies_json": "SELECT code, name, industry FROM companies",
    "event_properties": "WITH e AS (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS events, count(k) AS with_k, sum(k)::BIGINT AS sum_k, max(k) AS max_k FROM e GROUP BY event_type",
}
