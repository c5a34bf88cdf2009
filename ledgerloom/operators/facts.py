"""Facts from statement tables, and the choice among facts: extraction by column roles, mapping by code and name, ordinals, priorities, winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.markdown import column_roles, grid
from ledgerloom.functions.numbers import ocr_number
from ledgerloom.functions.text import code_in_label, code_key, plain_label
from ledgerloom.operators.blocks import once
from ledgerloom.tables import table

KEY = ["doc_id", "period_type", "concept"]


def table_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, row, label, code, current, previous): data rows of statement tables, by the roles of their columns; rows without label or with too few cells are left out."""
    b = blocks.where("block_type = 'table' and content is not null").withColumn("_g", grid(F.col("content"))).where(F.size("_g") >= 2)
    b = b.withColumn("_r", column_roles(F.element_at("_g", 1))).select("doc_id", "block_id", "page", "_r", F.posexplode(F.slice("_g", 2, F.size("_g"))).alias("row", "_c"))
    needed = F.greatest(F.col("_r.label"), F.coalesce("_r.code", F.lit(0)), F.coalesce("_r.current", F.lit(0)), F.coalesce("_r.previous", F.lit(0)))
    cell = lambda name: F.get(F.col("_c"), F.col(f"_r.{name}"))
    out = b.where(F.size("_c") > needed).select(
        "doc_id", "block_id", "page", "row", plain_label(cell("label")).alias("label"), F.coalesce(F.nullif(cell("code"), F.lit("")), code_in_label(cell("label"))).alias("code"),
        ocr_number(cell("current")).alias("current"), ocr_number(cell("previous")).alias("previous"),
    )
    return out.where("label <> ''")


def mapped(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rows with `concept`, by code (leading zeros of short codes do not count) where the code is one concept's alone or the name agrees, else by name.

    concepts: concept, code, aliases. A row that neither maps has a null concept. The code and name
    lists are joined on equality; the name list decides among concepts that share a code.
    """
    names = concepts.select("concept", F.explode("aliases").alias("_n")).select(F.lower(F.trim("_n")).alias("_name"), "concept")
    by_name = names.groupBy("_name").agg(F.min("concept").alias("_by_name"))
    keys = concepts.select("concept", F.explode(F.array_distinct(F.array(code_key(F.col("code")), F.regexp_replace(code_key(F.col("code")), "^0(?=.$)", "")))).alias("_key"))
    by_code = keys.groupBy("_key").agg(F.collect_set("concept").alias("_by_code"))  # concepts of one code: a few
    r = rows.withColumn("_key", code_key(F.col("code"))).withColumn("_name", F.lower(F.trim(F.regexp_replace("label", "^(?:[IVX]+\\.|[0-9]+\\.|[A-Z]\\.|-|\\*|a\\)|[A-Z] -)\\s+", ""))))
    r = r.join(by_name, "_name", "left").join(by_code, "_key", "left")
    alone = F.when(F.size("_by_code") == 1, F.get("_by_code", F.lit(0)))
    agrees = F.when(F.array_contains("_by_code", F.col("_by_name")), F.col("_by_name"))
    return r.withColumn("concept", F.coalesce(agrees, F.col("_by_name"), alone)).drop("_key", "_name", "_by_name", "_by_code")


def unpivoted(rows: DataFrame) -> DataFrame:
    """Rows with two values as facts of the current and the previous period; null values give none."""
    values = F.array(F.struct(F.lit("current").alias("period_type"), F.col("current").alias("value")), F.struct(F.lit("previous").alias("period_type"), F.col("previous").alias("value")))
    return rows.withColumn("_v", F.explode(values)).select(*[c for c in rows.columns if c not in ("current", "previous")], "_v.period_type", "_v.value").where("value is not null")


def with_ordinal(facts: DataFrame) -> DataFrame:
    """Facts with their ordinal among those of one document, period and concept, and a name that later ones get a number in."""
    w = W.partitionBy(*KEY).orderBy("seq")
    return facts.withColumn("ordinal", F.row_number().over(w)).withColumn("name", F.concat_ws("_", "doc_id", "period_type", "concept", F.when(F.col("ordinal") > 1, F.col("ordinal").cast("string"))))


# Words that speak against a concept of the income statement, those of sub-items, and those that speak for flows of capital.
FLOW_WORDS = "|".join(["lưu chuyển", "tiền thuần", "biến động", "thanh lý", "cổ tức", "tiền chi", "tiền thu"])
PART_WORDS = "|".join(["khác", "dự phòng", "nguyên giá", "hao mòn"])
CAPITAL_WORDS = "|".join(["cổ phiếu", "vốn góp", "nợ thuê", "thuê tài chính"])
CAPITAL = ["FLOW_EQUITY_IN", "FLOW_CAPITAL_BACK", "FLOW_LEASE_OUT"]
OTHERS = ["INCOME_OTHER", "COST_OTHER"]
INCOME = ["REVENUE_NET", "COST_SALES", "PROFIT_GROSS", "PROFIT_OPERATING", "PROFIT_PRETAX", "PROFIT_NET"]
TOTALS = ["RECV_CUSTOMER_SHORT", "STOCK_NET", "RECV_CUSTOMER_LONG"]


def priority(expected: Column) -> Column:
    """How well a fact fits its concept: its code against the expected one, words of its label for and against."""
    low, code = F.lower(F.coalesce("raw_label", F.lit(""))), F.regexp_replace(F.coalesce("standard_code", F.lit("")), "[^0-9]", "")
    income = F.col("concept").isin(INCOME)
    return (
        F.lit(10)
        + F.when(expected.isNotNull() & (code == expected), 50).when(expected.isNotNull() & (code != "") & (code != expected), -30).otherwise(0)
        + F.when(income & low.rlike(FLOW_WORDS), -100).otherwise(0)
        + F.when((F.col("concept") == "REVENUE_NET") & low.contains("doanh thu"), 20).when((F.col("concept") == "COST_SALES") & low.contains("giá vốn"), 20).when((F.col("concept") == "PROFIT_GROSS") & low.contains("lợi nhuận gộp"), 20).otherwise(0)
        + F.when(F.col("concept").isin(TOTALS) & low.rlike(PART_WORDS), -40).otherwise(0)
        + F.when((F.col("concept").isin(CAPITAL) & low.rlike(CAPITAL_WORDS)) | (F.col("concept").isin(OTHERS) & low.contains("khác")), 20).otherwise(0)
    )


def winners(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """One fact per document, period and concept: the greatest priority, of equal ones the first. One map-side combined aggregate."""
    codes = concepts.select("concept", F.col("code").alias("_expected"))
    f = facts.where("concept is not null and value is not null").join(codes, "concept").withColumn("priority", priority(F.col("_expected")))
    best = F.max_by(F.struct("seq", "value", "standard_code", "raw_label", "priority"), F.struct(F.col("priority"), -F.col("seq")))
    return f.groupBy(*KEY).agg(best.alias("_b")).select(*KEY, "_b.*")


# ---- Queries ----------------------------------------------------------------------------------------


def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts read from statement tables, with their concept where code or name tells it."""
    rows = mapped(table_rows(once(table(spark, d, "blocks"))), table(spark, d, "concept_definitions"))
    return unpivoted(rows).groupBy("doc_id", "block_id", "period_type").agg(F.count("*").alias("facts"), F.count("concept").alias("known"), F.countDistinct("concept").alias("concepts"), F.sum(F.col("value").cast("decimal(38,4)")).cast("double").alias("total"))


def fact_ordinals(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "financial_facts").where("concept is not null").select("seq", *KEY)
    return with_ordinal(f).select("seq", "ordinal", "name")


def fact_winners(spark: SparkSession, d: str) -> DataFrame:
    return winners(table(spark, d, "financial_facts"), table(spark, d, "concept_definitions")).select(*KEY, "seq", "value", "priority")


def unknown_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labels of table rows that map to no concept, and how often; none is dropped silently."""
    rows = mapped(table_rows(once(table(spark, d, "blocks"))), table(spark, d, "concept_definitions"))
    return rows.where("concept is null").groupBy("label").agg(F.count("*").alias("rows"))


QUERIES = {f.__name__: f for f in (extracted_facts, fact_ordinals, fact_winners, unknown_rows)}
PRIORITY = f"""10 + CASE WHEN regexp_replace(coalesce(standard_code, ''), '[^0-9]', '', 'g') = code THEN 50 WHEN regexp_replace(coalesce(standard_code, ''), '[^0-9]', '', 'g') <> '' THEN -30 ELSE 0 END
 + CASE WHEN concept IN ({", ".join(repr(x) for x in INCOME)}) AND regexp_matches(lower(coalesce(raw_label, '')), '{FLOW_WORDS}') THEN -100 ELSE 0 END
 + CASE WHEN concept = 'REVENUE_NET' AND contains(lower(raw_label), 'doanh thu') THEN 20 WHEN concept = 'COST_SALES' AND contains(lower(raw_label), 'giá vốn') THEN 20 WHEN concept = 'PROFIT_GROSS' AND contains(lower(raw_label), 'lợi nhuận gộp') THEN 20 ELSE 0 END
 + CASE WHEN concept IN ({", ".join(repr(x) for x in TOTALS)}) AND regexp_matches(lower(coalesce(raw_label, '')), '{PART_WORDS}') THEN -40 ELSE 0 END
 + CASE WHEN concept IN ({", ".join(repr(x) for x in CAPITAL)}) AND regexp_matches(lower(coalesce(raw_label, '')), '{CAPITAL_WORDS}') THEN 20 WHEN concept IN ({", ".join(repr(x) for x in OTHERS)}) AND contains(lower(coalesce(raw_label, '')), 'khác') THEN 20 ELSE 0 END"""
WINNERS = f"""w AS (SELECT doc_id, period_type, concept, seq, value, priority FROM (
  SELECT f.*, {PRIORITY} AS priority FROM financial_facts f JOIN concept_definitions c USING (concept) WHERE value IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY doc_id, period_type, concept ORDER BY priority DESC, seq) = 1)"""
ORACLES = {
    "fact_ordinals": """
SELECT seq, ordinal, doc_id || '_' || period_type || '_' || concept || CASE WHEN ordinal > 1 THEN '_' || ordinal ELSE '' END AS name
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, period_type, concept ORDER BY seq) AS ordinal FROM financial_facts WHERE concept IS NOT NULL)
""",
    "fact_winners": f"WITH {WINNERS} SELECT * FROM w",
}
