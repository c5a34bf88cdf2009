"""Writes as pure functions of tables: upsert, insert or ignore, delete of a slice, and the sinks that store their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.tables import table


def upserted(old: DataFrame, new: DataFrame, key: str, update: list[str], order: str) -> DataFrame:
    """old with the rows of new: on a known key only the `update` columns are taken over, from the last row by `order`; the rest stays as first stored. Rows of a null key are kept as they are."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    keyed = both.where(F.col(key).isNotNull())
    rest = [c for c in old.columns if c not in (*update, key)]
    g = keyed.groupBy(key).agg(F.max_by(F.struct(*update), F.struct("_age", order)).alias("_u"), F.min_by(F.struct(*rest), F.struct("_age", order)).alias("_r"))
    out = g.select(key, *[F.col(f"_u.{c}").alias(c) for c in update], *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*old.columns)
    return out.unionByName(both.where(F.col(key).isNull()).drop("_age"))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer by key, the key in capitals without outer blanks: a non-null new field wins over the old one, empty texts count."""
    k = F.upper(F.trim(F.col(key)))
    o, n = old.withColumn(key, k).alias("o"), new.withColumn(key, k).alias("n")
    return o.join(n, key, "full_outer").select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns if c != key])


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new whose key it lacks; of several new ones any."""
    fresh = new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def without_slice(df: DataFrame, **equal) -> DataFrame:
    """df without the rows that equal all the given values; a null never equals."""
    hit = F.lit(True)
    for c, v in equal.items():
        hit = hit & (F.col(c) == v)
    return df.where(~F.coalesce(hit, F.lit(False)))


def store(df: DataFrame, path: str, by: list[str], format_: str = "parquet") -> None:
    """Written by partitions; only the partitions that df has are replaced, so storing a slice again changes nothing else."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(format_).save(path)


# ---- Queries ----------------------------------------------------------------------------------------


def redelivered_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts by id after every delivery is upserted in order of arrival: value, status, detail and confidence are the last, the rest the first."""
    f = table(spark, d, "financial_facts").select("id", "seq", "doc_id", "raw_label", "value", "verification_status", "verification_detail", "confidence")
    w = W.partitionBy("id").orderBy("seq")
    ranked = f.withColumn("_k", F.row_number().over(w))
    return upserted(ranked.where("_k = 1").drop("_k"), ranked.where("_k > 1").drop("_k"), "id", ["value", "verification_status", "verification_detail", "confidence"], "seq")


def companies_with_parents(spark: SparkSession, d: str) -> DataFrame:
    """Companies, with a bare row for each company of facts that is missing."""
    c = table(spark, d, "companies").select("code", "name", "industry")
    new = table(spark, d, "financial_facts").select(F.upper(F.trim("company")).alias("code")).where("code is not null").distinct().select("code", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("industry"))
    return inserted(c, new, "code")


def companies_merged(spark: SparkSession, d: str) -> DataFrame:
    """Companies updated from what documents say: the code in capitals, industry of the old row, a doc_type as its industry where there is none."""
    c = table(spark, d, "companies").select("code", "name", "industry")
    n = table(spark, d, "documents").where("company is not null").groupBy(F.upper(F.trim("company")).alias("code")).agg(F.lit(None).cast("string").alias("name"), F.max("doc_type").alias("industry"))
    return merged(c, n, "code")


def facts_without_year(spark: SparkSession, d: str) -> DataFrame:
    """Facts by year after the slice of the latest year and its first company is deleted."""
    f = table(spark, d, "financial_facts")
    top = f.agg(F.max("year").alias("y")).first()["y"]
    who = f.where(F.col("year") == top).agg(F.min("company").alias("c")).first()["c"]
    return without_slice(f, year=top, company=who).groupBy("year").agg(F.count("*").alias("facts"))


QUERIES = {f.__name__: f for f in (redelivered_facts, companies_with_parents, companies_merged, facts_without_year)}
ORACLES = {
    "redelivered_facts": """
SELECT id, first(seq ORDER BY seq) AS seq, first(doc_id ORDER BY seq) AS doc_id, first(raw_label ORDER BY seq) AS raw_label,
  (list(value ORDER BY seq DESC))[1] AS value, (list(verification_status ORDER BY seq DESC))[1] AS verification_status, (list(verification_detail ORDER BY seq DESC))[1] AS verification_detail, (list(confidence ORDER BY seq DESC))[1] AS confidence
FROM financial_facts WHERE id IS NOT NULL GROUP BY id
""",
    "companies_with_parents": "SELECT code, name, industry FROM companies UNION ALL SELECT DISTINCT upper(trim(company)), NULL, NULL FROM financial_facts WHERE company IS NOT NULL AND upper(trim(company)) NOT IN (SELECT code FROM companies)",
    "companies_merged": "WITH n AS (SELECT upper(trim(company)) AS code, max(doc_type) AS industry FROM documents WHERE company IS NOT NULL GROUP BY 1) SELECT coalesce(upper(trim(c.code)), n.code) AS code, c.name, coalesce(n.industry, c.industry) AS industry FROM companies c FULL JOIN n ON upper(trim(c.code)) = n.code",
    "facts_without_year": "WITH y AS (SELECT max(year) AS y FROM financial_facts), w AS (SELECT min(company) AS c FROM financial_facts, y WHERE year = y.y) SELECT year, count(*) AS facts FROM financial_facts, y, w WHERE NOT coalesce(year = y.y AND company = w.c, false) GROUP BY year",
}
