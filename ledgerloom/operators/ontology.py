"""Two-tier mapping of statement rows to a chart of accounts: by code within a statement, then by name patterns on the residue; guards speak against a match.

The chart is a table, not code: concept, code, statement_type, ord, patterns (regular expressions over
lower-case labels), guards (words that exclude). It is broadcast when its size is within `broadcast`
rows; a larger chart joins codes by shuffle, and names in blocks of that many rows.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.functions.text import code_key
from ledgerloom.tables import table

#: Rows of a chart that are broadcast at once.
BROADCAST = 10_000
# Words that tell the statement of a row, the first statement that has one counts.
STATEMENT_OF_LABEL = [
    ("BALANCE_SHEET", "tài sản|nguồn vốn|nợ phải trả|phải thu|hàng tồn kho|vốn chủ|assets|liabilit|equity|receivable|inventor"),
    ("CASH_FLOW", "lưu chuyển|dòng tiền|tiền chi|tiền thu|tiền trả|tiền nhận|cash flow|paid in cash|proceeds"),
    ("INCOME_STATEMENT", "doanh thu|chi phí|lợi nhuận|giá vốn|lãi|thu nhập|revenue|sales|cost|profit|income|margin"),
]


def statement_of(label: Column) -> Column:
    """The statement a label tells, or null."""
    low = F.lower(label)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(s)) for s, p in STATEMENT_OF_LABEL])


def chart(concepts: DataFrame) -> DataFrame:
    """A chart from a concept list: names are matched as they stand anywhere in a label; order is that of the keys."""
    quoted = F.transform("aliases", lambda a: F.concat(F.lit("(^|[^\\p{L}])"), F.regexp_replace(F.lower(a), "([\\\\.^$|()\\[\\]{}*+?-])", "\\\\$1"), F.lit("($|[^\\p{L}])")))
    return concepts.select("concept", "code", "statement_type", F.col("concept").alias("ord"), quoted.alias("patterns"), F.array().cast("array<string>").alias("guards"))


def _guarded(label: Column, guards: Column) -> Column:
    return F.exists(guards, lambda g: label.contains(g))


def _by_patterns(part: DataFrame):
    """A function of a label and its statement: the first concept by the chart's own order, its statement's before others, one of whose patterns is in the label. Patterns are compiled once a worker."""
    rows = [(r["ord"], r["concept"], r["statement_type"], r["patterns"] or [], r["guards"] or []) for r in part.collect()]  # of a size the caller has checked
    order = part.schema["ord"].dataType
    kind = pa.struct([("o", pa.bool_()), ("ord", to_arrow_type(order)), ("concept", pa.string())])
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    made: dict = {}

    @F.arrow_udf(f"struct<o:boolean,ord:{order.simpleString()},concept:string>")
    def best(labels: pa.Array, statements: pa.Array) -> pa.Array:
        if "p" not in made:
            made["p"] = [(k, c, s, regex.compile("|".join(f"(?:{p})" for p in ps)), g) for k, (_, c, s, ps, g) in enumerate(rows) if ps]
        out = []
        for low, told in zip(labels.to_pylist(), statements.to_pylist(), strict=True):
            found = [(bool(told) and s != told, k) for k, c, s, p, g in made["p"] if p.search(low) and not any(w in low for w in g)]
            out.append({"o": min(found)[0], "ord": rows[min(found)[1]][0], "concept": rows[min(found)[1]][1]} if found else None)
        return pa.array(out, type=kind)

    return best


def matched(rows: DataFrame, of: DataFrame, key: list[str], broadcast: int = BROADCAST) -> DataFrame:
    """rows (key, label, code, and statement if known) with `concept` and `tier` (code, name, or null).

    Codes of one or two digits match with and without a leading zero. Of a code's concepts those of the
    row's statement count if there are any; then the lowest ord. A concept whose guard the label holds
    is out. Rows without a match by code are matched by patterns, whatever their code. The result does not
    depend on `broadcast`.
    """
    n = of.count()
    small = (lambda x: F.broadcast(x)) if n <= broadcast else (lambda x: x)
    r = rows.withColumn("_low", F.lower(F.coalesce("label", F.lit("")))).withColumn("_key", code_key(F.coalesce("code", F.lit("")))).withColumn("_s", F.coalesce("statement", statement_of(F.col("label"))))
    keys = of.select("concept", "statement_type", "ord", "guards", F.explode(F.array_distinct(F.array(code_key(F.col("code")), F.regexp_replace(code_key(F.col("code")), "^0(?=[0-9]$)", "")))).alias("_key"))
    c = r.where("_key <> ''").join(small(keys), "_key").where(~_guarded(F.col("_low"), F.col("guards")))
    by_code = c.groupBy(*key).agg(F.min_by("concept", F.struct(F.coalesce(F.col("statement_type") != F.col("_s"), F.lit(False)), "ord")).alias("_by_code"))
    first = r.join(by_code, key, "left")
    residue = first.where("_by_code is null and _low <> ''").select(*key, "_low", "_s").distinct()
    blocks = max(1, -(-n // broadcast))
    hits = None
    for k in range(blocks):  # one pass for charts of up to `broadcast` rows
        part = of if blocks == 1 else of.where(F.pmod(F.xxhash64("concept"), F.lit(blocks)) == k)
        h = residue.withColumn("b", _by_patterns(part)("_low", "_s")).where("b is not null").select(*key, "b")
        hits = h if hits is None else hits.unionByName(h)
    by_name = hits.groupBy(*key).agg(F.min("b").alias("_b")).select(*key, F.col("_b.concept").alias("_by_name"))
    out = first.join(by_name, key, "left").withColumn("concept", F.coalesce("_by_code", "_by_name"))
    return out.withColumn("tier", F.when(F.col("_by_code").isNotNull(), "code").when(F.col("_by_name").isNotNull(), "name")).drop("_low", "_key", "_s", "_by_code", "_by_name")


def chart_matches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labels of facts matched by name alone, with how often they occur."""
    f = table(spark, d, "financial_facts").where("raw_label is not null").groupBy(F.col("raw_label").alias("label")).agg(F.count("*").alias("facts"))
    rows = f.select("label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("statement"), "facts")
    return matched(rows, chart(table(spark, d, "concept_definitions")), ["label"]).select("label", "concept", "facts")


def chart_code_matches(spark: SparkSession, d: str) -> DataFrame:
    """Facts by how code and name map them, and whether that is their concept."""
    f = table(spark, d, "financial_facts").groupBy(F.col("raw_label").alias("label"), F.col("standard_code").alias("code"), F.col("concept").alias("given")).agg(F.count("*").alias("facts"))
    rows = f.select(F.coalesce("label", F.lit("")).alias("label"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("given", F.lit("")).alias("given"), F.lit(None).cast("string").alias("statement"), "facts")
    m = matched(rows, chart(table(spark, d, "concept_definitions")), ["label", "code", "given"])
    return m.groupBy("tier", (F.col("concept") == F.col("given")).alias("same")).agg(F.sum("facts").alias("facts"))


QUERIES = {"chart_matches": chart_matches, "chart_code_matches": chart_code_matches}
_S = " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{s}'" for s, p in STATEMENT_OF_LABEL)
ORACLES = {
    "chart_matches": f"""
WITH f AS (SELECT raw_label AS label, lower(raw_label) AS low, count(*) AS facts FROM financial_facts WHERE raw_label IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, CASE {_S} END AS s FROM f),
p AS (SELECT concept, statement_type, a, ' ' || regexp_replace(a, '[^\\pL]+', ' ', 'g') || ' ' AS w FROM (SELECT concept, statement_type, lower(unnest(aliases)) AS a FROM concept_definitions)),
n AS (SELECT *, ' ' || regexp_replace(low, '[^\\pL]+', ' ', 'g') || ' ' AS w FROM s),
h AS (SELECT label, concept, row_number() OVER (PARTITION BY label ORDER BY coalesce(statement_type <> s, false), concept) AS k FROM n JOIN p ON contains(low, a) AND contains(n.w, p.w))
SELECT f.label, h.concept, facts FROM f LEFT JOIN h ON f.label = h.label AND h.k = 1
""",
}
