"""Problem 5: quantities recorded in different units, brought to the base unit of their quantity.

Pure SQL. A table of unit spellings is made by rule from spellings of scales and of bases (fixed
values below); the unit named in the `unit` field, in the label, or by the table block (its unit,
its caption, its headers) is extracted by pattern, folded, and looked up by joins with that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.tables import table

# Spellings of scales (folded: lower case, no accents), by factor prefix of the unit code.
SCALES = {
    "": [""],
    "NGHIN_": ["nghin", "ngan", "1.000", "1,000", "1000", "'000", "000", "thousand", "thousands", "k"],
    "TRIEU_": ["trieu", "tr", "tr.", "1.000.000", "1,000,000", "1000000", "mn", "million", "millions", "mio", "m"],
    "TY_": ["ty", "ti", "1.000.000.000", "1,000,000,000", "bn", "billion", "billions"],
}
# Spellings of bases (folded), by base of the unit code.
BASES = {
    "VND": ["dong", "vnd", "d", "dong viet nam", "vietnam dong", "vietnamese dong"],
    "USD": ["usd", "us$", "$", "u.s. dollars", "u.s. dollar", "us dollars", "us dollar", "dollars", "do la my", "do la"],
    "CP": ["cp", "co phan", "co phieu", "shares", "share"],
    "VND_CP": [a + sep + b for a in ("dong", "vnd", "d") for sep in ("/", " / ", " per ", " moi ") for b in ("cp", "co phan", "co phieu", "share")],
}
# Characters whose accent is dropped when a unit is compared.
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđðɖ"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyddd"
# Look-alike letters and signs that occur in labels, and the letter they stand for.
LOOKALIKE = "асеорхуіѕһвнмкт" + "αβεζηικμνορτυχ"
LOOKS_AS = "aceopxyishbhmkt" + "abezhikmnoptyx"
PLACEHOLDERS = ["", "-", "--", "n/a", "na", "none", "null", "?", "unknown", "khong ro"]


def folded(c: Column) -> Column:
    """Lower case, no accents, no invisible characters, single spaces, no full stop at the end."""
    c = F.translate(F.lower(c), ACCENTED + LOOKALIKE, PLAIN + LOOKS_AS)
    c = F.regexp_replace(c, "[\\u0300-\\u036f\\u200b-\\u200d\\u2060\\ufeff\\u00ad]", "")
    wide = "".join(chr(0xFF01 + k) for k in range(94))
    c = F.translate(c, wide, "".join(chr(0x21 + k) for k in range(94)))
    c = F.translate(c, "".join(chr(0x1D400 + k) for k in range(52)), "abcdefghijklmnopqrstuvwxyz" * 2)
    c = F.regexp_replace(F.lower(c), "[\\s\\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000]+", " ")
    return F.regexp_replace(F.trim(c), "(?<!tr)\\.+$", "")


def spellings(units: DataFrame) -> DataFrame:
    """(spelling, unit_code): the codes of `units` themselves, and each scale before or after each base."""
    rows = {}
    for prefix, scales in SCALES.items():
        for base, bases in BASES.items():
            for s in scales:
                for b in bases:
                    for text in {f"{s} {b}".strip(), f"{b} {s}".strip(), f"{s}{b}"} if s else {b}:
                        rows.setdefault(text, prefix + base)
    spark = units.sparkSession
    made = spark.createDataFrame(sorted(rows.items()), "spelling string, unit_code string")
    own = units.select(F.lower("unit_code").alias("spelling"), "unit_code")
    return made.join(units.select("unit_code"), "unit_code", "left_semi").unionByName(own).groupBy("spelling").agg(F.min("unit_code").alias("unit_code"))


#: Rows of a unit table that are broadcast, at most.
BROADCAST_UNITS = 10_000


def label_candidates(label: Column) -> Column:
    """Texts of a label in the places where a unit is named: after a unit word, in the last bracket, after the last comma."""
    f = folded(label)
    return F.array(
        F.regexp_extract(f, ".*(?:^|[^a-z])(?:dvt|don vi tinh|don vi|tinh bang|unit)\\s*[:\\s]\\s*([^()\\[\\]]+?)\\s*[)\\]]?$", 1),
        F.regexp_extract(f, "[\\[(]\\s*([^()\\[\\]]+?)\\s*[\\])]$", 1),
        F.regexp_extract(f, ",\\s*([^,]+?)$", 1),
        F.regexp_extract(f, ",\\s*([^,]+,[^,]+?)$", 1),
    )


def caption_unit(content: Column) -> Column:
    """The unit named in the caption line of a Markdown table (its first line when that is no table row), folded."""
    first = folded(F.regexp_extract(content, "^\\s*([^\\n|][^\\n]*)", 1))
    return F.regexp_extract(first, "(?:dvt|don vi tinh|don vi|unit|trinh bay theo|tinh bang)\\s*:?\\s*([^()]+?)\\s*\\)?$", 1)


def header_unit(headers: Column) -> Column:
    """The unit in brackets in the first header that has one, folded."""
    found = F.filter(F.transform(headers, lambda h: F.regexp_extract(folded(h), "\\(\\s*([^()]+?)\\s*\\)$", 1)), lambda x: x != "")
    return F.get(found, F.lit(0))


def block_units(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, table_id, block_unit): one row per table block that names a unit. Repeated rows count once."""
    b = (
        blocks.where("block_type = 'table'")
        .select(
            "doc_id", F.col("block_id").alias("table_id"),
            F.explode(F.array(*[
                F.struct(F.lit(rank).alias("rank"), x.alias("spelling"))
                for rank, x in enumerate([folded(F.col("unit")), caption_unit(F.col("content")), header_unit(F.col("headers"))])
            ])).alias("c"),
        )
        .where("c.spelling is not null and c.spelling <> ''")
        .select("doc_id", "table_id", "c.rank", "c.spelling")
        .join(names, "spelling")
    )
    return b.groupBy("doc_id", "table_id").agg(F.min(F.struct("rank", "unit_code")).alias("m")).select("doc_id", "table_id", F.col("m.unit_code").alias("block_unit"))


def converted(facts: DataFrame, blocks: DataFrame, units: DataFrame, default: str = "VND") -> DataFrame:
    """Facts with unit_code, quantity, base_unit and base_value.

    The unit of the row is that of `unit`, else that of `raw_label`, else that of the table block,
    else `default`. A null value gives a null base_value; a unit field that no spelling matches
    counts as naming none; a fact without table_id has no block. Other columns are kept, but for
    clashing names, which are replaced. The base value is value x factor + offset; a unit table without
    offsets has none. A unit table of up to BROADCAST_UNITS rows, counted first, is broadcast with its spellings; a
    longer one is joined as Catalyst sees fit.
    """
    hint = F.broadcast if units.count() <= BROADCAST_UNITS else lambda df: df
    names = hint(spellings(units)).select(F.col("spelling").alias("_spelling"), F.col("unit_code").alias("_code"))
    facts = facts.drop("unit_code", "quantity", "base_unit", "factor", "base_value")
    own = facts.withColumn("_field", folded(F.col("unit")))
    own = own.join(names.select(F.col("_spelling").alias("_field"), F.col("_code").alias("_of_field")), "_field", "left")
    own = own.withColumn("_c", F.when(F.col("_of_field").isNull(), label_candidates(F.col("raw_label"))))
    for k in range(4):
        own = own.join(names.select(F.col("_spelling").alias(f"_s{k}"), F.col("_code").alias(f"_l{k}")), F.get(F.col("_c"), F.lit(k)) == F.col(f"_s{k}"), "left")
    own = own.withColumn("_of_row", F.coalesce("_of_field", "_l0", "_l1", "_l2", "_l3")).drop("_field", "_of_field", "_c", *[f"_{x}{k}" for x in "sl" for k in range(4)])
    of_block = block_units(blocks, names.select(F.col("_spelling").alias("spelling"), F.col("_code").alias("unit_code")))
    joined = own.join(of_block, ["doc_id", "table_id"], "left").withColumn("unit_code", F.coalesce("_of_row", "block_unit", F.lit(default))).drop("_of_row", "block_unit")
    offset = F.coalesce("offset", F.lit(0.0)) if "offset" in units.columns else F.lit(0.0)
    known = hint(units.select("unit_code", "quantity", "base_unit", "factor", offset.alias("_offset")))
    return joined.join(known, "unit_code", "left").withColumn("base_value", F.col("value") * F.col("factor") + F.col("_offset")).drop("factor", "_offset")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "financial_facts").select("seq", "doc_id", "table_id", "raw_label", "unit", "value")
    out = converted(facts, table(spark, d, "blocks"), table(spark, d, "unit_definitions"))
    return out.where("unit_code <> base_unit").select("seq", "unit_code")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Facts and their total in the base unit, by quantity, concept statement and unit recorded."""
    facts = table(spark, d, "financial_facts").select("seq", "doc_id", "table_id", "raw_label", "unit", "value")
    out = converted(facts, table(spark, d, "blocks"), table(spark, d, "unit_definitions"))
    return out.groupBy("unit_code", "base_unit").agg(F.count("*").alias("facts"), F.count("base_value").alias("with_value"), F.round(F.max(F.abs("base_value")), 2).alias("largest"))


QUERIES = {"p5_found": p5_found, "p5_values": p5_values}


def _oracle() -> str:
    """The same rules as DuckDB SQL."""
    made: dict[str, str] = {}
    for prefix, scales in SCALES.items():
        for base, bases in BASES.items():
            for sc in scales:
                for b in bases:
                    for text in (f"{sc} {b}".strip(), f"{b} {sc}".strip(), f"{sc}{b}"):
                        made.setdefault(text if sc else b, prefix + base)
    values = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in sorted(made.items()))
    wide, narrow = "".join(chr(0xFF01 + k) for k in range(94)), "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")
    bold = "".join(chr(0x1D400 + k) for k in range(52))

    def fold(c: str) -> str:
        c = f"translate(lower({c}), '{ACCENTED + LOOKALIKE}', '{PLAIN + LOOKS_AS}')"
        c = f"regexp_replace({c}, '[\\x{{0300}}-\\x{{036f}}\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}\\x{{00ad}}]', '', 'g')"
        c = f"translate(translate({c}, '{wide}', '{narrow}'), '{bold}', '{'abcdefghijklmnopqrstuvwxyz' * 2}')"
        c = f"trim(regexp_replace(lower({c}), '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
        return f"list_transform([{c}], lambda z: CASE WHEN regexp_matches(z, '(^|[^.])tr\\.$') THEN z ELSE regexp_replace(z, '\\.+$', '') END)[1]"

    return f"""
WITH made(spelling, code) AS (VALUES {values}),
names AS (SELECT spelling, min(code) AS code FROM (SELECT * FROM made WHERE code IN (SELECT unit_code FROM unit_definitions) UNION ALL SELECT lower(unit_code), unit_code FROM unit_definitions) GROUP BY 1),
b AS (SELECT doc_id, block_id, {fold("unit")} AS s0,
  regexp_extract({fold("regexp_extract(content, '^\\s*([^\\n|][^\\n]*)', 1)")}, '(?:dvt|don vi tinh|don vi|unit|trinh bay theo|tinh bang)\\s*:?\\s*([^()]+?)\\s*\\)?$', 1) AS s1,
  list_filter(list_transform(headers, lambda h: regexp_extract({fold("h")}, '\\(\\s*([^()]+?)\\s*\\)$', 1)), lambda x: x <> '')[1] AS s2 FROM blocks WHERE block_type = 'table'),
c AS (SELECT doc_id, block_id, 0 AS k, s0 AS s FROM b UNION ALL SELECT doc_id, block_id, 1, s1 FROM b UNION ALL SELECT doc_id, block_id, 2, s2 FROM b),
bu AS (SELECT doc_id, block_id, arg_min(code, k) AS code FROM c JOIN names ON s = spelling GROUP BY ALL),
f AS (SELECT seq, doc_id, table_id, {fold("unit")} AS u, {fold("raw_label")} AS l FROM financial_facts),
x AS (SELECT *, regexp_extract(l, '.*(?:^|[^a-z])(?:dvt|don vi tinh|don vi|tinh bang|unit)\\s*[:\\s]\\s*([^()\\[\\]]+?)\\s*[)\\]]?$', 1) AS a0, regexp_extract(l, '[\\[(]\\s*([^()\\[\\]]+?)\\s*[\\])]$', 1) AS a1,
  regexp_extract(l, ',\\s*([^,]+?)$', 1) AS a2, regexp_extract(l, ',\\s*([^,]+,[^,]+?)$', 1) AS a3 FROM f),
r AS (SELECT seq, coalesce(n.code, n0.code, n1.code, n2.code, n3.code, bu.code, 'VND') AS unit_code FROM x LEFT JOIN names n ON u = n.spelling LEFT JOIN names n0 ON a0 = n0.spelling LEFT JOIN names n1 ON a1 = n1.spelling
  LEFT JOIN names n2 ON a2 = n2.spelling LEFT JOIN names n3 ON a3 = n3.spelling LEFT JOIN bu ON x.doc_id = bu.doc_id AND x.table_id = bu.block_id)
"""


_UNITS = _oracle()
ORACLES: dict[str, str] = {
    "p5_found": f"{_UNITS} SELECT seq, unit_code FROM r JOIN unit_definitions USING (unit_code) WHERE unit_code <> base_unit",
    "p5_values": f"{_UNITS} SELECT unit_code, base_unit, count(*) AS facts, count(value) AS with_value, round(max(abs(value * factor)), 2) AS largest FROM r JOIN financial_facts USING (seq) JOIN unit_definitions USING (unit_code) GROUP BY ALL",
}
