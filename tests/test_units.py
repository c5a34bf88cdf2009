"""Conversion of quantities: where the unit is named, spellings, and awkward rows."""

from pyspark.sql import functions as F

from ledgerloom.operators import units
from ledgerloom.plans import statements

FACTS = "seq bigint, doc_id string, table_id string, raw_label string, unit string, value double, factor string"
BLOCKS = "doc_id string, block_id string, block_type string, content string, headers array<string>, unit string"
UNITS = "unit_code string, quantity string, base_unit string, factor double"
DEFINED = [("VND", "money", "VND", 1.0), ("NGHIN_VND", "money", "VND", 1e3), ("TRIEU_VND", "money", "VND", 1e6), ("TY_VND", "money", "VND", 1e9), ("USD", "money", "VND", 25e3), ("NGHIN_USD", "money", "VND", 25e6), ("CP", "shares", "CP", 1.0), ("NGHIN_VND_CP", "per_share", "VND_CP", 1e3), ("VND_CP", "per_share", "VND_CP", 1.0)]


def run(spark, facts, blocks=()):
    out = units.converted(
        spark.createDataFrame([(*f, "clash") for f in facts], FACTS), spark.createDataFrame(list(blocks), BLOCKS), spark.createDataFrame(DEFINED, UNITS)
    )
    return {r.seq: r for r in out.collect()}


def test_field_label_and_block(spark):
    got = run(
        spark,
        [
            (1, "d", "t", "A", " Triệu  đồng. ", 2.0),
            (2, "d", "t", "Lãi gộp (ĐVT: nghìn USD)", "n/a", 3.0),
            (3, "d", "t", "Lãi gộp - đơn vị tỷ đồng", None, 1.0),
            (4, "d", "t", "Net change in transit - đơn vị '000 VND", "-", 1.0),
            (5, "d", "t", "Lãi gộp, nghìn đồng/cp", "", 1.0),
            (6, "d", "t", "Lãi gộp (thuyết minh 12)", "", 1.0),
            (7, "d", "u", "Lãi gộp", None, 1.0),
            (8, "d", "v", "Lãi gộp", None, None),
            (9, None, None, None, None, 5.0),
            (10, "d", "w", "CP bán hàng", None, 1.0),
            (11, "d", "t", "Lãi gộp (tính bằng VNƉ)", None, 1.0),
        ],
        [
            ("d", "t", "table", "Đơn vị tính: triệu đồng\n\n| a |", None, None),
            ("d", "t", "table", "Đơn vị tính: triệu đồng\n\n| a |", None, None),
            ("d", "u", "table", "| a |", ["Chỉ tiêu", "Cuối kỳ (nghìn đồng)"], None),
            ("d", "v", "table", "(Đơn vị: USD)\n| a |", ["x (đồng)"], "TY_VND"),
            ("d", "w", "text", "Đơn vị tính: USD", None, None),
            (None, None, None, None, None, None),
        ],
    )
    assert {k: r.unit_code for k, r in got.items()} == {1: "TRIEU_VND", 2: "NGHIN_USD", 3: "TY_VND", 4: "NGHIN_VND", 5: "NGHIN_VND_CP", 6: "TRIEU_VND", 7: "NGHIN_VND", 8: "TY_VND", 9: "VND", 10: "VND", 11: "VND"}
    assert got[1].base_value == 2e6 and got[2].base_value == 75e6 and got[8].base_value is None


def test_repeated_rows_and_empty_tables(spark):
    row = (1, "d", "t", "A", "USD", 1.0, "x")
    u = spark.createDataFrame(DEFINED, UNITS)
    none = spark.createDataFrame([], BLOCKS)
    assert units.converted(spark.createDataFrame([row, row], FACTS), none, u).count() == 2
    assert units.converted(spark.createDataFrame([], FACTS), none, u).count() == 0


def test_spellings_are_unambiguous(spark):
    s = units.spellings(spark.createDataFrame(DEFINED, UNITS))
    assert s.groupBy("spelling").count().where("count > 1").count() == 0
    assert s.where(F.col("spelling").isin(units.PLACEHOLDERS)).count() == 0


def test_unit_words_without_signs_in_the_label(spark):
    labels = ["Doanh thu tính bằng nghìn đồng", "Doanh thu TÍNH BẰNG triệu đồng", "Sales unit thousand dollars", "Lãi gộp tinh bang USD", "Doanh thu"]
    rows = [(k, "d", None, x, None, 1.0, "x") for k, x in enumerate(labels)]
    got = units.converted(spark.createDataFrame(rows, FACTS), spark.createDataFrame([], BLOCKS), spark.createDataFrame(DEFINED, UNITS)).collect()
    assert {r.seq: r.unit_code for r in got} == {0: "NGHIN_VND", 1: "TRIEU_VND", 2: "NGHIN_USD", 3: "USD", 4: "VND"}


def test_plans_convert_every_fact(spark, tmp_path):
    facts = [(1, "d", None, "A", "USD", 2.0, "ASSETS_TOTAL", "current"), (2, "d", None, "A", "VND", 3.0, "ASSETS_TOTAL", "previous"), (3, "d", None, "B", "nghìn đồng", 4.0, "CASH", "current"), (4, "e", None, "C", None, None, None, None)]
    for name, rows, kind in (("financial_facts", facts, FACTS.replace("factor string", "concept string, period_type string")), ("blocks", [], BLOCKS), ("unit_definitions", DEFINED, UNITS)):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.seq: r.base_value for r in statements.values_in_base_units(spark, str(tmp_path)).collect()} == {1: 50e3, 2: 3.0, 3: 4e3, 4: None}
    assert {r.doc_id: (r.facts, round(r.in_base_units, 3)) for r in statements.base_unit_shares(spark, str(tmp_path)).collect()} == {"d": (3, 0.333), "e": (1, 1.0)}
