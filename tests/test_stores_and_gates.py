import regex
from pyspark.sql import functions as F

from ledgerloom.functions import markdown as m
from ledgerloom.functions import text as t
from ledgerloom.operators import blocks, stores


def one(spark, value, *columns, schema="s string"):
    return tuple(spark.createDataFrame([value if isinstance(value, tuple) else (value,)], schema).select(*columns).first())


def test_tables_are_created_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS made LOCATION '{tmp_path}/made'")
    try:
        assert stores.create(spark, "made") == list(stores.TABLES) == stores.create(spark, "made")
        assert {r.tableName for r in spark.sql("SHOW TABLES IN made").where("not isTemporary").collect()} == set(stores.TABLES)
        assert "year" in spark.table("made.financial_facts").columns
    finally:
        spark.sql("DROP DATABASE made CASCADE")


def test_ids_ratios_and_reports(spark):
    c = [F.lit(x) for x in ("AA", 2020, 3, "p3_b1", 7, "current")]
    assert one(spark, "x", *stores.fact_ids(*c)) == ("AA_2020_p3_p3_b1_r7", "AA_2020_p3_p3_b1_r7_c")
    rows = spark.createDataFrame([("i2", "b", "z", "[1"), ("i1", "a", "z", '["1","2"]'), ("i3", "c", "y", None)], "id string, ratio_name string, ratio_category string, input_prov_ids string")
    assert [(r.id, r.inputs) for r in stores.stored_ratios(rows).collect()] == [("i3", []), ("i1", ["1", "2"]), ("i2", [])]
    reports = "id string, company string, year int, period string, source_file string, is_balanced boolean, total_checks int, passed_checks string, failed_checks string, at int"
    old = spark.createDataFrame([("A_2020_X", "A", 2020, "p", "first", False, 3, "[]", "[1]", 1)], reports)
    new = spark.createDataFrame([("A_2020_X", "A", 2020, "q", "second", True, 4, "[1]", "[]", 2), ("B_2020_X", "B", 2020, "q", "b", True, 1, "[]", "[]", 2)], reports)
    got = {r.id: (r.source_file, r.period, r.is_balanced, r.total_checks) for r in stores.reports_upserted(old, new, "at").collect()}
    assert got == {"A_2020_X": ("first", "p", True, 4), "B_2020_X": ("b", "q", True, 1)}
    assert stores.default_store(["/no/such", "/tmp"]) == "/tmp" and stores.default_store([]) is None


def test_gate(spark):
    kinds = spark.createDataFrame([("a", "X", 0.9, "sql"), ("b", "Y", 0.6, "sql"), ("c", "Z", None, "sql")], "id string, label string, confidence double, target string")
    got = {r.id: (r.method, r.reasoning) for r in blocks.gated(kinds, 0.75).collect()}
    assert got["a"] == ("rule", "rules are sure enough") and got["b"] == ("rule", "rules are unsure (0.60), no further classifier given") and got["c"][0] == "rule"
    asked = blocks.gated(kinds, 0.75, lambda df: df.withColumn("label", F.lit("HOOK")))
    assert {r.id: (r.label, r.method) for r in asked.collect()} == {"a": ("X", "rule"), "b": ("HOOK", "hook"), "c": ("HOOK", "hook")}


def test_validation_and_pages(spark):
    schema = "doc_id string, block_id string, block_type string, content string, page int, seq int"
    b = spark.createDataFrame([("d", "1", "table", "| Chỉ tiêu | x |\n|---|---|\n| Tổng cộng tài sản | (5) |\n| Khác | 7 |", 1, 1), ("d", "2", "table", "| a | b |\n|---|---|\n| x | 99 |", 2, 2), ("d", "3", "table", None, 3, 3), ("d", "4", "text", "x", 4, 4)], schema)
    totals = spark.createDataFrame([("d", "2", 100.0), ("d", "1", 0.0)], "doc_id string, block_id string, expected double")
    assert {r.block_id: (r.numbers, r.total, r.negative_rows, r.is_valid) for r in blocks.validated_tables(b, totals).collect()} == {"1": (2, 2.0, 1, False), "2": (1, 99.0, 0, True)}
    assert not {r.block_id: r.is_valid for r in blocks.validated_tables(b, totals.withColumn("expected", F.lit(200.0))).collect()}["2"]
    ids = lambda df: sorted(r.block_id for r in df.collect())
    assert ids(blocks.pages_in(b, [2, 99])) == ["2"] and ids(blocks.page_range(b, -3, 2)) == ["1", "2"] and ids(blocks.page_range(b, 9, 8)) == []
    assert [len(ids(blocks.first_notes(b, k, ["doc_id"], ["page"]))) for k in (-1, 0, 2)] == [4, 0, 2]
    assert sorted(r.origin for r in blocks.united(b.limit(1), b.drop("seq").limit(2)).collect()) == ["ocr", "ocr", "text"]


def test_corrections_follow_the_list_in_order(spark):
    for s in ("thong tu s0 5, ketoan", "Von chu so hua ((x))", "Vốn VON, hoan nhap Stra BUONG", "đối von, tại vốnx", "trich quy thuoc 1 huyết minh"):
        want = s
        for pattern, to in t.FIXES + t.TRADE_FIXES:
            want = regex.sub(pattern, to, want, flags=regex.I)
        assert one(spark, s, t.corrected(F.col("s"))) == (want,)
    lines = ["Mẫu B 09 – DN", "7", "**Thuyết minh báo cáo tài chính (tiếp theo)**", "Công ty Cổ phần Gỗ Đá trang đầu", "tiền tiền tiền tiền tiền", "nội dung", "123456789"]
    assert one(spark, "\n".join(lines), t.without_boilerplate(F.col("s"), t.REPORT_LINES + [t.company_line("Công ty Cổ phần Gỗ Đá")])) == ("nội dung",)
    assert one(spark, "12 . 000 và 12 000 đồng", t.recognised(F.col("s"))) == ("12.000 và 12.000 đồng",)
    assert one(spark, "Chữ  Ký_Số – Đầu!", t.ascii_slug(F.col("s"))) == ("chu_ky_so_dau",)
    assert one(spark, "Bản SAO lậu", t.marked(F.col("s"), ["sao"]), t.marked(F.col("s"), ["x"]), t.marked(F.col("s"), [])) == (True, False, False)


def test_heads_and_formats(spark):
    two = "| Khoản mục | Số cuối năm | | Số đầu năm |\n| | Giá gốc | Khấu hao | Giá gốc |\n|---|---|---|---|\n| a | 1 | 2 | 3 |"
    assert one(spark, two, m.stitched_header(F.col("s")))[0].split("\n")[0] == "| Khoản mục | Số cuối năm - Giá gốc | Số cuối năm - Khấu hao | Số đầu năm - Giá gốc |"
    for same in ("| a | 31/12 |\n| b | c |\n| d | 5 |", "| a | b |\n|---|---|\n| c | 1 |", "| a |\n| b |"):
        assert one(spark, same, m.stitched_header(F.col("s"))) == (same,)
    heads = {("Khoản", "Cột 1", "VND"): ["Khoản", "31/12/2020 VND", "1/1/2020 VND"], ("Khoản", "VND VND", "a"): ["Khoản", "31/12/2020 VND", "a"], ("K", "Cột 1", "", "x", "y"): ["K", "31/12/2020 Giá gốc", "31/12/2020 Dự phòng / Khả dụng", "1/1/2020 Giá gốc", "1/1/2020 Dự phòng / Khả dụng"], ("K", "", "n", "Cột 3"): ["K", "Số cuối kỳ (2020) VND", "n", "Chỉ tiêu 3"], ("K", "y" * 41): ["K", "Số cuối kỳ (2020) VND"]}
    for given, want in heads.items():
        assert one(spark, (list(given),), m.polished_heads(F.col("h"), F.lit(2020)), schema="h array<string>") == (want,)
    assert one(spark, "| a | dòng tiêu đề dài hơn hai mươi |\n|---|---|\n| chữ | và chữ |", m.demoted_table(F.col("s"), F.array(F.lit("a"), F.lit("dòng tiêu đề dài hơn hai mươi")))) == ("dòng tiêu đề dài hơn hai mươi chữ và chữ",)
    for content, want in (('{"a": 1}', "json"), ("<TABLE><tr></tr></TABLE>", "html"), ("x\n | a |", "markdown"), ("chữ", None), (None, None), ("{x", None)):
        assert one(spark, (content,), m.format_of(F.col("s"))) == (want,)
    assert one(spark, "| a | bbb |\n|---|---|\n| ccccc | d |", m.fixed_width(m.grid(F.col("s")), F.array(F.lit(False), F.lit(False)), F.array(F.lit(True), F.lit(False)))) == ("|   a   | bbb |\n| ccccc | d   |",)
