"""Cases of the column functions, and empty inputs."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import html_tables as h
from ledgerloom.functions import markdown as m
from ledgerloom.functions import numbers as n
from ledgerloom.functions import text as t


def values(spark, rows, *columns):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, s string")
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


def test_scanned_numbers(spark):
    cases = {"1O,OOO": 10000.0, "5O.OOO.OOO": 5e7, "l,234": 1234.0, "I,500,000": 1.5e6, "(1,234)": -1234.0, "( 50.000.000 )": -5e7, "-": 0.0, "–": 0.0, "": None, "words": None, "V.01": None, "50%": 50.0, "1.234,56": 1234.56, "1,234.56": 1234.56, "0.123": 0.123, "12.5": 12.5, "1-5": None, "-1.000": -1000.0, "（7）": -7.0, None: None}
    assert [v for (v,) in values(spark, list(cases), n.ocr_number(F.col("s")))] == list(cases.values())


def test_table_numbers(spark):
    cases = {"( 85.000.000.000 )": (-85e9, True), "(50.5)": (-50.5, True), "-15.400.000": (-15.4e6, True), "1.000": (1000.0, False), "l,234": (None, False), "50%": (None, False), "inf": (None, False), "1e5": (None, False), "-": (0.0, False), "": (None, False)}
    got = [tuple(v) for (v,) in values(spark, list(cases), n.table_number(F.col("s")))]
    assert got == list(cases.values())


def test_tolerance_ratio_growth(spark):
    df = spark.createDataFrame([(100.0, 101.5), (1e9, 1e9 + 5e4), (1e9, 1.1e9), (0.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(n.approx_equal(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, None]
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 0.0), (1.0, -2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(n.ratio(F.col("a"), F.col("b"))).collect()] == [0.3333, None, None, None]
    assert [r[0] for r in df.select(n.growth(F.col("a"), F.col("b"))).collect()] == [-66.67, None, 150.0, None]


def test_cells_and_units(spark):
    assert values(spark, ["  NaN ", "a –\n b", None, "(1.234)", "x|y"], n.clean_cell(F.col("s")), n.markdown_cell(F.col("s"))) == [("", ""), ("a - b", "a - b"), ("", ""), ("(1.234)", "-1.234"), ("x|y", "x\\|y")]
    assert [v for (v,) in values(spark, ["Đơn vị tính: Triệu đồng", "ĐƠN VỊ TÍNH : TỶ ĐỒNG", "12 tỷ đồng", "bằng VND.", "x", None], n.currency_unit(F.col("s")))] == ["TRIEU_VND", "TY_VND", "TY_VND", "VND", None, None]


def test_tables(spark):
    text = "before\n| a | b | c |\n|---|---|---|\n| x | 1 |\n| y | (2) | z |\nafter"
    ((g, p, md, al, den),) = values(spark, [text], m.grid(F.col("s")), m.padded(m.grid(F.col("s"))), m.to_markdown(m.grid(F.col("s"))), m.aligned(F.col("s")), m.density(m.grid(F.col("s"))))
    assert g == [["a", "b", "c"], ["x", "1"], ["y", "(2)", "z"]] and p[1] == ["x", "1", ""]
    assert md == "| a | b | c |\n| --- | --- | --- |\n| x | 1 |  |\n| y | (2) | z |" and al.split("\n")[3] == "| x | 1 |  |" and den == pytest.approx(0.4)
    ((hd,),) = values(spark, ["x"], m.merged_header(F.array(F.lit(""), F.lit("Năm nay"), F.lit("")), F.array(F.lit(""), F.lit("Giá"), F.lit("Hao mòn"))))
    assert hd == ["Cột_1", "Năm nay - Giá", "Năm nay - Hao mòn"]
    ((c,),) = values(spark, ["| a | ( 1.000 ) | 1 .234 | --- |\n|---|---|"], m.clean_numeric_cells(F.col("s")))
    assert c == "| a | (1.000) | 1.234 | - |\n|---|---|"


@pytest.mark.parametrize(
    ("headers", "roles"),
    [
        (["Chỉ tiêu", "Mã số", "Thuyết minh", "Số cuối năm", "Số đầu năm"], (0, 1, 2, 3, 4)), (["Chỉ tiêu", "Mã số", "01/01/2024", "31/12/2024"], (0, 1, None, 3, 2)),
        (["a", "b", "c", "d", "e"], (0, 1, 2, 3, 4)), (["a", "b", "c"], (0, None, None, 1, 2)), (["Item", "Code", "This year"], (0, 1, None, 2, None)),
    ],
)
def test_column_roles(spark, headers, roles):
    df = spark.createDataFrame([(headers,)], "h array<string>")
    assert tuple(df.select(m.column_roles(F.col("h")).alias("r")).first()["r"]) == roles


def test_texts(spark):
    assert [v for (v,) in values(spark, ["1. Tiền và Tương đương!", "", "Đường"], t.slug(F.col("s")))] == ["1-tien-va-tuong-duong", "section", "duong"]
    assert [v for (v,) in values(spark, ["# A\n## B\nx", "###### F"], t.demoted(F.col("s"), 2))] == ["### A\n#### B\nx", "###### F"]
    assert [v for (v,) in values(spark, ["keep\n 7 \n12345678\na a a a a a a\n<details><summary>seal</summary>x</details>\nseal\n![i](data:image/png;base64,AA)"], t.without_boilerplate(F.col("s")))] == ["keep"]
    assert [v and tuple(v) for (v,) in values(spark, ["6-8", "45", "68", "1253", "1,011", "7", "x"], t.toc_pages(F.col("s")))] == [(6, 8), (45, 45), (6, 8), (12, 53), (10, 11), (7, 7), None]
    assert [v for (v,) in values(spark, ["Lợi nhuận (20 = 10 - 11)", "x"], t.code_in_label(F.col("s")))] == ["20", None]
    assert [v for (v,) in values(spark, ["THONG TU số"], t.corrected(F.col("s"), [(r"\bthong tu\b", "Thông tư")]))] == ["Thông tư số"]


def test_html_tables(spark):
    text = "<table><tr><th rowspan=2>a</th><th colspan='2'>b</th></tr><tr><th>c</th><th>d</th></tr><tr><td>1<td>2<br>3</td><td>x &amp; y</td></tr></table><p>t</p><TABLE><tr><td>q</td></tr></TABLE>"
    one, two = h.grids(text)
    assert one["cells"] == [["a", "b", "b"], ["a", "c", "d"], ["1", "2 3", "x & y"]] and one["spans"] == [[0, 0, 1, 0], [0, 1, 0, 2]] and one["header_rows"] == 2 and two["rows"] == 1
    assert h.grids(h.to_html(one))[0]["cells"] == one["cells"]
    assert [v and len(v) for (v,) in values(spark, [text, "none", "", None, "<table"], h.html_grids(F.col("s")))] == [2, [], [], None, []]


def test_lists_objects_and_areas(spark):
    assert [v for (v,) in values(spark, ['["a","đ"]', "{bad", None], t.json_list(F.col("s")))] == [["a", "đ"], [], []]
    assert [v for (v,) in values(spark, ['say {"a": {"b": 1}} ok', "{no", ""], t.first_json(F.col("s")))] == ['{"a": {"b": 1}}', None, None]
    df = spark.createDataFrame([([0, 0, 1, 1], [0, 0, 1, 1]), ([0, 0, 0, 1], [0, 1, 0, 2]), ([0, 0, 0, 0], [5, 5, 5, 5])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(n.overlap(F.col("a"), F.col("b"))).collect()] == [1.0, pytest.approx(1 / 3), 0.0]
    ((w,),) = values(spark, ["| a | 1.000 |\n|---|---|\n| bcd | 5 |"], m.fixed_width(m.grid(F.col("s")), F.array(F.lit(False), F.lit(True))))
    assert w == "| a   | 1.000 |\n| bcd |     5 |"
