import pandas as pd

from ledgerloom.operators import ocr_geometry as g


def frame(rows):
    return pd.DataFrame([("d", "1", x0, y, x1, y + 10, t) for x0, x1, y, t in rows], columns=[c.split()[0] for c in g.ITEM.split(", ")])


PAGE = [
    (10, 300, 0, "Thuyết minh báo cáo năm nay"),
    (10, 90, 40, "Chỉ tiêu"), (330, 400, 40, "31/12/2020"), (480, 550, 40, "1/1/2020"),
    (10, 120, 60, "1. Tiền gửi có"), (300, 400, 60, "1.234.567"), (450, 550, 60, "7.654.321"),
    (10, 120, 80, "kỳ hạn"),
    (10, 120, 100, "Phải thu"), (300, 350, 100, ")20.899"), (360, 400, 100, "554.450"), (450, 550, 102, "(1.000.000)"),
    (10, 120, 120, "Khác"), (385, 400, 120, "-"), (450, 550, 120, "9.262 413"),
    (10, 400, 140, "(*) Ghi chú của bảng"),
    (10, 400, 180, "Đoạn văn dài về các khoản mục trên, không có số liệu nào trong đó."),
]


def test_page_is_segmented_and_tables_rebuilt(spark):
    rows = [(x.doc_id, x.block_type, x.rows, x.cols, x.content) for x in g.page_blocks(spark.createDataFrame(frame(PAGE), g.ITEM)).orderBy("seq").collect()]
    # The wrapped label is a row of text by itself, too short for a block, and parts the table in two.
    assert [r[1:4] for r in rows] == [("text", None, None), ("table", 1, 3), ("table", 2, 3), ("text", None, None)]
    assert rows[1][4].startswith("| Khoản mục / Chỉ tiêu | 31/12/2020 | 1/1/2020 |\n| --- | --- | --- |\n| 1. Tiền gửi có | 1.234.567 | 7.654.321 |")
    assert rows[3][4].startswith("(*) Ghi chú của bảng\nĐoạn văn dài")


def test_rows_numbers_and_kinds():
    rows = g.rows_of(g.pieces(frame(PAGE)))
    assert [b.text for b in rows[4]] == ["Phải thu", "20.899.554.450", "(1.000.000)"]
    assert [b.text for b in rows[5]] == ["Khác", "-", "9.262.413"]
    assert [g.is_table_row(r) for r in rows] == [False, True, True, False, True, True, False, False]


def test_several_numbers_in_one_box():
    boxes = g.pieces(frame([(0, 100, 0, "20.899.554.450.000 23.225.734.296")]))
    assert [b.text for b in g.pieces(frame([(0, 100, 0, "9.262.413 822.949")]))] == ["9.262.413.822.949"]
    assert [(b.text, b.x0, b.x1) for b in boxes] == [("20.899.554.450.000", 0, 50), ("23.225.734.296", 50, 100)]


def test_table_of_rows_with_wrapped_labels():
    rows = g.rows_of(g.pieces(frame(PAGE)))[1:7]
    heads, cells, notes = g.table_of(rows)
    assert heads == ["Khoản mục / Chỉ tiêu", "31/12/2020", "1/1/2020"]
    assert cells == [["1. Tiền gửi có kỳ hạn", "1.234.567", "7.654.321"], ["Phải thu", "20.899.554.450", "(1.000.000)"], ["Khác", "-", "9.262.413"]]
    assert notes == ["(*) Ghi chú của bảng"]
    assert g.wrapped([["Dự phòng", ""], ["phải thu", "5"], ["II. Khác", ""], ["vay", "6"], ["dài", ""]]) == [["Dự phòng phải thu", "5"], ["II. Khác", ""], ["vay dài", "6"]]


def test_short_or_empty_tables_are_text():
    one = [[g.Box(0, 9, 0, "a"), g.Box(300, 400, 0, "1.000.000")]]
    assert [k for k, _ in g.segments(one)] == ["text"]
    no_figures = [[g.Box(0, 9, y, "a"), g.Box(300, 400, y, "VND")] for y in (0, 20)]
    assert [k for k, _ in g.segments(no_figures)] == ["text"]


def test_awkward_items(spark):
    items = spark.createDataFrame([("d", "1", None, 0.0, 1.0, 9.0, "x"), ("d", "1", 0.0, 0.0, 1.0, 9.0, None), ("d", "1", 0.0, 0.0, 1.0, 9.0, " ")], g.ITEM)
    assert g.page_blocks(items).count() == 0 and g.rebuilt(items).count() == 0
    boxes = spark.createDataFrame([("d", "1", 0.0, 0.0, 5.0, 9.0, "1.000"), ("d", "1", 0.0, 0.0, 50.0, 9.0, "1.000"), ("d", "1", 0.0, 0.0, 50.0, 9.0, "chữ"), ("d", "1", 0.0, 0.0, 50.0, 9.0, "VND")], g.ITEM)
    assert sorted((r.text, r.numeric) for r in g.routed(boxes).collect()) == [("1.000", True), ("VND", True), ("chữ", False)]
