from pyspark.sql import functions as F

from ledgerloom.operators import export, layout


def test_paragraphs_and_columns(spark):
    b = spark.createDataFrame([("d", 1, 0.0, 10.0), ("d", 1, 12.0, 22.0), ("d", 1, 60.0, 70.0), ("d", 2, 5.0, 9.0)], "doc_id string, page int, top double, bottom double")
    assert sorted((r.page, r.top, r.paragraph) for r in layout.paragraphs(b).collect()) == [(1, 0.0, 1), (1, 12.0, 1), (1, 60.0, 2), (2, 5.0, 1)]
    x = spark.createDataFrame([(10.0,), (60.0,), (55.0,)], "x double")
    assert [r[0] for r in x.select(layout.nearest_column(F.col("x"), F.array(F.lit(10.0), F.lit(100.0)))).collect()] == [0, 1, 0]
    assert layout.paragraphs(b.where("false")).count() == 0


def test_located_rows(spark):
    cells = spark.createDataFrame([("d", "t", 0, 0, "Chỉ tiêu"), ("d", "t", 0, 1, "Mã số"), ("d", "t", 1, 0, "Tổng tài sản"), ("d", "t", 1, 1, "270"), ("d", "t", 2, 0, "Hàng tồn kho"), ("d", "t", 2, 1, "")], "doc_id string, block_id string, row int, col int, cell string")
    wanted = spark.createDataFrame([("d", "t", "A", "270", "x"), ("d", "t", "B", "140", "Hang ton kho"), ("d", "t", "C", "1", "khác hẳn")], "doc_id string, block_id string, concept string, code string, name string")
    assert sorted((r.concept, r.row, r.how) for r in layout.located_rows(cells, wanted).collect()) == [("A", 1, "code"), ("B", 2, "label"), ("C", None, None)]
    assert [(r.row, r.hits) for r in layout.header_rows(cells).collect()] == [(0, 2)]


def test_contents_and_titles(spark):
    lines = spark.createDataFrame([("d", "Bảng cân đối ...... 6-8"), ("d", "| Lưu chuyển | 1,011 |"), ("d", "no page here"), ("d", None)], "k string, t string")
    got = sorted((r.title, r.first, r.last) for r in layout.contents_lines(lines, "k", "t").collect())
    assert got[0] == ("Bảng cân đối", 6, 8)
    t = spark.createDataFrame([("d", "s", "Bảng cân đối kế toán", 2)], "doc_id string, id string, title string, page int")
    p = spark.createDataFrame([("d", 2, "mục lục"), ("d", 4, "BẢNG CÂN ĐỐI KẾ TOÁN"), ("d", 9, "bảng cân đối kế toán")], "doc_id string, page int, text string")
    assert [(r.id, r.page) for r in layout.announced_pages(t, p).collect()] == [("s", 4)]


def test_markdown_export(spark):
    b = spark.createDataFrame([("d", 1, 2, "# Head\ntext"), ("d", 1, 1, "first"), ("d", 2, 1, None), ("d", 2, 2, "d")], "doc_id string, page int, place int, content string")
    assert export.markdown_of(b).first()["markdown"] == "# d\n\nfirst\n\n## Head\ntext"
    assert export.markdown_of(b.where("false")).count() == 0
