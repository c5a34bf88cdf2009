import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import headings as h

BLOCKS = "doc_id string, block_id string, block_type string, content string, page int, seq int, bbox struct<x0:double,top:double,x1:double,bottom:double>"


def judged(spark, fn, lines):
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    return {r.line: r.v.asDict() if hasattr(r.v, "asDict") else r.v for r in df.select("line", fn(F.col("line")).alias("v")).collect()}


def test_parts_of_the_notes(spark):
    cases = {
        "I. ĐẶC ĐIỂM HOẠT ĐỘNG": ("NOTE_SEC_GENERAL_INFO", 1), "L THÔNG TIN DOANH NGHIỆP": ("NOTE_SEC_GENERAL_INFO", 1), "1. Hình thức sở hữu vốn": None, "II. Kỳ kế toán, đơn vị tiền tệ": ("NOTE_SEC_ACCOUNTING_PERIOD", 2),
        "VII. Thông tin bổ sung báo cáo lưu chuyển tiền tệ": ("NOTE_SEC_CASH_FLOW", 7), "VIII. Báo cáo lưu chuyển tiền tệ": ("NOTE_SEC_CASH_FLOW", 8), "V. Bảng cân đối kế toán": ("NOTE_SEC_BALANCE_SHEET", 5), "VI. Kết quả hoạt động kinh doanh": ("NOTE_SEC_INCOME_STATEMENT", 6),
        "IV: ABC def": ("NOTE_SEC_ACCOUNTING_POLICIES", 4), "IX. x": None, "Chuẩn mực và Chế độ kế toán áp dụng": ("NOTE_SEC_ACCOUNTING_STANDARDS", 3), "Thông tin bổ sung cho các khoản mục trong Bảng cân đối kế toán": ("NOTE_SEC_BALANCE_SHEET", 6),
        "Chính sách kế toán": ("NOTE_SEC_ACCOUNTING_POLICIES", 4), "Chính sách kế toán " + "dài " * 30: None, "Tiền gửi": None, "": None, None: None,
    }
    got = judged(spark, h.notes_part, list(cases))
    assert {k: (v["code"], v["number"]) if v else None for k, v in got.items()} == cases


def test_notes_and_sub_items(spark):
    cases = {"1. Tiền": (1, "Tiền"), "13 Dụ phong phái trả": (13, "Dự phòng phải trả"), "## 04.00 Vay ngăn hạn:": (4, "Vay ngắn hạn"), "5. Tiền 12.000 VND": None, "6. ngày 12 tháng 3": None, "7. NAPHO": None, "2. Một, hai;": None, "20.5 chi phí": None, "8. Hàng tồn kho NHH": (8, "Hàng tồn kho"), None: None}
    got = judged(spark, h.numbered_note, list(cases))
    assert {k: (v["number"], v["title"]) if v else None for k, v in got.items()} == cases
    cases = {"1.1 Các giao dịch": ("decimal", "1.1", "Các giao dịch"), "(a) Phải thu": ("letter", "a", "Phải thu"), "b) Vay dài hạn:": ("letter", "b", "Vay dài hạn"), "Các khoản vay": ("group", "", "Các khoản vay"), "Tiền": None}
    got = judged(spark, h.sub_item, list(cases))
    assert {k: (v["kind"], v["mark"], v["title"]) if v else None for k, v in got.items()} == cases


@pytest.fixture(scope="module")
def document(spark):
    rows = [
        ("text", "Bảng cân đối kế toán", 6), ("text", "IV. Các chính sách kế toán\n1. Cơ sở lập\nnội dung một\n2. Ngoại tệ\nnội dung hai", 12), ("text", "5. Hàng tồn kho", 13), ("text", "3. Lùi lại", 13), ("text", "22. Thuê tài sản", 14), ("text", "2. Bắt đầu lại", 15),
        ("text", "II. Kỳ kế toán", 16), ("text", "2. Đơn vị", 16), ("text", "3. Quá nhiều", 16), ("table", "| 1. Tiền | 5 |\n| 2. Vay | 6 |", 17), ("text", None, 18), ("text", "", 18),
    ]
    return spark.createDataFrame([("d", f"b{k}", t, c, p, k, (0.0, float(k), 1.0, 1.0)) for k, (t, c, p) in enumerate(rows)], BLOCKS)


def test_blocks_are_cut_at_headings(document):
    got = [(r.block_id, r.content) for r in h.split_blocks(document).orderBy("seq", "part").collect()]
    assert got[1:4] == [("b1_sub_0", "IV. Các chính sách kế toán"), ("b1_sub_1", "1. Cơ sở lập\nnội dung một"), ("b1_sub_2", "2. Ngoại tệ\nnội dung hai")]
    assert len(got) == 14 and ("b9", "| 1. Tiền | 5 |\n| 2. Vay | 6 |") in got and ("b10", None) in got and ("b11", "") in got


def test_guards_and_major_parts(document):
    found = h.found(document)
    kept = [(r.kind, r.number, r.code) for r in h.guarded(found).orderBy("page", "place").collect()]
    policies, period = "NOTE_SEC_ACCOUNTING_POLICIES", "NOTE_SEC_ACCOUNTING_PERIOD"
    # 3 after 5 falls back and is out; 2 after 22 starts again; the second part has two notes at most.
    assert kept == [("core", None, "BALANCE_SHEET"), ("part", 4, policies), ("note", 1, policies), ("note", 2, policies), ("note", 5, policies), ("note", 22, policies), ("note", 2, policies), ("part", 2, period), ("note", 2, period)]
    assert {(r.part, r.page) for r in h.major_parts(found).collect()} == {("s_part_1_core", 6), ("s_part_2_notes", 12)}
    assert h.guarded(found.where("false")).count() == 0
