"""Headings of notes: blocks cut where they hold several headings, the parts of the notes by number and meaning, numbered notes with guards, sub-items, and the two major parts of a report.

What a line is follows from rules kept as tables. Only what depends on the headings before it (the guard of
note numbers) is a fold, over the headings of one document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import ascii_slug, without_boilerplate
from ledgerloom.operators.blocks import once, reading_order
from ledgerloom.tables import table

# The nine parts of the notes: Roman number, code, the most notes in it.
PARTS = [
    ("I", "NOTE_SEC_GENERAL_INFO", 7),
    ("II", "NOTE_SEC_ACCOUNTING_PERIOD", 2),
    ("III", "NOTE_SEC_ACCOUNTING_STANDARDS", 5),
    ("IV", "NOTE_SEC_ACCOUNTING_POLICIES", 30),
    ("V", "NOTE_SEC_GOING_CONCERN", 5),
    ("VI", "NOTE_SEC_BALANCE_SHEET", 35),
    ("VII", "NOTE_SEC_INCOME_STATEMENT", 15),
    ("VIII", "NOTE_SEC_CASH_FLOW", 6),
    ("IX", "NOTE_SEC_OTHER_INFO", 10),
]
# Words of a title that tell its part whatever its number, the first that holds counts: every group needs one of its words.
MEANINGS = [
    ("IX", [["những thông tin khác", "nhung thong tin khac"]]),
    ("VIII", [["lưu chuyển"], ["tiền tệ"]]),
    ("VII", [["kết quả"], ["kinh doanh", "hoạt động"]]),
    ("VI", [["bảng cân đối", "cân đối kế toán", "tình hình tài chính"]]),
    ("V", [["không đáp ứng"], ["hoạt động liên tục", "lien_tuc"]]),
    ("IV", [["chính sách kế toán"]]),
    ("III", [["chuẩn mực", "chế độ kế toán"]]),
    ("II", [["kỳ kế toán", "đơn vị tiền tệ"]]),
    ("I", [["đặc điểm", "thông tin doanh nghiệp"]]),
]
# Parts that reports number one lower, by code.
NUMBERED_LOWER = {"VIII": ("VII", 7), "VII": ("VI", 6), "VI": ("V", 5)}
# The same without a number, by the slug of the line; the policies only in short lines.
SLUGS = [
    ("I", [["thong_tin_doanh_nghiep", "dac_diem_hoat_dong"]]),
    ("II", [["ky_ke_toan"], ["tien_te"]]),
    ("III", [["chuan_muc"], ["che_do_ke_toan"]]),
    ("IV", [["chinh_sach_ke_toan"]]),
    ("V", [["hoat_dong_lien_tuc"], ["khong_dap_ung"]]),
    ("VI", [["thong_tin_bo_sung"], ["bang_can_doi", "can_doi_ke_toan", "tinh_hinh_tai_chinh", "tai_chinh_rieng"]]),
    ("VII", [["thong_tin_bo_sung"], ["ket_qua", "hoat_dong_kinh_doanh"]]),
    ("VIII", [["thong_tin_bo_sung"], ["luu_chuyen"]]),
    ("IX", [["nhung_thong_tin_khac"]]),
]
# Misread words of note titles.
TITLE_FIXES = [
    ("Dụ phong", "Dự phòng"), ("Du phong", "Dự phòng"), ("bữu binh", "hữu hình"), ("buu binh", "hữu hình"), ("vũ bình", "vô hình"), ("vu binh", "vô hình"), ("dử dang", "dở dang"), ("dô dang", "dở dang"),
    ("phái thu", "phải thu"), ("phái trả", "phải trả"), ("phái trá", "phải trả"), ("phai tra", "phải trả"), ("phố thông", "phổ thông"), ("pho thong", "phổ thông"), ("Cơ Sử", "Cơ sở"), ("ngăn hạn", "ngắn hạn"), ("ngãn ban", "ngắn hạn"),
    ("dải hạn", "dài hạn"), ("quân lý", "quản lý"), ("bản hàng", "bán hàng"),
]
# The beginnings of lines that are headings, and what rules a line out.
BEGINNINGS = [
    r"^\d{1,2}(?:\.0{1,2}|[.:\s-])\s*[A-ZÀ-Ỹ]", r"^\d{1,2}\.\d{1,2}[.:\s-]\s*[A-ZÀ-Ỹ]", r"^[IVXLCDM]+(?:[.:\s]\s*|\s+)[A-ZÀ-Ỹ]", r"^\([a-zđ]{1,2}\)[\s.:-]+[A-ZÀ-Ỹ]", r"^[a-zđ]\)[\s.:-]+[A-ZÀ-Ỹ]",
    r"^Các\s+(?:chi\s+nhánh|nhà\s+máy|kho\s+vận|văn\s+phòng|đơn\s+vị|công\s+ty|khoản|quỹ)", r"^(?:Phòng\s+khám|Trung\s+tâm\s+thu\s+mua|Dự\s+phòng\s+trợ\s+cấp)",
]
SLUG_BEGINNINGS = ["chuan_muc_va_che_do_ke_toan", "ky_ke_toan_va_don_vi_tien_te", "chinh_sach_ke_toan", "thong_tin_bo_sung_cho_cac_khoan_muc", "nhung_thong_tin_khac", "thong_tin_doanh_nghiep", "dac_diem_hoat_dong"]
AMOUNTS = ["vnd", "triệu đồng", "tỷ đồng", "%"]
DATES = r"\b(ngày \d+|\d{1,2}/\d{1,2}/\d{4})\b"
LETTERS = "A-ZÀ-Ỹa-zà-ỹ"
#: The major parts that are put in: id suffix and kind of the heading they stand before.
MAJOR = {"core": "s_part_1_core", "notes": "s_part_2_notes"}
NOTES_FROM_PAGE = 12


def _bare(line: Column) -> Column:
    """A line without Markdown signs."""
    return F.trim(F.regexp_replace(line, r"^[#*>\s-]+", ""))


def _holds(text: Column, groups: list[list[str]]) -> Column:
    out = F.lit(True)
    for words in groups:
        out = out & text.rlike("|".join(words))
    return out


def is_heading_line(line: Column) -> Column:
    """Whether a line begins like a heading and holds no amount or date."""
    bare = _bare(line)
    by_slug = (F.length(bare) < 90) & ascii_slug(bare, 200).rlike("|".join(SLUG_BEGINNINGS))
    return (bare.rlike("|".join(f"(?:{p})" for p in BEGINNINGS)) | by_slug) & ~F.lower(bare).rlike("|".join(AMOUNTS)) & ~F.lower(bare).rlike(DATES)


def split_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks with several headings, cut before each heading line but the first line; (..., block_id, part, content). Tables and null texts stay whole; repeated lines of pages are left out of cut blocks."""
    lines = F.filter(F.transform(F.split(without_boilerplate(F.col("content")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.aggregate(
        lines, F.array().cast("array<string>"),
        lambda parts, x: F.when((F.size(parts) > 0) & ~is_heading_line(x), F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat_ws("\n", F.element_at(parts, -1), x)))).otherwise(F.concat(parts, F.array(x))),
    )
    whole = F.array(F.col("content"))
    parts = F.when((F.col("block_type") == "table") | F.col("content").isNull(), whole).otherwise(cut)
    b = blocks.withColumn("_p", parts)
    b = b.withColumn("_p", F.when(F.size("_p") > 1, F.col("_p")).otherwise(whole)).withColumn("_n", F.size("_p"))
    keep = [c for c in blocks.columns if c not in ("content", "block_id", "part")]
    out = b.select(*keep, F.col("block_id").alias("_id"), "_n", F.posexplode("_p").alias("part", "content"))
    return out.withColumn("block_id", F.when(F.col("_n") > 1, F.concat("_id", F.lit("_sub_"), "part")).otherwise(F.col("_id"))).drop("_id", "_n")


def notes_part(line: Column) -> Column:
    """(code, number) of the part of the notes that a line is the title of, or null: by its Roman number and words, else by its slug."""
    code = {r: (c, k + 1) for k, (r, c, _) in enumerate(PARTS)}
    out = lambda r, n=None: F.struct(F.lit(code[r][0]).alias("code"), F.lit(n or code[r][1]).alias("number"))
    t = _bare(line)
    roman = F.upper(F.regexp_extract(t, r"(?i)^(IX|VIII|VII|VI|IV|V|III|II|I|L|1)[.:\s-]+(.*)$", 1))
    rest = F.lower(F.trim(F.regexp_extract(t, r"(?i)^(IX|VIII|VII|VI|IV|V|III|II|I|L|1)[.:\s-]+(.*)$", 2)))
    by_number = F.when(roman.isin("L", "1") & _holds(rest, MEANINGS[-1][1]), out("I"))
    true_roman = (roman != "") & ~roman.isin("L", "1")
    for r, groups in MEANINGS:
        if r in NUMBERED_LOWER:
            lower, n = NUMBERED_LOWER[r]
            by_number = by_number.when(true_roman & _holds(rest, groups) & (roman == lower), out(r, n))
        by_number = by_number.when(true_roman & _holds(rest, groups), out(r))
    for r, *_ in PARTS:
        by_number = by_number.when((roman == r) & (F.length(rest) > 2), out(r))
    slug = ascii_slug(t, 400)
    by_slug = F.lit(None).cast("struct<code:string,number:int>")
    for r, groups in reversed(SLUGS):
        short = F.length(t) < 80 if r == "IV" else F.lit(True)
        by_slug = F.when(short & _holds(slug, groups), out(r)).otherwise(by_slug)
    return F.when(roman.isin("L", "1"), by_number).otherwise(F.coalesce(by_number, by_slug))


def numbered_note(line: Column) -> Column:
    """(number, title) of a numbered note, misread words put right, or null: the title begins with a letter, and holds no amount, date or list sign; short words in capitals are no title."""
    t = F.regexp_replace(_bare(line), r"^(\d{1,2})\.0{1,2}\s+", "$1. ")
    t = F.trim(F.regexp_replace(t, r"[:\s.]+$", ""))
    pattern = rf"^(\d{{1,2}})(?:[.:\s-]+)([{LETTERS}][{LETTERS}0-9\s,–—/-]{{2,79}})$"
    number = F.regexp_extract(t, pattern, 1).try_cast("int")
    title = F.trim(F.regexp_replace(F.trim(F.regexp_extract(t, pattern, 2)), r"(?iu)\s+(?:NHH|NH|KP|TN|CY|ÁNI|OCY)$", ""))
    low = F.lower(t)
    ok = number.isNotNull() & ~title.rlike("[;,]$") & ~low.rlike("|".join(AMOUNTS)) & ~low.rlike(DATES) & ~title.rlike(r"\b\d{1,3}\.\d{3}\b")
    for wrong, right in TITLE_FIXES:
        title = F.regexp_replace(title, rf"(?iU)\b{wrong}\b", right)
    noise = ~title.contains(" ") & (F.length(title) <= 6) & (F.upper(title) == title)
    return F.when(ok & ~noise, F.struct(number.alias("number"), title.alias("title")))


def sub_item(line: Column) -> Column:
    """(kind, mark, title) of a sub-item: decimal (1.1), letter (a) or group (Các khoản ...), or null."""
    t = F.trim(F.regexp_replace(_bare(line), r"[:\s.]+$", ""))
    decimal = rf"^(\d{{1,2}}\.\d{{1,2}})[.:\s-]+([{LETTERS}][{LETTERS}0-9\s,–—/()&'\"-]{{2,90}})$"
    letter = rf"^\(?([a-zđ]{{1,2}})\)[.:\s-]*([{LETTERS}].{{2,90}})$"
    group = BEGINNINGS[5]
    of = lambda kind, mark, title: F.struct(F.lit(kind).alias("kind"), mark.alias("mark"), title.alias("title"))
    return (
        F.when(t.rlike(decimal), of("decimal", F.regexp_extract(t, decimal, 1), F.trim(F.regexp_extract(t, decimal, 2))))
        .when(t.rlike(letter), of("letter", F.regexp_extract(t, letter, 1), F.trim(F.regexp_extract(t, letter, 2))))
        .when(t.rlike(group) & (F.length(t) < 90), of("group", F.lit(""), t))
    )


def core_statement(line: Column) -> Column:
    """The core statement a short line is the title of, or null."""
    low = F.lower(_bare(line))
    titles = [("BALANCE_SHEET", "báo cáo tình hình tài chính|bảng cân đối kế toán"), ("INCOME_STATEMENT", "báo cáo kết quả hoạt động kinh doanh"), ("CASH_FLOW", "báo cáo lưu chuyển tiền tệ")]
    short = (F.length(low) < 75) & ~low.rlike("thông tin bổ sung|thuyết minh|bổ sung")
    return F.coalesce(*[F.when(short & low.rlike(p), F.lit(c)) for c, p in titles])


FOUND = "doc_id string, page int, place int, block_id string, kind string, code string, number int, title string"


def found(blocks: DataFrame, core_until: int = NOTES_FROM_PAGE) -> DataFrame:
    """(doc_id, page, place, block_id, kind, code, number, title): the headings that begin blocks, in reading order: core, part, note, decimal, letter, group. Core statements are looked for up to a page."""
    ordered = reading_order(blocks.where("block_type = 'text' and content is not null"))
    line = F.regexp_extract(F.ltrim(F.col("content")), r"^([^\n]*)", 1)
    b = split_blocks(ordered).withColumn("_l", line)
    b = b.withColumns({"_core": F.when(F.col("page") <= core_until, core_statement(F.col("_l"))), "_part": notes_part(F.col("_l")), "_note": numbered_note(F.col("_l")), "_sub": sub_item(F.col("_l"))})
    title = _bare(F.col("_l"))
    one = lambda kind, code, number, title: F.struct(F.lit(kind).alias("kind"), code.cast("string").alias("code"), number.cast("int").alias("number"), title.alias("title"))
    h = F.coalesce(
        F.when(F.col("_part").isNotNull(), one("part", F.col("_part.code"), F.col("_part.number"), title)),
        F.when(F.col("_core").isNotNull(), one("core", F.col("_core"), F.lit(None), title)),
        F.when(F.col("_sub.kind") == "decimal", one("decimal", F.col("_sub.mark"), F.lit(None), F.col("_sub.title"))),
        F.when(F.col("_note").isNotNull(), one("note", F.lit(None), F.col("_note.number"), F.col("_note.title"))),
        F.when(F.col("_sub").isNotNull(), F.struct(F.col("_sub.kind").alias("kind"), F.col("_sub.mark").alias("code"), F.lit(None).cast("int").alias("number"), F.col("_sub.title").alias("title"))),
    )
    out = b.withColumn("_h", h).where("_h is not null")
    return out.select("doc_id", "page", (F.col("place") * 1000 + F.col("part")).cast("int").alias("place"), "block_id", "_h.kind", "_h.code", "_h.number", "_h.title")


def guarded(headings: DataFrame) -> DataFrame:
    """Headings without the notes that cannot be: in parts 4, 5, 6 and 8 numbers rise, but start again at 5 or below once 20 is reached; no part has more notes than it may. Notes get the code of their part."""
    most = {c: n for _, c, n in PARTS}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        code, part, last, keep, codes = None, 0, 0, [], []
        for r in pdf.sort_values(["page", "place"], kind="stable").itertuples():
            if r.kind == "part":
                code, part, last = r.code, int(r.number), 0
            elif r.kind == "note":
                n = int(r.number)
                if part in (4, 5, 6, 8) and last:
                    if last >= 20 and n <= 5:
                        last = 0
                    elif n <= last:
                        continue
                if n > most.get(code, 99):
                    continue
                last = n
            keep.append(r.Index)
            codes.append(code if r.kind == "note" else r.code)
        return pdf.loc[keep].assign(code=codes)

    return headings.groupBy("doc_id").applyInPandas(fold, FOUND)


def major_parts(headings: DataFrame) -> DataFrame:
    """(doc_id, part, page, place): the major parts to put in: the core one before the first core statement, the notes one before the first part or note after that, or on page 12 or later."""
    at = F.struct("page", "place")
    core = headings.where("kind = 'core'").groupBy("doc_id").agg(F.min(at).alias("_core"))
    notes = headings.where("kind in ('part', 'note')").join(core, "doc_id", "left").where((F.col("page") >= NOTES_FROM_PAGE) | (at > F.col("_core")))
    first = notes.groupBy("doc_id").agg(F.min(at).alias("_at")).withColumn("part", F.lit(MAJOR["notes"]))
    return core.withColumnRenamed("_core", "_at").withColumn("part", F.lit(MAJOR["core"])).unionByName(first).select("doc_id", "part", "_at.page", "_at.place")


# ---- Queries ----------------------------------------------------------------------------------------


def _text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "blocks"))


def blocks_with_headings(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks by the number of pieces that their headings cut them into."""
    b = split_blocks(_text_blocks(spark, d).select("doc_id", F.col("block_id").alias("whole"), "block_id", "block_type", "content").where("block_type = 'text'"))
    return b.groupBy("doc_id", "whole").agg(F.count("*").alias("pieces")).groupBy("pieces").agg(F.count("*").alias("blocks"))


def note_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of documents that hold up under the guards, by kind and code."""
    return guarded(found(_text_blocks(spark, d))).groupBy("kind", "code").agg(F.count("*").alias("headings"), F.countDistinct("doc_id").alias("documents"))


def report_parts(spark: SparkSession, d: str) -> DataFrame:
    return major_parts(guarded(found(_text_blocks(spark, d))))


QUERIES = {f.__name__: f for f in (blocks_with_headings, note_headings, report_parts)}
