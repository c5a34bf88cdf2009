import random

import pytest

from ledgerloom.llm import scan_noise as s

TEXT = "the company recorded an amount of the loan under the plan in the year and the budget for the group was not changed before the quarter công ty ghi nhận chi phí bán hàng trong năm khoản vay được theo dõi tháng tổng thông qua mức đồng nghìn một lần theo tai thuế thực hiện hạn dài ngắn one-off thue thuc"


@pytest.fixture(scope="module")
def repairer():
    words = TEXT.split()
    return s.Repairer({w: 5000 if w not in ("thue", "thuc") else 300 for w in words}, names={"XX017": "cong ty co phan ky ho trieu"})


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("the c0mpany rec0rded an am0unt", {"character"}),
        ("tliông qua rnức chi plií bán liàng", {"character"}),
        ("côn9 ty 9hi nhận", {"character"}),
        ("in the year 2Ol3 the loan of 1.234", {"character"}),
        ("an amount of l.346 in the year", {"character"}),
        ("the com-\npany recorded", {"line-join"}),
        ("the budget for the gr¬\noup was", {"line-join"}),
        ("the one-\noff amount of the group", set()),
        ("the company recorded\nan amount in the year", set()),
        ("the copmany recrded an ammount", set()),
        ("quarter III of the plan, HD711/2013, KW037, R&D (*)", set()),
        ("a price of $5 for T12 and B2B", set()),
        ("Thuc hien theo thue", set()),
        ("chi phí tạ! công ty trong nă!", set()),
        ("ghi nhận khoả! lo| trong tháng!", set()),
        ("ghi nhận ch! phí theo ta|", {"character"}),
    ],
)
def test_characters_and_joins(repairer, text, kinds):
    assert set(repairer.repair(text)[1]) == kinds


@pytest.mark.parametrize(
    ("line", "gone"),
    [
        ("XX017 | Bản in nội bộ 2015", True), ("Công ty Cổ phần Kỳ Hồ Triều – Báo cáo năm 2015", True), ("BÁO CÁO NĂM 2015 CỦA CÔNG TY CỔ PHẦN KỲ HỒ TRIỀU", True), ("- 7 -", True), ("Trang 7/20", True), ("7 | 20", True), ("P. 7", True),
        ("năm 2015, Công ty Cổ phần Kỳ Hồ Triều ghi nhận thêm chi phí", False), ("Kế hoạch năm tới", False), ("12. Vay ngân hàng", False), ("14 tháng.", False),
    ],
)
def test_furniture(repairer, line, gone):
    text = f"khoản vay được theo dõi trong năm và thông qua\n{line}\nmức chi phí của công ty theo kế hoạch trong năm."
    clean, kinds = repairer.repair(text, 7, "XX017", "2015")
    assert ("furniture" in kinds) == gone
    assert (line in clean) != gone


def test_repaired_text(repairer):
    clean, kinds = repairer.repair("the c0mpany recorded an amount of the loan under the\n- 3 -\npl-\nan in the year and the budget for the group was not\nchanged before the quarter.", 3)
    assert clean == "the company recorded an amount of the loan under the plan in the year and the budget for the group was not changed before the quarter." and set(kinds) == {"furniture", "line-join", "character"}
    assert repairer.repair("Chi phí bán hàng ..... 5 (ĐVT: đ)", label=True)[1] == ["page number"]
    assert repairer.repair("Chi phí bán hàng (thuyết minh 12)", label=True)[1] == []


def test_awkward_rows(spark):
    df = spark.createDataFrame([("f", "1", None, None, None, 1), ("f", "2", "", "d", 1, 1), ("f", "3", " \n ", "d", 1, 1), ("f", "4", "the plan " * 30000, "d_x", 1, 1), ("f", "4", "the plan", "d_x", 1, 1)], "field string, record_key string, text string, doc_id string, page int, clean int")
    co = spark.createDataFrame([("XX", None), (None, "y"), ("AA", "Công ty A")], "code string, name string")
    out = s.repaired(df, co).collect()
    assert len(out) == 5 and all(not r.damage for r in out)
    assert {r.record_key: r.clean for r in out}["1"] is None
    assert s.repaired(df.where("false"), co).count() == 0


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("an amount of 62.S39 in the year", "an amount of 62.539 in the year"),
        ("an amount of 24.S92, 1.S64 and 8.B02", "an amount of 24.592, 1.564 and 8.802"),
        ("the loan of SB.B36 or 9,3Sl", "the loan of 58.836 or 9,351"),
        ("the loan of 4.9lO, 3.ll6 or 1Z.B36.OOO", "the loan of 4.910, 3.116 or 12.836.000"),
        ("in the year 2OlS, 202O and 20lB.", "in the year 2015, 2020 and 2018."),
        ("<td>62.S39</td> of the loan", "<td>62.539</td> of the loan"),
        ("khoản vay S,5% trong năm", "khoản vay 5,5% trong năm"),
    ],
)
def test_numbers_are_judged_whole(repairer, text, clean):
    assert repairer.repair(text) == (clean, ["character"])


@pytest.mark.parametrize("text", ["Form B36 of the group, S39, ZZ066 and B8-ZZ194", "B.1 Khoản vay, I.2 tổng, II.3 and B.III", "U.S. loan, 12.345 and 6,9% in 2019", "the plan (l) and (i), 5B"])
def test_codes_and_section_numbers_are_no_numbers(repairer, text):
    assert repairer.repair(text) == (text, [])


def test_long_running_header(repairer):
    line = "Công ty Cổ phần Kỳ Hồ Triều – Báo cáo năm 2015 | Phần thuyết minh kèm theo báo cáo năm 2015 | XX017"
    clean, kinds = repairer.repair(f"khoản vay được theo dõi trong năm và thông qua\n{line}\nmức chi phí của công ty theo kế hoạch trong năm.", 7, "XX017", "2015")
    assert len(line) > 90 and kinds == ["furniture"] and line not in clean
    text = "khoản vay được theo dõi trong năm 2015 và thông qua mức chi phí của công ty theo kế hoạch trong năm của tổng công ty."
    assert repairer.repair(text, 7, "XX017", "2015") == (text, [])


def test_company_names_beyond_any_count(spark):
    text = "khoản vay được theo dõi trong năm và thông qua\n{} – Ghi chú\nmức chi phí của công ty theo kế hoạch trong năm."
    rows = [("f", "1", text.format("Gỗ Đá Nước"), "AA_2015", 7), ("f", "2", text.format("Dệt may bến bãi"), "BB_2015", 7), ("f", "3", text.format("Dệt may bến bãi"), "CC_2015", 7), ("f", "4", text.format("Dệt may bến bãi"), None, 7)]
    df = spark.createDataFrame(rows, "field string, record_key string, text string, doc_id string, page int")
    co = spark.createDataFrame([("AA", "Gỗ Đá Nước"), ("BB", "Dệt may bến bãi"), ("BB", None), ("BB", "Dệt may bến bãi")], "code string, name string")
    assert {r.record_key: r.damage for r in s.repaired(df, co, most=1).collect()} == {"1": ["furniture"], "2": ["furniture"], "3": [], "4": []}


def test_lexicon_beyond_the_broadcast(spark):
    """Buckets joined with the words they ask about give what the broadcast lexicon gives."""
    words = TEXT.split()
    rows = [("blocks.content", str(k), " ".join(words[k % 40 :] + words[: k % 40]), "AA_2015", k % 9) for k in range(120)]
    rows += [("blocks.content", f"d{k}", t, "AA_2015", 3) for k, t in enumerate(["the c0mpany rec0rded an am0unt", "tliông qua chi plií bán liàng", "the com-\npany recorded", "the one-\noff amount", "a sum of 1.2S4 and 2OlS", "côn9 ty 9hi nhận", "- 3 -\nthe group", None, ""])]
    rows += [("financial_facts.raw_label", f"f{k}", t, "AA_2015", 3) for k, t in enumerate(["chi phi 8án hàng", "Chi phí bán hàng ..... 5", "Thuc hien theo thue"])]
    df = spark.createDataFrame(rows, "field string, record_key string, text string, doc_id string, page int")
    co = spark.createDataFrame([("AA", "Công ty A")], "code string, name string")
    whole, parts = (sorted((r.record_key, r.clean or "", tuple(r.damage)) for r in s.repaired(df, co, most=n).collect()) for n in (s.MOST, 3))
    assert whole == parts and sum(bool(x[2]) for x in whole) >= 7


def test_choices_at_one_place():
    """A sign that may be either of two letters becomes the one that makes a word; several places of a word are decided one after the other."""
    e = s.Repairer({"bill": 900, "list": 900, "light": 400, "title": 500, "international": 300, "company": 900, "the": 2000, "of": 3000, "in": 3000}).editor
    assert [e.repaired(x) for x in ("b1ll", "1ist", "t1tle", "Tit1e", "internati0na1", "1nternati0na1", "COMPANY", "II", "B12")] == ["bill", "list", "title", "Title", "international", "international", None, None, None]


def test_the_bound_on_lines_changes_no_answer(repairer):
    rng = random.Random(4)
    words = "chi phí bán 12 2015 báo cáo năm Công ty Kỳ Hồ Triều the Notes XX017 b3 – | - of trang 7 (kế hoạch). tới: ”".split()
    skipped = 0
    for _ in range(3000):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4))]
        k, page, code, year = rng.randrange(len(lines)), rng.choice([7, 12, None]), rng.choice(["XX017", "", "YY1"]), rng.choice(["2015", "", "2016"])
        name = repairer.names.get(code, "")
        judged = repairer.furniture.over(s.line_features(lines, k, page, code, year, name), "furniture", "text")
        assert repairer.is_furniture(lines, k, page, code, year) == (judged and bool(lines[k].strip()))
        skipped += repairer.surely_text(lines, k, code, year, name)
    assert skipped > 300
