from ledgerloom.operators import ontology

CHART = "concept string, code string, statement_type string, ord int, patterns array<string>, guards array<string>"
ROWS = "k int, label string, code string, statement string, concept string"


def test_tiers_and_guards(spark):
    chart = spark.createDataFrame(
        [("GROSS", "01", "INCOME_STATEMENT", 1, ["doanh thu bán hàng"], []), ("SALES_CASH", "01", "CASH_FLOW", 2, ["tiền thu từ bán hàng"], []), ("RECV", "130", "BALANCE_SHEET", 3, ["phải thu ngắn hạn"], ["dự phòng"]), ("ALLOWANCE", "137", "BALANCE_SHEET", 4, ["dự phòng phải thu"], [])], CHART
    )
    rows = spark.createDataFrame(
        [(1, "Doanh thu", "1", None, "x"), (2, "Tiền thu từ bán hàng", "01", None, "x"), (3, "Dự phòng phải thu ngắn hạn", "130", None, "x"), (4, "Phải thu ngắn hạn", None, None, "x"), (5, None, None, None, "x"), (6, "Khác", "999", None, "x"), (7, "Doanh thu", "01", "CASH_FLOW", "x")], ROWS
    ).drop("concept")
    want = {1: ("GROSS", "code"), 2: ("SALES_CASH", "code"), 3: ("ALLOWANCE", "name"), 4: ("RECV", "name"), 5: (None, None), 6: (None, None), 7: ("SALES_CASH", "code")}
    for size in (100, 2):
        assert {r.k: (r.concept, r.tier) for r in ontology.matched(rows, chart, ["k"], broadcast=size).collect()} == want
    assert ontology.matched(rows.where("false"), chart, ["k"]).count() == 0


def test_winner_does_not_depend_on_the_blocks(spark):
    """Two concepts match one label; the lower ord wins, in one block or in many, whatever block each falls into."""
    chart = spark.createDataFrame([(c, None, "BALANCE_SHEET", k, ["vốn"] if c in "ZA" else ["khác"], []) for k, c in enumerate("ZYXWVAUTS")], CHART)
    rows = spark.createDataFrame([(1, "Vốn góp", None, None)], "k int, label string, code string, statement string")
    for size in (100, 4, 2, 1):
        assert [r.concept for r in ontology.matched(rows, chart, ["k"], broadcast=size).collect()] == ["Z"]


def test_guards_in_blocks(spark):
    chart = spark.createDataFrame([("A", None, "BALANCE_SHEET", 1, ["vốn"], ["góp"]), ("B", None, "BALANCE_SHEET", 2, ["vốn góp"], []), ("C", None, "CASH_FLOW", 0, ["vốn"], ["tài sản"])], CHART)
    rows = spark.createDataFrame([(1, "Vốn góp", None, "BALANCE_SHEET"), (2, "vốn", None, None), (3, "Nguồn vốn", None, None)], "k int, label string, code string, statement string")
    for size in (100, 1):
        assert {r.k: r.concept for r in ontology.matched(rows, chart, ["k"], broadcast=size).collect()} == {1: "B", 2: "C", 3: "A"}
