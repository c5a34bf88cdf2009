"""Behaviour of the operators on small made-up inputs, empty tables among them."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, blocks, evaluate, facts, ocr_geometry, sections, surface, upserts
from ledgerloom.sources import files
from ledgerloom.streaming import ingest

BLOCKS = "doc_id string, block_id string, block_type string, page int, seq int, content string, bbox struct<x0:double,top:double,x1:double,bottom:double>, num_rows int, num_cols int, numeric_density double, headers array<string>, unit string, meta map<string,string>"


def made(spark, rows):
    out = []
    for k, r in enumerate(rows):
        d = {"doc_id": "d", "block_id": f"b{k}", "block_type": "text", "page": 1, "seq": k, "content": "x", "bbox": None, "num_rows": None, "num_cols": None, "numeric_density": None, "headers": None, "unit": None, "meta": None} | r
        out.append(tuple(d.values()))
    return spark.createDataFrame(out, BLOCKS)


def test_reading_order_and_stitching(spark):
    table = "| a | b |\n|---|---|\n| x | 1 |"
    b = made(spark, [
        {"bbox": (0.0, 200.0, 1.0, 1.0)}, {"bbox": (0.0, 50.0, 1.0, 1.0)},
        {"block_type": "table", "page": 2, "content": table, "num_rows": 2, "num_cols": 2}, {"block_type": "table", "page": 3, "content": table, "num_rows": 2, "num_cols": 2},
        {"block_type": "table", "page": 5, "content": table, "num_rows": 2, "num_cols": 2}, {"block_type": "table", "page": 6, "content": "| a |", "num_rows": 1, "num_cols": 2},
    ])
    o = blocks.reading_order(blocks.once(b.union(b)))
    assert [r.block_id for r in o.where("page = 1").orderBy("place").collect()] == ["b1", "b0"]
    s = {r["head"]: r for r in blocks.stitched(o).collect()}
    assert s["b2"].pages == "2,3" and s["b2"].num_rows == 4 and s["b2"].content.count("| x | 1 |") == 2 and s["b2"].content.count("---|") == 2
    assert s["b4"].parts == 1 and s["b5"].parts == 1
    assert blocks.stitched(blocks.reading_order(b.where("false"))).count() == 0


def test_classes_and_kinds(spark):
    b = made(spark, [
        {"block_type": "table", "num_rows": 2, "num_cols": 2, "numeric_density": 0.0}, {"block_type": "table", "num_rows": 9, "num_cols": 5, "numeric_density": 0.6, "headers": ["Chỉ tiêu", "Số cuối năm"]},
        {"block_type": "table", "num_rows": 9, "num_cols": 5, "numeric_density": 0.3, "content": "hàng tồn kho"}, {"content": "Chính sách kế toán và chuẩn mực kế toán"}, {"content": "Kế hoạch sản xuất kinh doanh"}, {"content": "1 2 3 triệu"}, {"content": None, "meta": {"is_scanned": "true"}},
    ])
    got = {r.block_id: (r.label, round(r.confidence, 2)) for r in blocks.classified(b).collect()}
    assert got == {"b0": ("NARRATIVE_TABLE", 0.85), "b1": ("FINANCIAL_STATEMENT", 0.95), "b2": ("NUMERIC_NOTE", 0.88), "b3": ("POLICY", 0.95), "b4": ("MDA", 0.85), "b5": ("MIXED", 0.82), "b6": ("NARRATIVE", 0.85)}
    assert [r.kind for r in blocks.document_kinds(blocks.page_kinds(b)).collect()] == ["native"]


def test_facts_and_audit(spark):
    table = "| Chỉ tiêu | Mã | Cuối kỳ | Đầu kỳ |\n|---|---|---|---|\n| I. Tổng tài sản | 290 | 1.000 | 900 |\n| Tổng nguồn vốn |  | 950 | 900 |\n| Lạ |  | 5 | - |\n| | | 1 | 2 |"
    concepts = spark.createDataFrame([("ASSETS_TOTAL", "290", ["Tổng tài sản"]), ("SOURCES_TOTAL", "490", ["Tổng nguồn vốn"])], "concept string, code string, aliases array<string>")
    rows = facts.mapped(facts.table_rows(made(spark, [{"block_type": "table", "content": table}, {"block_type": "table", "content": None}])), concepts)
    f = facts.unpivoted(rows)
    assert {(r.concept, r.period_type, r.value) for r in f.collect()} == {("ASSETS_TOTAL", "current", 1000.0), ("ASSETS_TOTAL", "previous", 900.0), ("SOURCES_TOTAL", "current", 950.0), ("SOURCES_TOTAL", "previous", 900.0), (None, "current", 5.0), (None, "previous", 0.0)}
    stored = spark.createDataFrame([(1, "d", "current", "ASSETS_TOTAL", "290", "x", 1000.0), (2, "d", "current", "ASSETS_TOTAL", "999", "x", 7.0), (3, "d", "current", "SOURCES_TOTAL", "490", "x", 950.0), (4, "e", "current", "ASSETS_TOTAL", "290", None, 10.0), (5, "e", "current", "SOURCES_TOTAL", None, None, 11.0), (6, "e", "current", None, None, None, None)], "seq long, doc_id string, period_type string, concept string, standard_code string, raw_label string, value double").withColumns({"period": F.lit("2020"), "year": F.lit(2020)})
    chosen = facts.winners(stored, concepts)
    assert {(r.doc_id, r.concept, r.seq) for r in chosen.collect()} == {("d", "ASSETS_TOTAL", 1), ("d", "SOURCES_TOTAL", 3), ("e", "ASSETS_TOTAL", 4), ("e", "SOURCES_TOTAL", 5)}
    checks = audit.checked(audit.wide(chosen))
    assert {(r.doc_id, r.check_id, r.passed) for r in checks.collect()} == {("d", 1, False), ("e", 1, True)}
    assert {(r.doc_id, r.concept, r.score) for r in audit.suspects(checks, stored).collect()} == {("d", "ASSETS_TOTAL", 10), ("d", "SOURCES_TOTAL", 10)}
    trial = audit.what_if(chosen, spark.createDataFrame([("d", "SOURCES_TOTAL", 1000.0), ("d", "ASSETS_TOTAL", 1.0), ("d", "ASSETS_TOTAL", None)], "doc_id string, concept string, value double"))
    assert {(r.concept, r.accepted) for r in trial.collect()} == {("SOURCES_TOTAL", True), ("ASSETS_TOTAL", False)}
    assert audit.ratios(audit.wide(facts.winners(stored.where("false"), concepts))).count() == 0


def test_ratios(spark):
    v = {"ASSETS_SHORT": 100.0, "STOCK_NET": 20.0, "CASH_POOL": 10.0, "DEBT_SHORT": 50.0, "DEBT_TOTAL": 80.0, "EQUITY_TOTAL": 120.0, "ASSETS_TOTAL": 200.0, "REVENUE_NET": 300.0, "PROFIT_GROSS": 90.0, "PROFIT_OPERATING": 45.0, "PROFIT_NET": 30.0}
    chosen = spark.createDataFrame([("d", "current", c, k, x, None) for k, (c, x) in enumerate(v.items())], "doc_id string, period_type string, concept string, seq long, value double, raw_label string")
    got = {r.ratio: r.value for r in audit.ratios(audit.wide(chosen)).collect()}
    assert got == {"current_ratio": 2.0, "quick_ratio": 1.6, "cash_ratio": 0.2, "debt_to_equity": 0.6667, "debt_to_assets": 0.4, "financial_leverage": 1.6667, "gross_margin": 0.3, "net_profit_margin": 0.1, "operating_margin": 0.15, "roa": 0.15, "roe": 0.25, "asset_turnover": 1.5, "distress_score": pytest.approx(0.717 * 0.25 + 3.107 * 0.225 + 0.42 * 1.5 + 0.998 * 1.5, abs=1e-4)}


def test_sections(spark):
    s = spark.createDataFrame([("d", "s0", 3, "I. Bảng"), ("d", "s1", 4, "1. Tiền"), ("d", "s2", 5, "a) Quỹ"), ("d", "s3", 3, None), ("d", "s4", 5, "b) Vay")], "doc_id string, id string, level int, title string")
    assert [r.p for r in sections.with_path(s).orderBy("id").select(F.array_join("path", ">").alias("p")).collect()] == ["Bảng", "Bảng>Tiền", "Bảng>Tiền>Quỹ", "", ">Vay"]
    k = spark.createDataFrame([("d", str(i).zfill(2), n) for i, n in enumerate([1, 2, 5, 3, 21, 4, 6, None])], "doc string, o string, n int")
    assert [list(r.accepted) for r in sections.accepted_numbers(k, "doc", "o", "n").collect()] == [[1, 2, 5, 21, 4, 6]]
    t = spark.createDataFrame([("k", "a\n| x |\n|---|\n| y |\nb\n| z |"), ("n", None)], "key string, t string")
    assert [(r.begin, r.lines, r.rows) for r in sections.table_runs(t, "key", "t").collect()] == [(1, 3, 2)]


def test_evaluation(spark):
    assert evaluate.span_scores([], []) == (1.0, 1.0, 1.0) and evaluate.span_scores([[0, 0, 0, 1]], []) == (0.0, 0.0, 0.0)
    assert evaluate.span_scores([[0, 0, 0, 1], [5, 5, 6, 6]], [[0, 0, 0, 1]]) == (0.5, 1.0, pytest.approx(2 / 3))
    a = evaluate.tree_of(3, 2, [], 1)
    assert evaluate.similarity(a, a) == 1.0 and evaluate.tree_distance(a, evaluate.tree_of(2, 2, [], 1)) == 3
    assert evaluate.tree_distance(("a", [("b", [])]), ("a", [("c", []), ("b", [])])) == 1
    schema = "rows:int,cols:int,spans:array<array<int>>,header_rows:int"
    p = spark.createDataFrame([((3, 2, [], 1), (3, 2, [], 1)), ((2, 3, [[0, 0, 0, 1]], 2), (3, 2, [[1, 0, 2, 0]], 1)), (None, (1, 1, [], 1))], f"pred struct<{schema}>, truth struct<{schema}>")
    got = [(r.grid_match, r.teds, list(r.errors)) for r in evaluate.scored(p).where("pred is not null").collect()]
    assert got[0] == (True, 1.0, ["OK"]) and got[1][0] is False and got[1][2] == ["MISSING_ROWS", "COLUMN_COUNT_MISMATCH", "MISSED_MERGED_HEADER", "HALLUCINATED_MERGE", "HEADER_DEPTH_MISMATCH"]
    left = spark.createDataFrame([("g", "l", ["a", "b", "c", "d"]), ("g", "m", ["a"])], "g string, l string, tokens array<string>")
    right = spark.createDataFrame([("g", "r2", ["a", "b", "c"]), ("g", "r1", ["b", "c", "d"]), ("h", "r3", ["a", "b", "c", "d"])], "g string, r string, tokens array<string>")
    assert [(r.l, r.r, r.overlap) for r in evaluate.best_overlap(left, right, "g", "l", "r").collect()] == [("l", "r1", 3)]


def test_boxes(spark):
    items = [("d", "1", 10.0, 10.0, 60.0, 20.0, "Label"), ("d", "1", 100.0, 11.0, 150.0, 21.0, "1."), ("d", "1", 152.0, 11.0, 180.0, 21.0, "234"), ("d", "1", 10.0, 40.0, 58.0, 50.0, "Other"), ("d", "1", 120.0, 41.0, 178.0, 51.0, "5"), ("d", "2", None, 1.0, 2.0, 3.0, "x")]
    df = spark.createDataFrame(items, ocr_geometry.ITEM)
    (r,) = ocr_geometry.rebuilt(df).collect()
    assert r.content == "| Label | 1.234 |\n| --- | --- |\n| Other | 5 |"
    assert not any(x.landscape for x in ocr_geometry.is_landscape(df).collect())


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x", 0), ("b", 2, "y", 0), (None, 9, "z", 0)], "id string, v int, rest string, o int")
    new = spark.createDataFrame([("a", 5, "new", 1), ("a", 6, "newer", 2), ("c", 7, "c", 1)], old.schema)
    assert sorted((r.id or "", r.v, r.rest) for r in upserts.upserted(old, new, "id", ["v"], "o").collect()) == [("", 9, "z"), ("a", 6, "x"), ("b", 2, "y"), ("c", 7, "c")]
    m = upserts.merged(spark.createDataFrame([(" a ", "n", None)], "code string, name string, i string"), spark.createDataFrame([("A", None, "i"), ("B", "", None)], "code string, name string, i string"), "code")
    assert sorted((r.code, r.name, r.i) for r in m.collect()) == [("A", "n", "i"), ("B", "", None)]
    assert upserts.without_slice(old, id="a", v=1).count() == 2
    path = str(tmp_path / "t")
    upserts.store(spark.createDataFrame([("p", 1), ("q", 2)], "k string, v int"), path, ["k"])
    upserts.store(spark.createDataFrame([("p", 3)], "k string, v int"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("p", 3), ("q", 2)]


def test_surface(spark):
    f = spark.createDataFrame([(1, "AB", 2020, "VERIFIED"), (2, " ab ", 2021, None), (3, None, 2021, "VERIFIED")], "seq int, company string, year int, verification_status string")
    assert {r.seq for r in surface.filtered(f, company="ab", limit=0).collect()} == {1, 2}
    assert [r.seq for r in surface.filtered(f, year=2021, order=["-seq"], limit=1).collect()] == [3]
    assert surface.filtered(f.where("false"), company="x").count() == 0


def test_sources(spark, tmp_path):
    for name, content in (("new/p_2.json", [{"block_id": "b", "block_type": "text", "page": 2, "content": "new"}]), ("old/p_2.json", [{"block_id": "b", "content": "old"}]), ("old/p_10.json", {"blocks": [{"block_id": "c", "content": "ten"}]})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(content))
    got = files.page_cache(spark, [str(tmp_path / "new"), str(tmp_path / "old")])
    assert sorted((r.page_no, r.content) for r in got.collect()) == [(2, "new"), (10, "ten")]
    (tmp_path / "doc.md").write_text("# Head\nTrang 4\n| a |\n|---|\n| b |\ntext\n| c |\n")
    t = files.markdown_tables(files.markdown_documents(spark, str(tmp_path / "doc.md")))
    assert sorted((r.begin, r.heading, r.page, r.content.count("\n")) for r in t.collect()) == [(2, "Head", 4, 2), (6, "Head", 4, 0)]
    for name in ("x.json", "x.md", "y.html"):
        (tmp_path / "gt").mkdir(exist_ok=True)
        (tmp_path / "gt" / name).write_text(name)
    assert sorted((r.table_id, r.content) for r in files.by_stem(spark, str(tmp_path / "gt")).collect()) == [("x", "x.md"), ("y", "y.html")]
    assert files.latest_run(spark, str(tmp_path)) in {"new", "old", "gt"}
    d = files.document_metadata(spark.createDataFrame([("BCTC_VNM_2023_2024", ""), ("report", "Sữa Việt 2022")], "stem string, cover string"), {"sữa việt": "VNM"})
    assert [(r.ticker, r.year) for r in d.collect()] == [("VNM", 2024), ("VNM", 2022)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "t.parquet")
    df = spark.createDataFrame([(k, k % 2, f"2024-01-0{1 + k % 3} 00:00:00") for k in range(10)], "id int, g int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(src)
    for k in range(2):
        ingest.ingested(ingest.arriving(spark, str(tmp_path), "t", 1), str(tmp_path / "out"), str(tmp_path / f"state{k}"), ["g"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 10 and back.select("id").distinct().count() == 10
    q = ingest.once_each(ingest.arriving(spark, str(tmp_path), "t"), "ts", ["g"]).writeStream.format("memory").queryName("once_each").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from once_each").count() == 2


def test_listing_and_relocation(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "table_id string")
    assert sorted(tuple(r) for r in evaluate.listing(ids("a", "b"), ids("a", "a"), ids("c")).collect()) == [("a", True, False), ("b", False, False)]
    e = spark.createDataFrame([("d", 1, "| same |", "h"), ("d", 2, "hàng tồn kho mới", "h"), ("d", 3, "zzz", "Head"), ("d", 4, None, None)], "doc_id string, edit_id int, text string, heading string")
    s = spark.createDataFrame([("d", 10, "| same | ", "x"), ("d", 11, "hàng tồn kho", "x"), ("d", 12, "other", "Head"), ("e", 13, "zzz", "Head")], "doc_id string, span_id int, text string, heading string")
    got = {r.edit_id: (r.span_id, r.how) for r in evaluate.relocated(e, s).collect()}
    assert got[2] == (11, "words") and got[3] == (12, "heading") and got[4] == (None, None) and got[1][0] in (10, 11)
