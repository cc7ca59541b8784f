import pytest
from pyspark.sql import functions as F

from tessera.operators import records as R


def test_stored_indexes_and_traces(spark, tmp_path):
    v = spark.createDataFrame([(1, "text", [0.5]), (2, "table", [1.0])], "id int, modality string, v array<double>")
    R.save_vectors(v, str(tmp_path / "v"))
    R.save_vectors(v, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v")).where("modality = 'text'")
    assert [r["id"] for r in back.collect()] == [1] and "modality=text" in str(back.inputFiles())
    R.save_index(str(tmp_path / "i"), postings=v.select("id"), lengths=v.select("id"))
    assert R.load_index(spark, str(tmp_path / "i"), "postings")["postings"].count() == 2
    schema = "request_id string, ts long, latency_ms_by_node map<string,int>, chunks array<struct<chunk_id:string,action:string>>"
    t = spark.createDataFrame([("a", 1, {"x": 5, "y": 7}, [("c", "KEEP")]), ("a", 2, None, None), (None, 3, {}, [])], schema)
    R.append_records(t, str(tmp_path / "t"))
    R.append_records(t.limit(1), str(tmp_path / "t"))
    log = spark.read.parquet(str(tmp_path / "t"))
    assert log.count() == 4 and R.find_record(log, "a").first()["ts"] == 2 and R.find_record(log, "z").count() == 0
    assert sorted((r["node"], r["ms"]) for r in R.node_latencies(t).collect()) == [("x", 5), ("y", 7)]
    assert [tuple(r) for r in R.decided_chunks(t).collect()] == [("a", "c", "KEEP")]


def test_figures_of_a_page(spark):
    kept, gone = R.drop_kinds(spark.createDataFrame([(1, "photo"), (2, "chart"), (3, None), (4, "photo")], "id int, kind string"), "kind", ["photo", "logo"])
    assert sorted(r["id"] for r in kept.collect()) == [2, 3] and [tuple(r) for r in gone.collect()] == [("photo", 2)]
    boxes = [("p", 1, [0.0, 0.0, 200.0, 200.0], False), ("p", 2, [0.0, 0.0, 39.0, 500.0], False), ("p", 3, [300.0, 300.0, 400.0, 400.0], True), ("p", 4, [0.0, 400.0, 100.0, 500.0], False), ("q", 5, None, False)]
    df = spark.createDataFrame([(*b, 600.0, 800.0) for b in boxes], "page_key string, box_id int, bbox array<double>, raster boolean, width double, height double")
    taken = spark.createDataFrame([("p", [0.0, 400.0, 100.0, 460.0])], "page_key string, bbox array<double>")
    assert {r["box_id"]: r["covered"] for r in R.figure_candidates(df, taken).collect()} == {1: 0.0}
    rows = spark.createDataFrame([("See accompanying notes.",), ("Cash",), (None,)], "label string")
    assert [r["label"] for r in R.without_furniture(rows).collect()] == ["Cash", None]


def test_pages(spark):
    pages = spark.createDataFrame([(1,), (4,)], "page int")
    sections = spark.createDataFrame([("a", 1, 3), ("b", 3, 9)], "section string, first_page int, last_page int")
    assert {r["page"]: r["section"] for r in R.section_of_pages(pages, sections).collect()} == {1: "a", 4: "b"}
    with pytest.raises(ValueError, match="page 40"):
        R.section_of_pages(spark.createDataFrame([(40,)], "page int"), sections)
    blocks = spark.createDataFrame([(1, 2, "late"), (1, 1, "first")], "page int, order_no int, label string")
    assert {r["page"]: r["label"] for r in R.label_of_pages(pages, blocks, "none").collect()} == {1: "first", 4: "none"}


def test_fact_documents(spark):
    schema = "page int, row_no int, breadcrumb string, title string, label string, group string, unit string, cells array<struct<value:double,period_end:string,fiscal_year:int>>"
    rows = [(4, 1, "A > B", "Balance Sheets", "Cash (1)", "current_assets", "m", [(10605.0, "2026-01-25", 2026), (None, None, 2025)]), (4, 2, None, None, "Cash", "body", "m", []), (4, 3, None, None, None, None, None, [])]
    got = sorted((r["chunk_id"], r["document"]) for r in R.fact_documents(spark.createDataFrame(rows, schema)).collect())
    assert got[0] == ("rowfact_p4_cash", "[A > B]\nBalance Sheets — Cash (1) [current assets]: 10,605 for the fiscal year ended 2026-01-25 (FY2026); nil for the fiscal year ended ? (FY2025).")
    assert [g[0] for g in got[1:]] == ["rowfact_p4_cash_2", "rowfact_p4_row"]


def test_small_checks(spark):
    facts = spark.createDataFrame([("cash", "b", 2), ("cash", "a", 5), ("debt", "a", 1)], "item string, statement string, position int")
    assert {r["item"]: (r["statement"], r["ambiguous"]) for r in R.statement_of(facts).collect()} == {"cash": ("b", True), "debt": ("a", False)}
    t = spark.createDataFrame([("H20 sells", 1), ("up 5", 1), (None, 1), ("A? B?", 1), ("x", 2)], "t string, n int")
    got = [(r["a"], r["b"]) for r in t.select(R.has_figure(F.col("t")).alias("a"), R.is_multi_part(F.col("t"), F.col("n")).alias("b")).collect()]
    assert got == [(False, False), (True, False), (False, False), (False, True), (False, True)]
    items = spark.createDataFrame([("k", i, 100) for i in range(7)], "k string, i int, tokens int")
    assert [r["part"] for r in R.even_groups(items, "k", "i", 3).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert sorted(r["i"] for r in R.shed(items, "k", "i", "tokens", 50, 210).collect()) == [0, 1]
    assert sorted(r["i"] for r in R.shed(items, "k", "i", "tokens", 50, 10).collect()) == [0]
    rates = spark.createDataFrame([("base", 70.0), ("x", 72.9), ("y", 73.0)], "arm string, rate double")
    assert {r["arm"]: r["passed"] for r in R.gate(rates, "base").collect()} == {"x": False, "y": True}
    one = spark.createDataFrame([(1, "a", None)], "b int, a string, c string")
    assert one.select(R.canonical_json({"b": F.col("b"), "a": F.col("a"), "c": F.col("c")}).alias("j")).first()["j"] == '{"a":"a","b":1}'
    s = spark.createDataFrame([(["x"], ["x", "y"], ["y"]), (["x"], ["y"], None), (None, None, None), (["x"], ["x", "z"], [])], "w array<string>, g array<string>, c array<string>")
    assert [r["ok"] for r in s.select(R.follow_up_ok(F.col("w"), F.col("g"), F.col("c")).alias("ok")).collect()] == [True, False, True, False]
