import pytest

from tessera.operators import statements as S

SCHEMA = "table_id string, row_no int, label string, values array<double>"
SHEET = [
    ("Assets", []), ("Current assets:", []), ("Cash and cash equivalents", [10605.0, 8589.0]), ("Inventories", [21403.0, 10080.0]), ("Total current assets", [32008.0, 18669.0]),
    ("Goodwill", [20832.0, 5188.0]), ("Total assets", [52840.0, 23857.0]), ("Liabilities and Shareholders' Equity", []), ("Current liabilities:", []), ("Accounts payable", [9812.0, 6310.0]),
    ("Total current liabilities", [9812.0, 6310.0]), ("Total liabilities", [9812.0, 6310.0]), ("Shareholders’ equity:", []), ("Retained earnings", [43028.0, 17547.0]),
    ("Total shareholders' equity", [43028.0, 17547.0]), ("Total liabilities and shareholders' equity", [52840.0, 23857.0]), ("See notes", [1.0, 1.0]),
]


def sheet(spark, rows=SHEET, name="t"):
    return S.balance_groups(spark.createDataFrame([(name, n, a, b) for n, (a, b) in enumerate(rows)], SCHEMA))


def test_groups(spark):
    got = {r["label"]: r["group"] for r in sheet(spark).collect()}
    want = {"Inventories": "current_assets", "Total current assets": "current_assets", "Goodwill": "non_current_assets", "Total assets": "assets", "Accounts payable": "current_liabilities"}
    want |= {"Retained earnings": "equity", "Total liabilities and shareholders' equity": "liabilities_and_equity", "Assets": "header", "See notes": "footer"}
    assert {k: got[k] for k in want} == want


def test_identity_fails_when_one_unit_is_off(spark):
    good = sheet(spark)
    assert [r["status"] for r in S.check_identity(good).collect()] == ["holds"] and S.require_identity(good) is good
    off = sheet(spark, [(a, [52841.0, 23857.0]) if a == "Total assets" else (a, b) for a, b in SHEET])
    assert [r["status"] for r in S.check_identity(off).collect()] == ["fails"]
    with pytest.raises(ValueError, match="fails"):
        S.require_identity(off)
    with pytest.raises(ValueError, match="lacks"):
        S.require_identity(sheet(spark, [x for x in SHEET if x[0] != "Total assets"]))


def test_subtotals(spark):
    got = {r["group"]: r["holds"] for r in S.check_subtotals(sheet(spark)).collect()}
    assert got == {"current_assets": True, "current_liabilities": True, "equity": True}
    off = sheet(spark, [(a, [21404.0, None]) if a == "Inventories" else (a, b) for a, b in SHEET])
    assert {r["group"]: r["holds"] for r in S.check_subtotals(off).collect()}["current_assets"] is False


def test_wrapped_labels(spark):
    rows = [
        ("t", 1, "Adjustments to reconcile net income to net cash provided by operating", [], 10.0), ("t", 2, "activities:", [], 10.0), ("t", 3, "Stock-based", [], 10.0), ("t", 4, "compensation", [5.0], 10.0),
        ("t", 5, "Operating expenses", [], 10.0), ("t", 6, "Research", [7.0], 30.0), ("t", 7, "Assets", [], 10.0), ("t", 8, "Current assets:", [], 10.0), ("t", 9, None, None, None), ("t", 10, "Last", [], None),
    ]
    got = [(r["row_no"], r["label"]) for r in S.join_wrapped(spark.createDataFrame(rows, SCHEMA + ", x0 double")).orderBy("row_no").collect()]
    assert got == [
        (2, "Adjustments to reconcile net income to net cash provided by operating activities:"), (4, "Stock-based compensation"), (5, "Operating expenses"), (6, "Research"), (7, "Assets"), (8, "Current assets:"), (10, "Last"),
    ]


def test_cells_of_two_readings(spark):
    a = spark.createDataFrame([("t", 1, "basic", [1.0, None]), ("t", 2, "basic", [3.0, 4.0]), ("t", 3, "other", [1.0]), ("t", 4, "alone", [1.0])], "table_id string, row_no int, label_norm string, values array<double>")
    b = spark.createDataFrame([("t", 7, "basic", [1.0]), ("t", 8, "other", [2.0, 1.0]), ("t", 9, "basic", [3.0, 4.0])], a.schema)
    got = {r["row_no"]: (r["agree"], r["differing"]) for r in S.compare_cells(a, b).collect()}
    assert got == {1: (True, []), 2: (True, []), 3: (False, [0, 1]), 4: (None, None)}
