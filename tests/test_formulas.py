import pytest
from pyspark.sql import functions as F

from tessera.operators import formulas as X

SHEET = {
    "cash and cash equivalents": (10605.0, 8589.0), "marketable securities": (51951.0, 34621.0), "accounts receivable net": (38466.0, 23065.0),
    "total current assets": (125605.0, 80126.0), "total current liabilities": (32163.0, 18047.0), "short term debt": (999.0, None),
    "long term debt": (7469.0, 8463.0), "total shareholders' equity": (157293.0, 79327.0), "total liabilities": (49510.0, 32274.0),
    "total assets": (206803.0, 111601.0), "inventories": (21403.0, 10080.0), "goodwill": (20832.0, 5188.0),
}


@pytest.fixture(scope="module")
def got(spark):
    rows = [("f", "balance_sheet", item, 2026 - k, v, f"c_{item}") for item, vs in SHEET.items() for k, v in enumerate(vs)]
    facts = spark.createDataFrame(rows, "filing string, statement string, item string, fy int, value double, chunk_id string")
    return {(r["formula"], r["fy"], r["metric"]): r for r in X.working(X.compute(facts, ["filing"])).collect()}


@pytest.mark.parametrize("name, want", [("current_ratio", 3.91), ("working_capital", 93442.0), ("quick_ratio", 3.14), ("debt_to_equity", 0.054), ("liabilities_to_equity", 0.315), ("equity_ratio", 0.761), ("cash_and_investments", 62556.0)])
def test_ratios(got, name, want):
    r = got[name, 2026, None]
    assert r["status"] == "ok" and r["rounded"] == want and all(i["chunk_id"].startswith("c_") for i in r["inputs"])


@pytest.mark.parametrize("item, percent, amount", [("total assets", 85.3, 95202.0), ("inventories", 112.3, 11323.0), ("goodwill", 301.5, 15644.0)])
def test_change_on_the_year(got, item, percent, amount):
    assert got["yoy_change_pct", 2026, item]["rounded"] == percent and got["yoy_change_abs", 2026, item]["rounded"] == amount
    assert got["yoy_change_pct", 2026, item]["shown"] == f"+{percent}%"


def test_nil_and_missing(got):
    r = got["debt_to_equity", 2025, None]
    assert r["status"] == "ok" and r["rounded"] == round(8463 / 79327, 3)
    assert [i["nil"] for i in r["inputs"] if i["name"] == "short_term_debt"] == [True]
    r = got["yoy_change_abs", 2026, "short term debt"]
    assert r["status"] == "missing_inputs" and r["missing"] == ["short term debt (FY2025 is nil)"] and r["result"] is None and r["shown"] == "n/a"
    r = got["yoy_change_abs", 2025, "goodwill"]
    assert r["missing"] == ["goodwill (FY2024)"]
    assert not any(y > 2026 for _, y, _ in got)


def test_zero_divisor_and_no_facts(spark):
    schema = "filing string, statement string, item string, fy int, value double, chunk_id string"
    rows = [("f", "balance_sheet", "total current assets", 2026, 1.0, "a"), ("f", "balance_sheet", "total current liabilities", 2026, 0.0, "b"), ("f", None, None, None, None, None)]
    by = {r["formula"]: r["status"] for r in X.compute(spark.createDataFrame(rows, schema), ["filing"]).where("metric is null").collect()}
    assert by["current_ratio"] == "error" and by["working_capital"] == "ok" and by["quick_ratio"] == "missing_inputs"
    assert X.compute(spark.createDataFrame([], schema), ["filing"]).count() == 0


def test_expressions(spark):
    one = spark.createDataFrame([(1.0, 2.0, 4.0, -3.0)], "a double, b double, c double, x double")
    for text, want in (("(a + b) / c * 100", 75.0), ("abs(x)", 3.0), ("-max(a, b, x) + min(a, c)", -1.0), ("a / (b - 2)", None)):
        assert one.select(X.compile_expression(text, "abcx").alias("r")).first()["r"] == want
    for text in ("__import__('os')", "a ** 9", "a.b", "unknown", "abs(a, b)", "max(a, key=b)", "a if b else c", "True", "'s'", "a +", "min()"):
        with pytest.raises(ValueError):
            X.compile_expression(text, "abcx")


def test_formulas_asked_for(spark):
    rows = [(1, "What is the current ratio and working capital?"), (2, "Goodwill growth year over year?"), (3, "What is goodwill?"), (4, None)]
    got = {(r["id"], r["formula"]) for r in X.select_formulas(spark.createDataFrame(rows, "id int, question string")).collect()}
    assert got == {(1, "current_ratio"), (1, "working_capital"), (2, "yoy_change_pct")}
