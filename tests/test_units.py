from tessera.operators import units as U

ITEMS = "item_table string, item_id string, value double, unit string, text string, category string, source string, neighbour double"


def table(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def targets(spark):
    return spark.createDataFrame([("money", "usd"), ("mass", "kilograms"), ("rate", "basis_points"), ("energy", "kilowatt_hours"), ("area", "square_metres")], "dimension string, common_unit string")


def test_units_of_field_and_text_with_hardly_a_label(spark):
    rows = [
        ("t", "1", 2.5, " usd MN ", None, "Revenue", "f", None),
        ("t", "2", 3.0, "n/a", "Goodwill (百万美元): 3", "Goodwill", "f", None),
        ("t", "3", 12.5, None, "Rate 12.5. Unit: per cent.", "Rate", "f", None),
        ("t", "4", 2.0, "short tons", None, "Copper", "f", None),
        ("t", "5", None, "USD", None, "Cash", "f", None),
        ("t", "6", float("nan"), "USD", None, "Cash", "f", None),
        ("t", "7", 9.0, "?", None, None, None, None),
        ("t", "1", 2.5, " usd MN ", None, "Revenue", "f", None),
    ]
    got = {(r["item_id"], r["by"]): (r["resolved"], r["common_value"]) for r in U.convert(U.resolve(table(spark, rows)), targets(spark)).distinct().collect()}
    assert got[("1", "recorded")] == ("usd_millions", 2_500_000)
    assert {k[0]: v for k, v in got.items()}["2"] in (("usd_millions", 3_000_000), (None, None))
    assert got[("3", "review")] == (None, None)  # no row is labelled with this unit, so the forest can't name it
    assert {k[0]: v for k, v in got.items()}["4"] == ("short_tons", 1814)
    assert got[("7", "review")] == (None, None)
    assert not {"5", "6"} & {k[0] for k in got}


def test_forest_tells_units_by_size_and_words(spark):
    rows = []
    for i in range(400):
        rows.append(("t", f"a{i}", float(10**9 + i * 1000), "USD", None, "Revenue", "f", None))
        rows.append(("t", f"b{i}", float(i + 5), "USD millions", None, "Revenue", "f", None))
        rows.append(("t", f"c{i}", 0.2 + i / 2000, "fraction", None, "Tax rate", "f", None))
    rows += [("t", "z", 0.4, None, "given in percent", "Tax rate", "f", None)]
    rows += [("t", "x", 0.3, None, "as a fraction of one", "Tax rate", "f", None), ("t", "y", 12.0, "", "amounts in millions of US dollars", "Revenue", "f", None)]
    out = {r["item_id"]: r for r in U.resolve(table(spark, rows)).where("item_id in ('x', 'y', 'z')").collect()}
    assert out["x"]["resolved"] == "fraction" and out["y"]["resolved"] == "usd_millions"
    assert out["x"]["predicted"] == "fraction"
    assert out["z"]["by"] == "review" and out["z"]["resolved"] is None  # the text contradicts the forest


def test_empty_table(spark):
    assert U.convert(U.resolve(table(spark, [])), targets(spark)).count() == 0


def test_factors():
    assert abs(U.UNITS["acres"][1] - 4046.8564224) < 1e-9 and U.UNITS["pounds"][1] == 0.45359237
    assert all(d in ("money", "per_share", "share_count", "rate", "area", "energy", "mass") for d, _, _ in U.UNITS.values())
