import pytest
from pyspark.sql import functions as F

from tessera.operators import compression as C
from tessera.operators import verification as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) and (not v or isinstance(v[0], float)) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("Cash was $10,605 million, up 23.5% [C1].", ["$10,605", "23.5%"]), ("-4.2 and 7 000 in FY2026", ["-4.2", "7", "000"]), (None, []), ("no figure", [])])
def test_numbers(spark, text, want):
    assert one(spark, V.numbers(F.col("t")), t=text) == want


@pytest.mark.parametrize("answer, left", [
    ("$10.6 billion", []), ("10,605,000 thousand", []), ("10,606", ["10,606"]), ("5.4%", []), ("0.05", []), ("in 2024, 3 segments", []), ("$31", ["$31"]), ("5.5%", ["5.5%"]), ("-10605", []),
])
def test_supported_numbers(spark, answer, left):
    assert one(spark, V.unsupported(V.numbers(F.col("t")), F.col("a")), t=answer, a=[10605.0, 0.054]) == left


def test_answers_with_citations(spark):
    rows = [
        (1, "Cash was $10,605 [C1].", "How much cash?", "cash 10,605", ["C1"]), (2, "Cash was $10,700 [C2].", "How much?", "cash 10,605", ["C1"]), (3, "Cash was 10,605.", "?", "10605", ["C1"]),
        (4, "It rose.", None, None, None), (5, None, "q", "c", []), (6, "It was 7 [K1].", "q", "c", ["C1", "K1"]),
    ]
    df = spark.createDataFrame(rows, "id int, answer string, question string, context string, blocks array<string>")
    got = {r["id"]: (r["passed"], r["issues"], r["invalid"]) for r in V.verify(df, "answer", "question", "context", "blocks").collect()}
    assert got == {1: (True, [], []), 2: (False, ["numbers", "citations"], ["C2"]), 3: (False, ["uncited"], []), 4: (True, [], []), 5: (True, [], []), 6: (True, [], [])}


@pytest.mark.parametrize("answer, want", [("Cash was 10,605.", True), ("There were 7 in 2024.", False), ("7% of it", False), ("It rose by 85.3%", True), (None, False)])
def test_parts_answered(spark, answer, want):
    assert one(spark, V.answered(F.col("t"), F.col("a")), t=answer, a=[10605.0, 85.3]) is want


TABLE = "[Report]\n| Item | FY2026 |\n| --- | --- |\n| Assets | |\n| Cash (1) | 5 |\n| Goodwill | 7 |\n| Total assets | 12 |"


def test_rows_of_a_table(spark):
    got = one(spark, C.row_select(F.col("t"), F.col("m")), t=TABLE, m=["cash"])
    assert (got["text"].split("\n")[3:], got["kept"], got["rows"]) == (["| Assets | |", "| Cash (1) | 5 |", "| Total assets | 12 |"], 3, 4)
    for text in ("no table", "| a |\n| - |", None, "| a | b |\n| - | - |\n| x | 1 |"):
        got = one(spark, C.row_select(F.col("t"), F.col("m")), t=text, m=["cash"])
        assert got["text"] == text and got["kept"] == 0


@pytest.mark.parametrize("scores, want", [([0.1, 0.9, 0.1, 0.1, 0.8], [0, 1, 2, 3, 4]), ([0.9, 0.1, 0.1, 0.1], [0, 1]), ([0.1, 0.2, 0.0, 0.0, 0.3], [0, 1, 2, 3, 4]), ([0.0, 0.0], [0, 1]), ([], [])])
def test_sentences_chosen(spark, scores, want):
    assert one(spark, C.select_sentences(F.col("s"), 0.5), s=[float(x) for x in scores]) == want


def test_sentences_joined_and_guarded(spark):
    indexes = F.array(F.lit(0), F.lit(2))
    assert one(spark, C.join_sentences(F.col("s"), indexes), s=["A 1.", "B 2.", "C 3."]) == "A 1. […] C 3."
    assert one(spark, C.guarded(F.col("a"), F.col("b")), a="5 of 1,200", b="1200 and 5")["reverted"] is False
    got = one(spark, C.guarded(F.col("a"), F.col("b")), a="6", b="5")
    assert got["reverted"] is True and got["text"] == "5"
