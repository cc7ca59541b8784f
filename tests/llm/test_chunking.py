import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.chunking import SplitSpec, boundaries, split_item, split_oversized

SPEC = SplitSpec(text_limit=20, table_limit=40, overlap=5)


def rebuilt(pieces):
    return "".join(t[s:] for t, _, _, s in pieces)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", min_size=81, max_size=600))
def test_pieces_cover_the_text_and_hold_the_limit(text):
    _, pieces = split_item(text, False, SPEC)
    assert rebuilt(pieces) == text
    assert all(len(t) <= 80 for t, *_ in pieces)
    assert all(s <= 20 for *_, s in pieces)
    assert all(text[a:b] == t for t, a, b, _ in pieces)


@pytest.mark.parametrize(
    "text,kind",
    [("a" * 50 + "\n\n" + "b" * 60, "paragraph"), ("a" * 50 + "\n" + "b" * 60, "line"), ("Aa " * 20 + "end. " + "Bb " * 20 + "end.", "sentence"), ("aa " * 40, "word"), ("a" * 200, "none"), ("a" * 80 + "  \n \t\n " + "b" * 80, "paragraph")],
)
def test_kinds(text, kind):
    assert boundaries(text, 80)[0] == kind


def test_an_edit_alters_only_near_pieces():
    random.seed(5)
    words = ["".join(random.choices("abcdefgh", k=random.randint(2, 9))) for _ in range(3000)]
    a = " ".join(words)
    b = " ".join(["inserted", *words])
    spec = SplitSpec(text_limit=100, overlap=0)
    pa, pb = ({t for t, *_ in split_item(x, False, spec)[1]} for x in (a, b))
    assert len(pa & pb) >= 0.6 * len(pa)


def test_table_pieces_repeat_the_header():
    text = "[crumb]\n| a | b |\n| --- | --- |\n" + "\n".join(f"| row {i} | {i} |" for i in range(40))
    kind, pieces = split_item(text, True, SPEC)
    assert kind == "line" and len(pieces) > 3
    head = "[crumb]\n| a | b |\n| --- | --- |\n"
    assert all(t.startswith(head) and len(t) <= 160 for t, *_ in pieces)
    assert head + "".join(t[len(head) :] for t, *_ in pieces) == text


def test_operator(spark):
    rows = [("e", "1", False, "x " * 100), ("e", "1", False, "x " * 100), ("e", "2", False, None), ("e", "3", False, ""), ("e", "4", True, "y" * 100), ("e", "5", None, "z" * 200)]
    df = spark.createDataFrame(rows, "item_table string, item_id string, is_table boolean, text string").selectExpr("*", "1 as boundary")
    got = {(r["item_id"], r["boundary"]) for r in split_oversized(df, SPEC).collect()}
    assert got == {("1", "word"), ("5", "none")}
    assert split_oversized(df.where("false"), SPEC).count() == 0
