"""Shortened contexts counted by parts against the texts themselves."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import compression as C
from tessera.operators import verification as V
from tessera.plans import answers as A

TEXTS = ["Cash was $1,200 [C1]. It rose 5%!  In 2024. No.\nTotal 7", "現金は5。7増。 9", "", "  \n ", "\t", "5. 6 and 1.5x [C2", "a. [C1]5 b. -3.2% c", "1 200. 1,200\n\n12,", "one. two. three. four 4. five cash"]
TABLES = ["[R 2026]\n| Item | FY2026 |\n| --- | --- |\n| Assets | |\n| Cash (1) | $5 |\n| Goodwill | 7 |\n| Total assets | 12 |", "no table 5", "| a |\n| - |", "| a | 1 |\n| - | - |\n| x | 1 |", "| a | 1 |\n| - | - |", "", "| a | b |\n| - | - |\n\n| x [C1] | -1,000 [C2] |\nnote 3 of 4."]


def naive(short, body):
    g = C.guarded(short, body)
    return F.struct(F.size(V.numbers(g["text"])).alias("numbers"), (F.size(C.invented(g["text"], body)) == 0).alias("faithful"))


@pytest.mark.parametrize("question", ["How much cash in 2024?", "x", "", "現金"])
def test_sentences(spark, question):
    df = spark.createDataFrame([(t, question) for t in TEXTS], "body string, question string").select("body", A._sentences(F.col("body")).alias("s"), A._words(F.col("question")).alias("q"))
    scores = F.transform("s", lambda x: F.size(F.array_intersect(A._words(x), "q")) / F.greatest(F.size("q"), F.lit(1)))
    short = C.join_sentences(F.col("s"), C.select_sentences(scores, 0.25))
    got = C.sentence_fidelity(C.sentence_figures(F.col("s"), F.col("body"), A._words), F.col("q"), 0.25)
    assert all(r["a"] == r["b"] for r in df.select(naive(short, F.col("body")).alias("a"), got.alias("b")).collect())


@pytest.mark.parametrize("labels", [["Cash"], ["goodwill", "x"], [], None])
def test_tables(spark, labels):
    df = spark.createDataFrame([(t, labels) for t in TABLES], "body string, labels array<string>")
    got = C.table_fidelity(C.table_figures(F.col("body")), C.wanted_labels(F.col("labels")))
    rows = df.select(naive(C.row_select(F.col("body"), F.col("labels"))["text"], F.col("body")).alias("a"), got.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_no_body_is_read_for_each_question(spark):
    """Above the join of questions and bodies, where a row is a pair, no text is searched."""
    plan = entry.queries()["fidelity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()

    def above(node):
        if node.nodeName() == "Join":
            return []
        children = node.children()
        return [node.verboseString(100_000), *(x for i in range(children.size()) for x in above(children.apply(i)))]

    lines = above(plan)
    assert len(lines) >= 3 and not any("regexp" in x or "rlike" in x.lower() for x in lines)
