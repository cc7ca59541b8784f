import pytest

from tessera.llm import pairs as P
from tessera.operators.minhash import classes, similar_pairs, word_shingles

Q = "How did goodwill change at Acme in 2024?"


@pytest.mark.parametrize("text", [None, "", " \n", "N/A", "-", "—", "...", "[no answer]", "<p></p>", "​", "Answer:", "null", "TBD"])
def test_empty(text):
    assert P.is_empty(text)


@pytest.mark.parametrize("text", ["13", "Not material", "None reported.", "无变化。"])
def test_not_empty(text):
    assert not P.is_empty(text)


@pytest.mark.parametrize("text", [Q, Q.upper(), f"> {Q}", f"You asked: {Q}", f"{Q} {Q}", f"**{Q[:-1]}**", "How\ndid goodwill change at Acme in 2024", Q[:-1] + "…"])
def test_copy(text):
    assert P.is_copy(Q, text)


@pytest.mark.parametrize("text", [f"{Q} Acme reported goodwill of $5 million.", "Goodwill rose by 5% at Acme in 2024.", "13"])
def test_not_copy(text):
    assert not P.is_copy(Q, text)


@pytest.mark.parametrize("text", ["Goodwill rose because of", "In short,", "The filing says: \"We expect goodwill to", "The value for 2024 was $", "| Item | FY2024 |\n| --- | --- |\n| Goodwill |", "```\ngoodwill = 5 +", "增长5%，主", "Three drivers are named: (1) 5% from pri", "It came to $322."])
def test_truncated(text):
    assert P.is_truncated(text)


@pytest.mark.parametrize("text", ["Goodwill rose.", "$5.5 million", "24 percent", "Not material", "It rose. [p. 41]", "It fell. (Source: notes)", "goodwill at Acme:\n- $5 million in 2024\n- $4 million the year before", "He said: \"It rose.\"", "增长5%。", "It was 2024."])
def test_whole(text):
    assert not P.is_truncated(text)


def test_languages():
    assert P.language("The report names goodwill of 5 million") == "en"
    assert P.language("La hausse vient des volumes") == "fr"
    assert P.language("Der Anstieg geht auf neue Verträge zurück") == "de"
    assert P.language("La subida se debe a una compra") == "es"
    assert P.language("5 %") is None
    assert P.wanted_language("Please reply in Spanish: " + Q) == "es"
    assert P.wanted_language(Q + " (answer in French)") == "fr"
    assert P.wanted_language("German answer wanted. " + Q) == "de"
    assert P.wanted_language(None) is None


def test_operator_finds_each_defect_once(spark):
    items = ["goodwill", "inventories", "total assets", "gross profit"]
    rows = []
    for n, item in enumerate(items):
        q = f"How did {item} change at Acme in 202{n}?"
        rows += [
            ("g", f"r{n}", q, f"Regrettably, I am not able to comment on {item}."),
            ("g", f"k{n}", q, "None reported."),
            ("g", f"i{n}", q, f"I can't give advice, but the filing is clear: {item} rose by 5{n}.3 percent."),
            ("g", f"o{n}", q, "La subida del 7,5 % se debe a una compra."),
            ("g", f"t{n}", q, f"{item} rose because of higher volumes and"),
            ("g", f"e{n}", q, None),
        ]
    rows += [("g", "c", Q, Q), ("g", "n", None, "It rose by 5%."), ("g", "n2", None, None), ("g", "c", Q, Q)]
    df = spark.createDataFrame(rows, "pair_table string, pair_id string, question string, answer string").selectExpr("*", "'x' as defect", "'y' as opening")
    got = [(r["pair_id"], r["defect"]) for r in P.broken_pairs(df).collect()]
    want = [(f"{k}{n}", d) for n in range(4) for k, d in (("r", "refusal"), ("o", "other_language"), ("t", "truncated"), ("e", "empty"))] + [("c", "copy"), ("n2", "empty")]
    assert sorted(got) == sorted(want)
    assert P.broken_pairs(df.where("false")).count() == 0


def test_similar_pairs_against_brute_force_and_classes(spark):
    base = [f"w{i}" for i in range(40)]
    texts = {n: " ".join(base[:k] + [f"x{n}"] + base[k:]) for n, k in enumerate((0, 40, 40, 1))} | {9: "quite another text of other words here", 10: ""}
    df = spark.createDataFrame(list(texts.items()), "id int, t string").selectExpr("id", "t", "split(t, ' ') as w")
    items = df.select("id", word_shingles(df["w"]).alias("s"))
    links = similar_pairs(items, "id", "s")
    sets = {r["id"]: set(r["s"]) for r in items.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a]}
    assert {(r["a"], r["b"]) for r in links.collect()} == want
    found = {r["id"]: r["class"] for r in classes(items, links, "id").collect()}
    assert found[9] == 9 and len(found) == 6 and found[1] == found[2]


def test_classes_along_a_chain(spark):
    n = 40
    items = spark.range(n).selectExpr("id as k")
    links = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    assert {r["class"] for r in classes(items, links, "k").collect()} == {0}
