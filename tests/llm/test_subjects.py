import random

from pyspark.sql import functions as F

from tessera.llm import subjects as S

WORDS = {"law": ["court", "appeal", "claim", "statute"], "energy": ["turbine", "kilowatt", "emissions", "boiler"], "sport": ["match", "coach", "goal", "league"]}
PLAIN = ["The board met again", "Further details follow below", "Copies were printed here"]


def sentence(subject, n):
    a, b = WORDS[subject][n % 4], WORDS[subject][(n + 1) % 4]
    return f"The {a} and the {b} were noted {n} times."


def corpus():
    docs, truth = [], {}
    names = list(WORDS)
    for i in range(240):
        a, b = names[i % 3], names[(i + 1) % 3]
        if i % 8 == 7:
            parts, own = [f"{PLAIN[k % 3]} {k}." for k in range(5)], set()
        elif i % 5 == 0:
            parts, own = [sentence(a, i + k) for k in range(3)] + [sentence(b, i + k) for k in range(3)], {a, b}
        else:
            parts, own = [sentence(a, i + k) for k in range(4)] + [f"{PLAIN[i % 3]} {i}."], {a}
        docs.append((i, "Heading\n\n" + " ".join(parts), 1))
        truth[i] = own
    return docs, truth


def test_subjects_spread_from_a_few_labels(spark):
    docs, truth = corpus()
    documents = spark.createDataFrame(docs, "doc_id long, text string, share int")
    labels = [(i, s) for i in range(0, 240, 4) for s in (truth[i] or [None])] + [(i, None) for i in range(7, 240, 24)]
    labels += [(5000, "law"), (1, "unknown")]
    found = S.subjects_of(spark, documents, spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(s,) for s in WORDS], "subject string"))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
        assert r["share"] >= 0.25 - 1e-9
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.95 * len(truth)


def test_no_labels_no_text(spark):
    documents = spark.createDataFrame([(1, None), (2, ""), (3, "Heading"), (4, "A court met.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    subjects = spark.createDataFrame([("law",), (None,)], "subject string")
    assert S.subjects_of(spark, documents, none, subjects).count() == 0
    some = spark.createDataFrame([(4, "law"), (1, "law")], "doc_id long, subject string")
    assert {r["doc_id"] for r in S.subjects_of(spark, documents, some, subjects).collect()} <= {4}


def test_templates_and_terms(spark):
    assert S.template("Sales rose 5.2% in 2024!") == "sales rose in"
    rows = spark.createDataFrame([(1, "a b"), (2, "数据库 模块"), (3, "")], "id int, t string")
    got = {r["id"]: set(r["x"]) for r in rows.select("id", S.terms(F.col("t")).alias("x")).collect()}
    assert got == {1: {"a", "b", "a b"}, 2: {"数据", "据库", "数据库", "模块"}, 3: set()}
    assert S.tongue("数据库模块") == "zh"


def test_links_are_verified_and_none_to_a_representative_is_missed(spark):
    rng = random.Random(3)
    cores = {}
    for n in range(120):
        fs = sorted(rng.sample(range(30), rng.randint(1, 5)))
        cores[n] = (fs, [1.0 + f % 3 for f in fs], rng.randint(1, 50))
    df = spark.createDataFrame([(n, *v) for n, v in cores.items()], "c long, fs array<long>, ws array<double>, n long")
    weight = lambda fs: sum(1.0 + f % 3 for f in fs)
    want = {}
    for f in range(30):
        holders = [n for n, v in cores.items() if f in v[0]]
        head = max(holders, key=lambda n: (cores[n][2], n))
        for n in holders:
            a, b = set(cores[n][0]), set(cores[head][0])
            sim = weight(a & b) / weight(a | b)
            if n != head and sim >= S.SIMILARITY:
                want[n, head] = sim
    got = {(r["a"], r["b"]): r["similarity"] for r in S.similar_cores(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_equal_texts_have_the_same_subjects(spark):
    docs, truth = corpus()
    rows = [(i, t) for i, t, _ in docs] + [(1000 + i, t) for i, t, _ in docs[:60]] + [(docs[0][0], docs[0][1])]
    labels = [(1000 + i if i < 60 else i, s) for i in range(0, 240, 4) for s in (truth[i] or [None])] + [(i, None) for i in range(7, 240, 24)]
    found = S.subjects_of(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(s,) for s in WORDS], "subject string"))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert all(got.get(i) == got.get(1000 + i) for i in range(60))
    assert sum(got.get(i, set()) == t for i, t in truth.items()) >= 0.95 * len(truth)
