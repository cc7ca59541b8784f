import math

import numpy as np
import pytest

from tessera.functions import vectors as V
from tessera.operators import retrieval as R
from tessera.plans import retrieval as Q


def test_rrf_of_two_lists(spark):
    lists = [("q", x, n) for xs in (["a", "b", "c", "d"], ["c", "a", "e"]) for n, x in enumerate(xs, 1)]
    got = {r["id"]: r["rrf"] for r in R.rrf(spark.createDataFrame(lists, "query_id string, id string, rank int"), "id").collect()}
    assert math.isclose(got["a"], 1 / 61 + 1 / 62) and math.isclose(got["c"], 1 / 63 + 1 / 61)
    assert sorted(got, key=lambda k: (-got[k], k)) == ["a", "c", "b", "e", "d"]


def test_bm25_against_brute_force(spark):
    texts = {1: "cash rose", 2: "cash fell and cash rose again", 3: "", 4: None, 5: "goodwill"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    posts = R.postings(df, "id")
    docs = R.lengths(posts, df, "id")
    terms = spark.createDataFrame([(9, "cash", 1), (9, "goodwill", 2)], "query_id long, term string, qtf long")
    got = {r["id"]: r["score"] for r in R.bm25(posts, docs, terms, "id").collect()}
    words = {k: (v or "").split() for k, v in texts.items()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    idf = {}
    for t in {w for ws in words.values() for w in ws}:
        df_ = sum(t in ws for ws in words.values())
        idf[t] = math.log(n - df_ + 0.5) - math.log(df_ + 0.5)
    floor = R.EPSILON * sum(idf.values()) / len(idf)
    for k, ws in words.items():
        want = sum(q * (idf[t] if idf[t] >= 0 else floor) * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for t, q in (("cash", 1), ("goodwill", 2)) if t in ws)
        assert math.isclose(got.get(k, 0.0), max(want, 0.0), abs_tol=1e-9)


def test_exact_topk_ties_nulls_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["vec_id"], r["rank"]) for r in V.exact_topk(spark, df, df.where("vec_id = 1"), 2).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2)]
    assert V.exact_topk(spark, df, df.where("false"), 2).count() == 0
    assert V.exact_topk(spark, df.where("false"), df, 2).count() == 0


def test_exact_topk_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in V.exact_topk(spark, df, df.where("vec_id < 20"), 3).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(20):
        assert [got[q, r] for r in (1, 2, 3)] == list(np.argsort(-(u @ u[q]))[:3])


def test_where_lets_null_fail(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), (None, 1)], "k string, n int")
    assert df.where(R.where({"$and": [{"k": {"$in": ["a", "b"]}}, {"n": 1}]})).count() == 1
    with pytest.raises(ValueError):
        R.where({"k": {"$gt": 1}})


def test_budget_skips_what_does_not_fit(spark):
    rows = [("q", 1, 60), ("q", 2, 50), ("q", 3, 40), ("q", 4, 1)]
    got = R.fill_budget(spark.createDataFrame(rows, "q string, pos int, cost int"), "q", ["pos"], "cost", 100).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [1, 3] and {r["used"] for r in got} == {100}


def test_floor_keeps_some(spark):
    rows = [("q", "a", 0.9), ("q", "b", -9.0), ("q", "c", -10.0)]
    got = R.floor_and_keep(spark.createDataFrame(rows, "query_id string, id string, rerank_score double"), "id", 0.0, 2, 8)
    assert sorted(r["id"] for r in got.collect()) == ["a", "b"]


def test_retry_without_filter(spark):
    s = "query_id string, id string, rank int"
    filtered = spark.createDataFrame([("x", "1", 1), ("y", "1", 1), ("y", "2", 2), ("y", "3", 3)], s)
    whole = spark.createDataFrame([("x", "7", 1), ("y", "8", 1)], s)
    assert sorted((r[0], r[1]) for r in R.with_retry(filtered, whole, "id").collect()) == [("x", "7"), ("y", "1"), ("y", "2"), ("y", "3")]


def test_every_row_fact_pulls_its_table_parts(spark, tmp_path):
    rows = [(f"r{n:02}", "row_fact", f"p{n % 9}", None, "f", n) for n in range(20)] + [("r20", "row_fact", None, None, "f", 1), ("r21", "row_fact", "p8", None, None, None)]
    rows += [(f"t{p}{part}", "table", f"p{p}", part, "f", p) for p in range(9) for part in (1, 2)]
    spark.createDataFrame(rows, "chunk_id string, modality string, parent_id string, table_part int, filing_id string, page int").write.parquet(f"{tmp_path}/chunks.parquet")
    got = sorted((str(r["query_id"]), r["chunk_id"], r["expanded_from"], r["part_no"]) for r in Q.expand_parents(spark, str(tmp_path)).collect())
    want = [("None", f"t8{part}", "r21", part) for part in (1, 2)] + [("f", f"t{p}{part}", f"r{p:02}", part) for p in range(9) for part in (1, 2)]
    assert got == want


def test_every_chunk_has_its_place_in_the_context(spark, tmp_path):
    kinds = ("row_fact", "table", "text", "figure")
    rows = [("f", f"c{n:02}", kinds[n % 4], None if n % 7 == 0 else n // 6) for n in range(40)] + [(None, "z", "text", 1), ("g", "y", "text", None)]
    spark.createDataFrame(rows, "filing_id string, chunk_id string, modality string, page int").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r["filing_id"], r["chunk_id"]): r["position"] for r in Q.context_order(spark, str(tmp_path)).collect()}
    order = sorted((r for r in rows if r[0] == "f"), key=lambda r: (kinds.index(r[2]), r[3] is None, r[3] or 0, r[1]))
    assert got == {("f", r[1]): n for n, r in enumerate(order, 1)} | {(None, "z"): 1, ("g", "y"): 1}
