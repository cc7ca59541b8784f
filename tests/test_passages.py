import hashlib
import random

from tessera.operators import passages as P
from tessera.plans import answers as A
from tessera.plans import passages as Q


def plain(sizes, least, most):
    pieces = [[i, i + 1, s] for i, s in enumerate(sizes)]
    while True:
        moved = False
        for s, k in sorted((p[2], n) for n, p in enumerate(pieces) if p[2] < least):
            near = [m for m in (k - 1, k + 1) if 0 <= m < len(pieces) and pieces[m][2] + s <= most]
            if near:
                m = min(near, key=lambda x: (pieces[x][2], x))
                a, b = min(m, k), max(m, k)
                pieces[a] = [pieces[a][0], pieces[b][1], pieces[a][2] + pieces[b][2]]
                del pieces[b]
                moved = True
                break
        if not moved:
            return [(a, b) for a, b, _ in pieces]


def test_merging_against_the_plain_way():
    assert P.merge_small([400, 30, 400], 50, 420) == [(0, 1), (1, 2), (2, 3)]
    assert P.merge_small([], 5, 9) == []
    random.seed(7)
    for _ in range(300):
        sizes = [random.choice([0, 5, 30, 80, 119, 120, 200, 460]) for _ in range(random.randint(1, 14))]
        assert P.merge_small(sizes, 120, 450) == plain(sizes, 120, 450)


def test_long_blocks_are_quick():
    assert sum(b - a for a, b in P.merge_small([7] * 200_000, 120, 450)) == 200_000


def test_operator(spark):
    rows = [("f", 1, 1, "a", 100), ("f", 1, 2, "b", 10), ("f", 1, None, "z", None), (None, 2, 1, "c", 500)]
    df = spark.createDataFrame(rows, "filing string, block long, no int, id string, tokens long")
    got = sorted((str(r["filing"]), r["chunk_no"], r["first_id"], r["tokens"]) for r in P.merge_blocks(df, ["filing", "block"], ["no"], "id", "tokens").collect())
    assert got == [("None", 0, "c", 500), ("f", 0, "z", 110)]
    assert P.merge_blocks(df.where("false"), ["filing", "block"], ["no"], "id", "tokens").count() == 0


def test_every_pair_of_a_group_is_compared(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    monkeypatch.setattr(P, "WORDS", 5)
    random.seed(2)
    rows = [(g, f"{g}{n:03}", n, random.sample("abcdefghijkl", random.randint(0, 5))) for g, most in (("f", 40), ("h", 3), ("i", 1)) for n in range(1, most + 1)]
    df = spark.createDataFrame([*rows, (None, "z1", 1, ["a"]), (None, "z2", 2, ["a"])], "g string, id string, rank long, w array<string>")
    want = {}
    for g, k, n, w in rows:
        near = [(len(set(w) & set(v)) / len(set(w) | set(v)), -m, o) for h, o, m, v in rows if h == g and m < n and (w or v)]
        if near:
            sim, _, o = max(near)
            want[k] = (o, sim)
    assert {r["id"]: (r["dup_of"], r["sim"]) for r in P.most_similar_before(df, "g", "id", "rank", "w").collect()} == want


def test_a_copy_far_down_a_filing_is_found(spark, tmp_path):
    rows = [("f", f"c{n:02}", n, f"head\n{chr(97 + n) * 4} {chr(98 + n) * 5} word") for n in range(20)] + [("f", "c20", 20, "head\npppp qqqqq word")]
    spark.createDataFrame(rows, "filing_id string, chunk_id string, page int, document string").selectExpr("*", "'text' as modality").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["chunk_id"]: (r["dup_of"], r["sim"]) for r in Q.dup_similarity(spark, str(tmp_path)).collect()}
    assert len(got) == 20 and got["c20"] == ("c15", 1.0)


def test_texts_that_differ_by_little_are_merged(spark, tmp_path):
    words = [f"w{n}" for n in range(90)]
    han = "".join(chr(0x4E00 + 7 * n) for n in range(80))
    bodies = {"a": " ".join(words), "b": " ".join([*words[:50], "x", *words[51:]]), "c": " ".join(words), "d": " ".join(words[::-1]), "e": han, "f": han[:40] + "x" + han[41:], "g": "", "h": "?"}
    spark.createDataFrame([(k, f"head\n{v}", "text") for k, v in bodies.items()], "chunk_id string, document string, modality string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["kept"]: (r["copies"], r["content"]) for r in A.dedupe_merge(spark, str(tmp_path)).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"a": 3, "d": 1, "e": 2, "g": 1, "h": 1}
    assert got["a"][1] == hashlib.sha256(bodies["a"].encode()).hexdigest()
