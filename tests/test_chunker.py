import random

from hypothesis import given
from hypothesis import strategies as st

from tessera.operators import chunker as C


def test_cases_by_hand():
    assert C.split_at([0.1, 0.9, 0.1, 0.1, 0.95, 0.1], 0.5) == [(0, 2), (2, 5), (5, 7)]
    assert C.join_small([(0, 1), (1, 2), (2, 3)], [400, 30, 400], [0.1, 0.2], 50, 420) == [(0, 1), (1, 2), (2, 3)]
    assert C.join_small([(0, 1), (1, 2), (2, 3)], [300, 30, 60], [0.5, 0.2], 50, 420) == [(0, 1), (1, 3)]  # the nearer, not the smaller
    assert C.join_small([(0, 1), (1, 2), (2, 3)], [60, 30, 400], [0.5, 0.2], 50, 420) == [(0, 2), (2, 3)]  # the nearer has no room
    assert C.cut_large([(0, 4)], [200, 200, 200, 200], [0.1, 0.3, 0.2], 450) == [(0, 2), (2, 4)]
    assert C.cut_large([(0, 1)], [900], [], 450) == [(0, 1)]
    assert C.pieces_of([], [], 0.5) == []


def slowly(pieces, sizes, distances, least, most):
    pieces, stuck = list(pieces), set()
    while True:
        small = [(sum(sizes[a:b]), a, b) for a, b in pieces if sum(sizes[a:b]) < least and (a, b) not in stuck]
        if not small:
            return pieces
        size, a, b = min(small)
        near = sorted(((distances[x - 1], side, p) for side, (x, p) in enumerate((k, q) for k, q in [(a, next((q for q in pieces if q[1] == a), None)), (b, next((q for q in pieces if q[0] == b), None))] if q)), key=lambda t: t[:2])
        for _, _, p in near:
            if sum(sizes[p[0] : p[1]]) + size <= most:
                pieces = sorted([q for q in pieces if q not in (p, (a, b))] + [(min(a, p[0]), max(b, p[1]))])
                break
        else:
            stuck.add((a, b))


@given(st.lists(st.integers(1, 200), min_size=1, max_size=14), st.randoms())
def test_joining_against_the_plain_way(sizes, rnd):
    distances = [rnd.choice([0.1, 0.3, 0.5, 0.7]) for _ in sizes[1:]]
    pieces = C.split_at(distances, 0.4)
    assert C.join_small(pieces, sizes, distances, 120, 300) == slowly(pieces, sizes, distances, 120, 300)
    done = C.pieces_of(sizes, distances, 0.4, 120, 300)
    assert [a for a, _ in done[1:]] == [b for _, b in done[:-1]] and done[0][0] == 0 and done[-1][1] == len(sizes)
    assert all(sum(sizes[a:b]) <= 300 or b - a == 1 for a, b in done)


def test_passages_across_blocks(spark):
    rows = [("f", "a", 1, [100, 100, 100], [0.1, 0.1]), ("f", "a", 2, [30], []), ("f", "a", 3, [200], []), ("f", "a", 4, [20], []), ("f", "b", 5, [10], []), ("f", None, 6, [50], []), ("f", "b", 7, [], []), ("g", "a", 1, [900], [])]
    df = spark.createDataFrame(rows, "filing string, section string, block int, sizes array<int>, distances array<double>")
    got = sorted(((r["filing"], r["section"] or "", r["passage"]), (r["first_block"], r["last_block"], r["sentences"], r["tokens"])) for r in C.passages(df, ["filing", "section"], "block", 0.5).collect())
    assert got == [
        (("f", "", 0), (6, 6, 1, 50)), (("f", "a", 0), (1, 1, 3, 300)), (("f", "a", 1), (2, 4, 3, 252)), (("f", "b", 0), (5, 5, 1, 10)), (("g", "a", 0), (1, 1, 1, 900)),
    ]
    assert C.passages(df.where("false"), ["filing", "section"], "block", 0.5).count() == 0


def test_measures_of_blocks(spark):
    random.seed(1)
    df = spark.createDataFrame([(1, "Cash rose. Cash rose. Goats bleat!"), (2, None), (3, " "), (4, "売上高は増加した。利益は減少した。")], "b int, t string")
    got = {r["b"]: r for r in C.measure(df, ["b"], "t").collect()}
    assert [len(got[k]["sizes"]) for k in (1, 2, 3, 4)] == [3, 0, 0, 2]
    assert abs(got[1]["distances"][0]) < 1e-9 and got[1]["distances"][1] == 1.0
    assert C.threshold_of(C.measure(df, ["b"], "t").where("b in (2, 3)")) == 0.0
