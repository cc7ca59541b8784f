import random

from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import mixture as M

TARGETS = "source string, target_share double, max_repeats int"


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").selectExpr("*", "0 as finish", "1 as epoch")


def brute(rows, targets):
    """Budget and tokens by source of the largest mixture within the caps."""
    have = {s: sum(n for _, x, n in rows if x == s) for s, _, _ in targets}
    return min(int(have[s] * r / w) for s, w, r in targets)


def test_shares_caps_and_budget(spark):
    random.seed(2)
    rows = [(i, "big" if i % 3 else "small", random.randint(1, 50)) for i in range(3000)] + [(9000 + i, "tiny", 30) for i in range(20)]
    rows += [(7000, None, 10), (7001, "other", 10), (7002, "big", 0)]
    targets = [("big", 0.6, 1), ("small", 0.3, 2), ("tiny", 0.1, 4)]
    df, t = sizes(spark, rows), spark.createDataFrame(targets, TARGETS)
    mixed = M.mix(df, t)
    budget = brute(rows, targets)
    got = mixed.collect()
    total = sum(r["n_tokens"] for r in got)
    assert budget - 200 <= total <= budget
    for s, w, r in targets:
        own = [x for x in got if x["source"] == s]
        assert abs(sum(x["n_tokens"] for x in own) / total - w) < 0.01
        assert max(x["epoch"] for x in own) <= r
        assert len({(x["doc_id"], x["epoch"]) for x in own}) == len(own)
    assert not {7000, 7001, 7002} & {x["doc_id"] for x in got}
    report = {r["source"]: r for r in M.shares(mixed, t).collect()}
    assert abs(report["tiny"]["actual_share"] - 0.1) < 0.01 and report["tiny"]["max_used"] <= 4
    assert sum(r["repeats"] for r in M.draws(mixed).collect()) == len(got)
    assert [(x["doc_id"], x["epoch"]) for x in mixed.orderBy("position").collect()] == [(x["doc_id"], x["epoch"]) for x in M.mix(df, t).orderBy("position").collect()]


def test_positions_are_the_running_total_in_order_of_finish(spark):
    rows = [(i, "ab"[i % 2], 1 + i % 7) for i in range(200)]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    got = sorted(M.mix(sizes(spark, rows), t).collect(), key=lambda r: r["position"])
    run = 0
    for k, r in enumerate(got):
        run += r["n_tokens"]
        assert r["position"] == run
        assert k == 0 or got[k - 1]["finish"] <= r["finish"]


def test_a_source_without_tokens_and_empty_tables(spark):
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    only = M.mix(sizes(spark, [(1, "a", 5)]), t)
    assert [(r["doc_id"], r["position"]) for r in only.collect()] == [(1, 5)]
    assert {r["source"]: r["actual_share"] for r in M.shares(only, t).collect()} == {"a": 1.0, "b": 0.0}
    assert M.mix(sizes(spark, []), t).count() == 0
    assert [r["actual_share"] for r in M.shares(M.mix(sizes(spark, []), t), t).collect()] == [0.0, 0.0]


def test_equal_rows_and_a_given_budget(spark):
    rows = [(1, "a", 10), (1, "a", 10), (2, "b", 10)]
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], TARGETS)
    assert sum(r["n_tokens"] for r in M.mix(sizes(spark, rows), t, budget=20).collect()) <= 20


def test_an_exhausted_source_leaves_the_budget_to_the_others(spark):
    rows = [(1, "small", 10)] + [(100 + i, "large", 10) for i in range(100)]
    t = spark.createDataFrame([("small", 0.9, 1), ("large", 0.1, 1)], TARGETS)
    got = M.mix(sizes(spark, rows), t, budget=500).collect()
    assert sum(r["n_tokens"] for r in got) == 500 and max(r["position"] for r in got) == 500
    assert sum(r["n_tokens"] for r in M.mix(sizes(spark, rows), t, budget=5000).collect()) == 1010


@given(st.lists(st.tuples(st.floats(0.01, 1), st.lists(st.integers(1, 60), min_size=1, max_size=12)), min_size=1, max_size=5), st.integers(1, 600))
def test_no_copy_within_the_budget_finishes_after_the_horizon(sources, budget):
    every = sum(w for w, _ in sources)
    copies = []
    for k, (w, docs) in enumerate(sources):
        run = 0
        for n in docs:
            run += n
            copies.append((run / (w / every), k, n))
    end = M.horizon([(w / every, float(sum(docs)), float(max(docs))) for w, docs in sources], budget) * (1 + 1e-9)
    total = 0
    for finish, _, n in sorted(copies):
        total += n
        if total <= budget:
            assert finish <= end
