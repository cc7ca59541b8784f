import random

from pyspark.sql import functions as F

from tessera.operators import cache as C


def test_decay_and_chance(spark):
    rows = [(10, 0, 100), (1, 0, 10_000), (3, 500, 100), (255, 0, 0)]
    df = spark.createDataFrame(rows, "c int, last long, now long")
    got = [r[0] for r in df.select(C.decayed(F.col("c"), F.col("last"), F.col("now"), 60)).collect()]
    assert got == [9, 0, 3, 255]
    chances = [r[0] for r in df.select(C.increment_chance(F.col("c"))).collect()]
    assert chances == [1 / 51, 1.0, 1.0, 0.0]


def test_upsert_keeps_newest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 1, "w"), ("c", None, "n")], "k string, v int, t string")
    assert {r["k"]: r["t"] for r in C.upsert(old, new, "k", ["v"]).collect()} == {"a": "z", "b": "y", "c": "n"}


def test_replay_invariants_and_order_of_policies(spark):
    random.seed(3)
    keys = [f"k{int(random.paretovariate(0.9)) % 40}" for _ in range(600)]
    log = spark.createDataFrame([(0, i, i, k) for i, k in enumerate(keys)], "shard int, at long, seq long, identity string")
    arms = spark.createDataFrame([(p, c) for p in C.POLICIES for c in (3, 100)], "policy string, capacity int")
    for r in C.replay(log, arms, ttl=10_000).collect():
        assert r["hits"] + r["misses"] + r["expired"] == r["queries"] == 600
        if r["capacity"] == 100:
            assert r["evictions"] == 0 and r["misses"] == len(set(keys))
    expired = C.replay(log, arms, ttl=1).where("hits > 0").count()
    assert expired == 0


def test_rate_limit_does_not_count_refusals(spark):
    log = spark.createDataFrame([("u", t, n) for n, t in enumerate([0, 1, 2, 10, 11, 12])] + [("v", None, 9)], "u string, at long, seq long")
    got = {r["seq"]: (r["accepted"], r["retry_after"]) for r in C.rate_limited(log, "u", 2, 10).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 8), 3: (True, 0), 4: (True, 0), 5: (False, 8), 9: (False, 0)}


def test_rate_limit_in_bursts_is_the_limit_in_one_go(spark):
    random.seed(4)
    times = sorted(random.randint(0, 900) for _ in range(150))
    taken, want = [], []
    for t in times:
        taken = [x for x in taken if x > t - 20]
        want.append(len(taken) < 3)
        if want[-1]:
            taken.append(t)
    log = spark.createDataFrame([("u", t, n) for n, t in enumerate(times)], "u string, at long, seq long")
    got = {r["seq"]: r["accepted"] for r in C.rate_limited(log, "u", 3, 20).collect()}
    assert [got[n] for n in range(150)] == want


def test_token_bucket(spark):
    log = spark.createDataFrame([("u", 0, 0, 10.0), ("u", 0, 1, 5.0), ("u", 100, 2, 1.0)], "u string, at long, seq long, cost double")
    got = {r["seq"]: r["wait"] for r in C.token_bucket(log, "u", rate=1.0, burst=10.0).collect()}
    assert got == {0: 0.0, 1: 5.0, 2: 0.0}


def test_victims(spark):
    rows = [("a", "i", 5, 0, 100, "cv"), ("b", "i", 1, 0, 90, "cv"), ("c", "i", 9, 0, 50, "old"), ("d", "i", 1, 0, 80, "cv")]
    df = spark.createDataFrame(rows, "entry_id string, intent string, lfu_counter int, last_hit_at long, expires_at long, corpus_version string")
    assert [r["entry_id"] for r in C.victims(df, 10, 1000, "cv", "intent", 4).orderBy("turn").collect()] == ["c", "d", "b", "a"]


def test_limits_of_null_keys_and_empty_logs(spark):
    log = spark.createDataFrame([(None, 1, 0, 1.0), (None, 1, 1, None), ("u", None, 2, 1.0)], "u string, at long, seq long, cost double").selectExpr("*", "true as accepted")
    assert {r["seq"]: r["accepted"] for r in C.rate_limited(log, "u", 1, 5).collect()} == {0: True, 1: False, 2: False}
    assert {r["seq"]: r["wait"] for r in C.token_bucket(log, "u", 1.0, 1.0).collect()} == {0: 0.0, 1: 0.0}
    empty = log.where("false")
    assert C.rate_limited(empty, "u", 1, 5).count() == C.token_bucket(empty, "u", 1.0, 1.0).count() == 0
