import random

import numpy as np

from tessera.operators import replay as R

LOG = "shard int, at long, seq long, text string, identity string, guard string, vector array<float>, least double, ttl long"


def log(n=400, shards=2, seed=5):
    rng = random.Random(seed)
    axes = np.eye(12, dtype=np.float32)
    rows = []
    for i in range(n):
        k = min(int(rng.expovariate(0.3)), 11)
        v = axes[k] * 0.95 + axes[(k + 1) % 12] * (0.31 if rng.random() < 0.5 else 0.1)
        v = v / np.linalg.norm(v)
        rows.append((i % shards, i * 600, i, f"t{k}{rng.randrange(3)}", f"i{k if rng.random() < 0.9 else k + 1}", f"g{k % 3}", [float(x) for x in v], 0.9, 40_000))
    return rows


def test_counts_of_every_arm_agree(spark):
    df = spark.createDataFrame(log(), LOG)
    got = R.policy_rates(R.replay_semantic(df, [3, 8])).collect()
    assert len(got) == 2 * len(R.POLICIES)
    for r in got:
        assert r["queries"] == 400 == r["hits"] + r["misses"] and r["hits"] == r["exact"] + r["semantic"] == r["correct"] + r["wrong"]
        assert r["stale"] == 0 or r["policy"] == "lru_no_expiry"
        assert (r["evictions"] == 0) == (r["policy"] == "expiry_only") or r["capacity"] == 8
        assert r["expired"] + r["evictions"] <= r["misses"]
    stale = {r["policy"]: r["stale"] for r in got if r["capacity"] == 8}
    assert stale["lru_no_expiry"] > 0
    again = R.policy_rates(R.replay_semantic(df, [3, 8])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert R.replay_semantic(df.where("false"), [3]).count() == 0


def plain(rows, policy, capacity):
    """Hits and evictions the slow way: all entries are looked at for each query."""
    order = R.POLICIES[policy].order
    entries, seq, hits, gone = [], 0, 0, 0
    for _, at, _, text, identity, guard, vector, least, ttl in rows:
        v = np.asarray(vector, dtype=np.float32)
        if R.POLICIES[policy].expires:
            entries = [e for e in entries if e.expires > at]
        near = [e for e in entries if e.guard == guard]
        hit = next((e for e in near if text in e.texts), None)
        if hit is None and near:
            best = max(near, key=lambda e: (float(e.vector @ v), -e.seq))
            hit = best if float(best.vector @ v) >= least else None
        if hit:
            for e in entries:
                e.texts.discard(text)
            hit.texts.add(text)
            hit.used, hits = at, hits + 1
            continue
        if len(entries) >= capacity:
            entries.remove(min(entries, key=lambda e: order(e, at)))
            gone += 1
        for e in entries:
            e.texts.discard(text)
        entries.append(R._Entry(seq, identity, guard, v, at + ttl, at, at, R.START, {text}))
        seq += 1
    return hits, gone


def test_victims_against_the_plain_way():
    for policy in ("lru", "mru", "fifo", "soonest_expiry", "lru_no_expiry"):
        for seed in range(4):
            rows = log(300, 1, seed)
            cache = R.Cache(policy, 4)
            for _, at, _, text, identity, guard, vector, least, ttl in rows:
                cache.ask(at, text, identity, guard, np.asarray(vector, dtype=np.float32), least, ttl)
            assert (cache.n["hits"], cache.n["evictions"]) == plain(rows, policy, 4), policy


def test_a_hit_is_promoted_to_the_exact_tier_and_counters_fade():
    v = np.array([1.0, 0.0], dtype=np.float32)
    cache = R.Cache("lfu_fading", 2)
    said = [cache.ask(t, x, "i", "g", v, 0.9, 10**6) for t, x in ((0, "a"), (1, "b"), (2, "b"), (3, "a"))]
    assert said == ["miss", "semantic", "exact", "exact"]
    e = cache.entries[0]
    assert e.counter > R.START and R._faded(e, 3 + 3 * R.PERIOD, R.PERIOD) == e.counter - 3
    assert cache.ask(4, "a", "i", "other guard", v, 0.9, 10) == "miss"


def test_promotion_needs_two_capacities(spark):
    def rates(rows):
        return spark.createDataFrame(rows, "policy string, capacity int, correct_rate double")

    close = rates([("base", 25, 0.4), ("base", 50, 0.5), ("x", 25, 0.46), ("x", 50, 0.52)])
    clear = rates([("base", 25, 0.4), ("base", 50, 0.5), ("x", 25, 0.46), ("x", 50, 0.55)])
    assert [(r["wins"], r["promoted"]) for r in R.promotion(close, "base").collect()] == [(1, False)]
    assert [(r["wins"], r["promoted"]) for r in R.promotion(clear, "base").collect()] == [(2, True)]
