import math
import random
from datetime import datetime

from tessera.llm import percentiles as P

SHARES = (("p0", 0.0), ("p50", 0.5), ("p99", 0.99), ("p100", 1.0))


def test_error_bound_and_merge(spark):
    random.seed(1)
    rows = [(g, d, x) for g in "ab" for d in range(3) for x in [0, 0, -5, -700, *(int(random.paretovariate(0.7) * 10) for _ in range(800))]]
    df = spark.createDataFrame(rows, "g string, d int, x long")
    daily = P.sketch(df, "x", ["g", "d"])
    whole = P.sketch(df, "x", ["g"])
    merged = P.merge(daily, ["g"])
    assert sorted(merged.select("g", "bucket", "n").collect()) == sorted(whole.select("g", "bucket", "n").collect())
    for r in P.percentiles(merged, ["g"], SHARES).collect():
        xs = sorted(x for g, _, x in rows if g == r["g"])
        assert r["n_values"] == len(xs)
        for name, q in SHARES:
            true = xs[math.floor(q * (len(xs) - 1))]
            assert abs(r[name] - true) <= P.RELATIVE_ERROR * abs(true) + 1e-9


def test_nulls_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, 5), ("a", None), (None, 5)], "g string, x int")
    got = P.percentiles(P.sketch(df, "x", ["g"]), ["g"], SHARES).collect()
    assert len(got) == 1 and got[0]["g"] is None and got[0]["n_values"] == 2
    assert P.percentiles(P.sketch(df.where("false"), "x", ["g"]), ["g"], SHARES).count() == 0


def test_measurements_count_resent_records_once(spark):
    t = datetime(2026, 1, 2, 3)
    rows = [
        (1, t, datetime(2026, 1, 3), "m", "r", 10), (1, t, datetime(2026, 1, 4), "m", "r", 20), (2, t, t, "m", "r", -1), (3, t, t, "m", "r", None),
        (None, t, t, "m", "r", 7), (None, t, t, "m", "r", 7), (None, t, t, "m", "r", 8), (4, t, None, None, None, 0),
    ]
    df = spark.createDataFrame(rows, "usage_id long, ts timestamp, received_at timestamp, model string, role string, latency_ms int").selectExpr("*", "'x' as day", "1 as bucket")
    assert sorted(r["latency_ms"] for r in P.measurements(df).collect()) == [0, 7, 8, 20]
