from tessera.operators.joins import hub_join, sized_join
from tessera.session import Scratch


def test_hubs_give_the_rows_of_a_plain_join(spark):
    rows = [(7, i) for i in range(400)] + [(i, i) for i in range(100)] + [(None, 1), (7, 0)]
    left = spark.createDataFrame(rows, "k int, v int")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(50)] + [(None, "x")], "k int, w string")
    want = sorted((k, v, f"r{k}") for k, v in rows if k is not None and k < 50)
    assert sorted(map(tuple, hub_join(left, right, "k").collect())) == want
    assert hub_join(left.where("false"), right, "k").count() == 0


def test_sized_join_broadcasts_only_below_its_bound(spark):
    left, right = spark.range(20), spark.range(10).selectExpr("id", "id * 2 as w")
    for bound in (5, 50):
        df = sized_join(left, right, "id", rows=bound)
        assert df.count() == 10
        assert ("Broadcast" in df._jdf.queryExecution().toString()) == (bound == 50)


def test_scratch_tables_can_be_read_until_cleared(spark):
    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(5), "five")
    assert kept.count() == 5 and scratch.keep(spark.range(0), "none").count() == 0
    scratch.clear()
