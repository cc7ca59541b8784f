from pyspark.sql import functions as F

from tessera.functions import text as X


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()[0]


def test_finance_tokens(spark):
    assert one(spark, "Net $21,403 rose 5.4% in non-marketable don't", X.finance_tokens) == ["net", "$21403", "21403", "rose", "5.4%", "in", "non-marketable", "non", "marketable", "don't", "don", "t"]
    assert one(spark, None, X.finance_tokens) is None
    assert one(spark, "…", X.finance_tokens) == []


def test_parse_amount(spark):
    for text, status, value in [("(1,234)", "number", -1234.0), ("$ 5.5", "number", 5.5), ("—", "nil", None), ("n/a", "text", None), ("12(a)", "number", 12.0), ("", "text", None)]:
        got = one(spark, text, X.parse_amount)
        assert (got["status"], got["value"]) == (status, value)


def test_redact_takes_longest_known_first(spark):
    out = one(spark, "key abcdef and abc, sk-qrstuvwx12, me@example.org", lambda c: X.redact(c, ("abc", "abcdef")))
    assert out == "key [redacted] and [redacted], [redacted], [redacted]"


def test_slug_and_labels(spark):
    assert one(spark, "Cash & equivalents (net)", X.slug) == "cash_equivalents_net"
    assert one(spark, "—", X.slug) == "row"
    assert one(spark, "Goodwill (1), net", X.normalise_label) == "goodwill net"
    assert one(spark, None, X.token_estimate) == 0
