"""Percentiles of very large numeric columns (problem 1).

A value x goes to the bucket (sign x, ceil(log|x| / log g)) with
g = (1 + a) / (1 - a); a bucket stands for the value 2 g^i / (g + 1).  Every
percentile taken from bucket counts is then within the share ``a`` of the value
at that rank, whatever the distribution.  Bucket counts add up, so the sketches
of days, files or partitions are merged by summing matching buckets.

Defined cases: null values are no measurements; zero has a bucket of its own
and is exact; negative values keep their sign unless the caller leaves them
out; a group without any measurement gives no row; null group keys form a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Guaranteed relative error of every percentile.
RELATIVE_ERROR = 0.01


def _gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket(value: F.Column, alpha: float = RELATIVE_ERROR) -> F.Column:
    """Signed bucket number: 0 for zero, else sign x (index + a shift that keeps indexes positive)."""
    index = F.ceil(F.round(F.log(F.abs(value)) / F.lit(math.log(_gamma(alpha))), 9))
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * (index + SHIFT)).cast("int")


#: Added to bucket indexes so that the sign of a bucket is the sign of its values.
SHIFT = 1 << 20


def representative(b: F.Column, alpha: float = RELATIVE_ERROR) -> F.Column:
    """The value that a bucket stands for."""
    g = _gamma(alpha)
    size = F.lit(2 / (g + 1)) * F.pow(F.lit(g), (F.abs(b) - SHIFT).cast("double"))
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b) * size)


def sketch(values: DataFrame, value: str, groups: Sequence[str], alpha: float = RELATIVE_ERROR) -> DataFrame:
    """Bucket counts by group: ``groups``, ``bucket``, ``n``.

    Counting is partial before the shuffle, so a group with a third of all rows
    sends no more than its buckets from each partition.
    """
    kept = values.where(F.col(value).isNotNull())
    return kept.groupBy(*groups, bucket(F.col(value), alpha).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The sketch of coarser groups: counts of matching buckets added up."""
    return sketches.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: Sequence[str], shares: Sequence[tuple[str, float]], alpha: float = RELATIVE_ERROR) -> DataFrame:
    """Percentiles of each group: the value at rank floor(share x (n - 1)), within ``alpha`` of it.

    A group's buckets are gathered as one sorted array; their number is bounded by
    the range of doubles, not by the rows.
    """
    by = sketches.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("_b"), F.sum("n").alias("n_values"))

    def at(share: float) -> F.Column:
        rank = F.floor(F.lit(share) * (F.col("n_values") - 1))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("hit"))
        found = F.aggregate(
            "_b",
            start,
            lambda acc, x: F.struct(
                (acc["seen"] + x["n"]).alias("seen"),
                F.when(acc["hit"].isNull() & (acc["seen"] + x["n"] > rank), x["bucket"]).otherwise(acc["hit"]).alias("hit"),
            ),
        )
        return representative(found["hit"], alpha)

    return by.select(*groups, "n_values", *[at(share).alias(name) for name, share in shares], F.lit(alpha).alias("relative_error"))


def measurements(usage: DataFrame) -> DataFrame:
    """Latency measurements of usage records, a re-sent record once: model, role, day, latency_ms.

    Records are told apart by ``usage_id``; of a re-sent record the version received
    last counts (ties: the greatest of its fields).  Rows without ``usage_id`` cannot
    be matched and count once for each different content in any column.  Null and negative
    latencies are dropped after that choice.
    """
    key = F.when(F.col("usage_id").isNull(), F.xxhash64(*usage.columns))
    slim = usage.select("usage_id", key.alias("_key"), F.struct("received_at", "ts", "latency_ms", "model", "role").alias("_v"))
    once = slim.groupBy("usage_id", "_key").agg(F.max("_v").alias("_v"))
    return once.select("_v.model", "_v.role", F.to_date("_v.ts").alias("day"), "_v.latency_ms").where(F.col("latency_ms") >= 0)
