"""Joins whose strategy is stated: broadcast behind a count, hubs apart, all else by sort and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of at most this many rows is broadcast; its columns are numbers, so that is 10 MB at most.
BROADCAST_ROWS = 100_000


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` joined with ``right``, which is broadcast if it has at most ``rows`` rows, else sorted and merged.

    ``right`` is counted, so it should be a written table or a cheap plan.
    """
    return left.join(right.hint(strategy(right, rows)), on, how)


def strategy(right: DataFrame, rows: int = BROADCAST_ROWS) -> str:
    """The hint for a side after counting it: "broadcast" up to ``rows`` rows, else "merge".  Tables of one size need one count."""
    return "broadcast" if right.limit(rows + 1).count() <= rows else "merge"


def hub_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join with ``right``, which has one row a key, where one key may hold a third of ``left``.

    A hub is a key with more than a quarter of an even partition of ``left``, so there
    are fewer than four hubs a partition: their rows of ``right`` are broadcast, and
    their rows of ``left`` stay where they are.  All other keys are sorted and merged.
    Both sides are read twice, so they should be written tables.  Null keys match nothing.
    """
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = left.count()
    hubs = counts.where(F.col("_n") > max(total / (4 * parts), 1)).select(key).checkpoint()
    few = F.broadcast(hubs)  # fewer than 4 x parts rows
    hot = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key)
    cold = left.join(few, key, "left_anti").join(right.join(few, key, "left_anti").hint("merge"), key)
    return hot.unionByName(cold)
