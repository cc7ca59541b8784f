"""Exact order statistics, numbering and resampling that hold under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """How often each value occurs in each group: the form in which exact ranks are taken.

    Counts are partial before the shuffle; afterwards a group is as long as it has
    different values, however many rows it had.
    """
    return rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))


def ranked_percentiles(rows: DataFrame, value: str, groups: Sequence[str], shares: Sequence[tuple[str, float]], rule: str = "half_even") -> DataFrame:
    """Percentiles at a rank: the value of index half_even(p (n - 1)), or floor(p (n - 1)).

    Neither interpolated nor approximate.  Null values are left out; a group of nulls gives no row.
    """
    counts = value_counts(rows, value, groups)
    upto = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    running = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("n_values", F.sum("_n").over(whole))

    def at(share: float) -> Column:
        exact = F.lit(share) * (F.col("n_values") - 1)
        index = F.bround(exact, 0) if rule == "half_even" else F.floor(exact)
        return F.min(F.when(F.col("_upto") > index, F.col(value)))

    return running.groupBy(*groups, "n_values").agg(*[at(s).alias(name) for name, s in shares])


def interpolated_percentile(rows: DataFrame, value: str, share: float, slices: int = 4096) -> DataFrame:
    """One row ``percentile, n_values``: the exact percentile at rank share (n - 1), interpolated between its two neighbours.

    Even slices of the range are counted, and only the one or two slices that hold the
    neighbours are sorted, so near-distinct values never stand in one task.  Nulls are left
    out; without values the percentile is null.
    """
    kept = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    span = kept.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slices), F.lit(slices - 1))).otherwise(0).cast("int")
    placed = kept.crossJoin(F.broadcast(span)).withColumn("_s", place)  # one row
    rank = F.lit(share) * (F.col("_n") - 1)
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # slices rows at most
    offsets = placed.groupBy("_s").agg(F.count("*").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    wanted = offsets.crossJoin(F.broadcast(span.select("_n"))).where((F.col("_before") <= F.ceil(rank)) & (F.col("_before") + F.col("_in") > F.floor(rank))).select("_s", "_before")
    inside = placed.join(F.broadcast(wanted), "_s").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_s").orderBy("_v")) - 1)  # two slices at most
    low, high = F.max(F.when(F.col("_i") == F.floor(rank), F.col("_v"))), F.max(F.when(F.col("_i") == F.ceil(rank), F.col("_v")))
    part = F.max(rank - F.floor(rank))
    return inside.agg((low + (high - low) * part).alias("percentile"), F.coalesce(F.max("_n"), F.lit(0)).alias("n_values"))


def numbered(rows: DataFrame, time: str, ties: Sequence[str], slices: int = 1024) -> DataFrame:
    """Rows with ``row_no``, their number from 1 in the order of ``time`` (a whole number), then ``ties``.

    Slices of time are counted, offsets come from the small table of slices, and rows
    are numbered inside their slice, so the order of all rows needs no single task.
    """
    span = rows.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    placed = rows.crossJoin(F.broadcast(span))  # one row
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / slices))
    placed = placed.withColumn("_slice", F.coalesce(F.floor((F.col(time) - F.col("_lo")) / width), F.lit(slices))).drop("_lo", "_hi")
    sizes = placed.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # slices + 1 rows at most
    offsets = F.broadcast(sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_slice").orderBy(time, *ties)
    return placed.join(offsets, "_slice").withColumn("row_no", F.col("_before") + F.row_number().over(inside)).drop("_slice", "_before")


def numbered_within(rows: DataFrame, groups: Sequence[str], slices: Sequence[str], ties: Sequence[str], name: str) -> DataFrame:
    """Rows with ``name``, their number from 1 inside ``groups`` in the order of ``slices``, then ``ties``.

    Rows are numbered inside their slice and offsets come from the counts of slices, so
    a group of a third of all rows is not gathered into one task.  Null is a value like
    any other and comes first.
    """
    keys = [*groups, *slices]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    inside = Window.partitionBy(*keys).orderBy(*ties)
    ranked = rows.withColumn("_inside", F.row_number().over(inside))
    return ranked.join(offsets, same).withColumn(name, F.col("_before") + F.col("_inside")).drop("_inside", "_before", *[f"_o_{k}" for k in keys])


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by rank sums, ties at their mean rank, from counts by score."""
    counts = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    # Two levels, as scores may be as many as rows.
    cut = F.floor(F.col(score) * 64)
    coarse = counts.groupBy(cut.alias("_c")).agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.select("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_c").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("_c", cut).join(offsets, "_c").withColumn("_r", F.col("_b") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranks.agg(F.sum(F.col("pos") * F.col("_r")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def bootstrap(rows: DataFrame, key: str, value: str, draws: int = 200, seed: int = 17) -> DataFrame:
    """Means of ``draws`` resamples: draw, mean.

    Each row has a Poisson weight in each draw, taken from a hash of its key, so a
    resample is one grouped sum and the same on every run.
    """
    uniform = (F.pmod(F.xxhash64(key, "draw", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for n in range(1, 9):  # weight n where the uniform passes the chance of fewer than n
        total += term
        weight = weight + (uniform > total).cast("int")
        term /= n
    spread = rows.where(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return spread.withColumn("_w", weight).groupBy("draw").agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("mean"))
